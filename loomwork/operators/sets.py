"""Unions, differences and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_queue(*kinds: DataFrame) -> DataFrame:
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def exploded_pairs(df: DataFrame, key: str, column: str, sep: str = ";") -> DataFrame:
    """Distinct (key, part) pairs of a separated list."""
    return df.select(key, F.explode(F.split(column, sep)).alias("part")).where("part <> ''").distinct()


def digit_difference(a: Column, b: Column) -> Column:
    """Runs of digits that only one of two readings has: (only_a, only_b)."""
    runs = [F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)) for c in (a, b)]
    return F.struct(F.array_sort(F.array_except(*runs)).alias("only_a"), F.array_sort(F.array_except(runs[1], runs[0])).alias("only_b"))
