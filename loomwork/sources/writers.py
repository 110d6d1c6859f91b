"""Sinks: guarded CSV, snapshots, path lists and readable summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomwork.functions.text import csv_guard


def guard_csv(df: DataFrame) -> DataFrame:
    """df whose text cells and column names no spreadsheet runs as formulas."""
    cells = [csv_guard(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cells).toDF(*(f"'{c}" if c[:1] in "=+-@\t\r" else c for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    guard_csv(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet with ZSTD, JSON lines, or text of the one column."""
    if kind == "parquet":
        df.write.option("compression", "zstd").parquet(path)
    elif kind == "json":
        df.write.json(path)
    else:
        df.write.text(path)


def identity_summary(best: DataFrame) -> DataFrame:
    """One text for each identity: a heading and its fields, `name: value [confidence, approved]`."""
    line = F.concat("field_name", F.lit(": "), "value", F.lit(" ["), F.format_number("confidence", 2), F.when(F.col("approved"), ", approved").otherwise(""), F.lit("]"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return best.groupBy("identity_id").agg(F.concat(F.lit("Identity "), F.first("identity_id"), F.lit("\nFields: "), F.count("*").cast("string"), F.lit("\n"), lines).alias("summary"))


#: Columns of the index export.
INDEX_COLUMNS = ("id", "name", "number", "number_state", "sex", "state", "expiry", "review")


def index_export(index: DataFrame) -> DataFrame:
    """Export of the index: yes, no or '' for the check, MM/YYYY for the expiry; the raw expiry never leaves."""
    from loomwork.functions.dates import expiry_month

    yes_no = F.when(F.col("valid"), "yes").when(~F.col("valid"), "no").otherwise("")
    month = F.coalesce(F.date_format(expiry_month(F.col("expiry")), "MM/yyyy"), F.lit(""))
    out = index.select("id", "name", F.coalesce("number", F.lit("")).alias("number"), yes_no.alias("number_state"), "sex", "state", month.alias("expiry"), F.when(F.col("review"), "yes").otherwise("no").alias("review"))
    return guard_csv(out.select(*INDEX_COLUMNS))
