"""Filters, predicates, paging and projections over tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.dates import expiry_month
from loomwork.functions.names import fresh
from loomwork.functions.text import effective

MOST_TERMS, MOST_ROWS = 6, 500


def effective_values(fields: DataFrame) -> DataFrame:
    """fields with `value`: the reviewer's correction, else the extracted value."""
    return fields.withColumn("value", effective(F.col("corrected_value"), F.col("field_value")))


def first_values(fields: DataFrame) -> DataFrame:
    """First non-empty effective value of each field of an extraction, by seq."""
    return (
        effective_values(fields)
        .where("value is not null")
        .groupBy("extraction_id", "field_name")
        .agg(F.min_by("value", F.struct("seq", "value")).alias("value"))
    )


def matches_terms(blob: Column, query: str) -> Column:
    """Every word of the query, up to six, occurs literally in the lower-cased blob."""
    terms = query.lower().split()[:MOST_TERMS]
    return reduce(lambda a, b: a & b, (F.contains(F.lower(blob), F.lit(t)) for t in terms), F.lit(True))


def number_state(number: Column, valid: Column) -> Column:
    return F.when(number.isNull(), "absent").when(valid.isNull(), "unverifiable").when(valid, "verified").otherwise("failed")


def expiry_state(month: Column, as_of: str) -> Column:
    """without, expired, expiring_soon (this month and three more) or with."""
    start = F.trunc(F.lit(as_of).cast("date"), "month")
    return F.when(month.isNull(), "without").when(month < start, "expired").when(month < F.add_months(start, 4), "expiring_soon").otherwise("with")


@dataclass
class IndexQuery:
    """What to show of the index; an unknown value of a choice filters nothing."""

    text: str = ""
    number: str | None = None
    sex: str | None = None
    state: str | None = None
    expiry: str | None = None
    review: bool | None = None
    sort: str = "id"
    descending: bool = False
    limit: int = 50
    offset: int = 0


SORTABLE = ("id", "name", "number", "state", "record_count")


def filter_index(index: DataFrame, q: IndexQuery, as_of: str) -> DataFrame:
    out = index.where(matches_terms(F.concat_ws(" ", "name", "number", "state", "source_files"), q.text))
    if q.number in ("verified", "failed", "unverifiable", "absent"):
        out = out.where(number_state(F.col("number"), F.col("valid")) == q.number)
    if q.sex in ("M", "F"):
        out = out.where(F.col("sex") == q.sex)
    if q.state:
        out = out.where(F.col("state") == q.state)
    if q.review is not None:
        out = out.where(F.col("review") == q.review)
    state = expiry_state(expiry_month(F.col("expiry")), as_of)
    if q.expiry in ("expired", "expiring_soon", "without"):
        out = out.where(state == q.expiry)
    elif q.expiry == "with":
        out = out.where(state != "without")
    return out


def page(df: DataFrame, order: str, limit: int = 50, offset: int = 0, descending: bool = False, key: str = "id") -> DataFrame:
    """One page in order, blanks last, ties by key. The limit is the feature: 1 to 500 rows."""
    c = F.col(order if order in SORTABLE else key)
    by = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return df.orderBy(by, F.col(key)).offset(max(0, offset)).limit(min(MOST_ROWS, max(1, limit)))


def query_index(index: DataFrame, q: IndexQuery, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(page, one row with the total)."""
    found = filter_index(index, q, as_of)
    return page(found, q.sort, q.limit, q.offset, q.descending), found.agg(F.count("*").alias("total"))


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    total = F.count("*")
    return df.agg(total.alias("total"), (F.lit(offset + limit) < total).alias("has_more"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def select_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is asked for; ids that don't exist are ignored."""
    (chosen,) = fresh(df, "chosen")
    return df.join(ids.select(F.col(ids.columns[0]).alias(chosen)), F.col(key) == F.col(chosen), "left_semi")


def accept(files: DataFrame, extension: Column, allowed: list[str], most_bytes: int) -> DataFrame:
    """files with `outcome`: unsupported, too_large or accepted."""
    return files.withColumn("outcome", F.when(~extension.isin(allowed), "unsupported").when(F.col("bytes") > most_bytes, "too_large").otherwise("accepted"))


def greedy_cap(files: DataFrame, batch: str, order: str, most_files: int, most_bytes: int) -> DataFrame:
    """Accepts files of a batch in order while their number and bytes stay within the caps; a refused one adds nothing.

    A batch is one upload, so its list is bounded by what was sent at once.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("bytes").cast("long").alias("bytes"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast(f"array<struct<at:{files.schema[order].dataType.simpleString()},ok:boolean>>").alias("out"))

    def step(a, x):
        ok = (a["n"] < most_files) & (a["sum"] + x["bytes"] <= most_bytes)
        return F.struct(
            (a["n"] + F.when(ok, 1).otherwise(0)).alias("n"),
            (a["sum"] + F.when(ok, x["bytes"]).otherwise(F.lit(0).cast("long"))).alias("sum"),
            F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), ok.alias("ok")))).alias("out"),
        )

    folded = files.groupBy(batch).agg(F.aggregate(rows, start, step)["out"].alias("out"))
    return folded.select(batch, F.explode("out").alias("o")).select(batch, F.col("o.at").alias(order), F.when(F.col("o.ok"), "accepted").otherwise("limit").alias("outcome"))


def public_view(df: DataFrame, private: list[str]) -> DataFrame:
    return df.drop(*private)


def round_robin(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """n rows, one of each group in turn; the limit is the feature of a sample."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.orderBy("turn", group).limit(n)
