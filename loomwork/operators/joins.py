"""Joins of documents, extractions, fields, evidence and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.names import fresh

from loomwork.operators.windows import latest

#: Rows that a dimension table may have to be sent to every task; larger ones are left to the optimizer.
SMALL = 10_000


def dimension(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the table really is small: it is counted, up to the bound."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def latest_extraction(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Every document with its latest extraction, if it has one."""
    last = latest(extractions, ["document_id"], [F.desc("created_at"), F.desc("id")])
    return docs.join(last.withColumnRenamed("id", "extraction_id"), docs["id"] == last["document_id"], "left").drop("document_id")


def latest_fields(extractions: DataFrame, fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Fields of the latest extraction of each document."""
    last = latest(extractions, ["document_id"], [F.desc("created_at"), F.desc("id")]).select(F.col("id").alias("extraction_id"))
    out = fields.where(F.col("field_name").isin(names)) if names else fields
    return out.join(last, "extraction_id", "left_semi")


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the only row of right that has its key; none or several leave nulls. `matches` counts them.

    The right side is counted by key first, so no key's rows come together.
    """
    only = right.groupBy(key).agg(F.count("*").alias("matches"), *(F.first(c).alias(c) for c in right.columns if c != key))
    joined = left.join(only, key, "left")
    one = F.col("matches") == 1
    return joined.select(*left.columns, F.coalesce("matches", F.lit(0)).alias("matches"), *(F.when(one, F.col(c)).alias(c) for c in right.columns if c != key))


def fallback_match(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """left with right's value by the first key, else by the second; matched_by tells which."""
    a, b = fresh(left, "one", "two")
    one = right.groupBy(first).agg(F.min(value).alias(a))
    two = right.groupBy(second).agg(F.min(value).alias(b))
    joined = left.join(one, first, "left").join(two, second, "left")
    return joined.select(
        *left.columns,
        F.coalesce(a, b).alias(value),
        F.when(F.col(a).isNotNull(), first).when(F.col(b).isNotNull(), second).alias("matched_by"),
    )


def pending(files: DataFrame, log: DataFrame, strikes: int = 2) -> DataFrame:
    """Files that aren't done: no ok or fatal row in the log, and fewer than `strikes` other rows."""
    return files.join(terminal(log, strikes).where("done"), "file", "left_anti")


def terminal(log: DataFrame, strikes: int = 2) -> DataFrame:
    """file, done, reason: ok, fatal or struck_out."""
    ok, fatal = F.bool_or("ok"), F.bool_or("fatal")
    other = F.count_if(~F.col("ok") & ~F.col("fatal"))
    reason = F.when(ok, "ok").when(fatal, "fatal").when(other >= strikes, "struck_out")
    return log.groupBy("file").agg(reason.alias("reason")).select("file", F.col("reason").isNotNull().alias("done"), "reason")


def insert_new(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of incoming whose key is new, the first of each by order."""
    first = latest(incoming, [key], [F.asc(order)])
    return first.join(target.select(key), key, "left_anti")


def apply_labels(files: DataFrame, labels: DataFrame, dropped: list[str]) -> DataFrame:
    """Files without a label or with one that isn't dropped."""
    return files.join(labels, "key", "left").where(F.col("kind").isNull() | ~F.col("kind").isin(dropped))


def apply_verdicts(fields: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections replace values and lift confidence to 0.75, confirmations lift it to 0.90."""
    joined = fields.join(verdicts, keys, "left")
    corrected, confirmed = F.col("verdict") == "corrected", F.col("verdict") == "confirmed"
    return joined.withColumn("value", F.when(corrected, F.col("new_value")).otherwise(F.col("value"))).withColumn(
        "confidence",
        F.when(corrected, F.greatest("confidence", F.lit(0.75))).when(confirmed, F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence")),
    ).drop("new_value")


def drop_overlaps(matches: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches (key, s, e) that overlap no claim (key, s, e) of the same document.

    A match overlaps a claim if the greatest end of the claims that start before its own end is beyond its start: one
    sweep over the sorted edges of a document, whose text is a single row before, with one shuffle and no list of spans. Matches and
    claims without a key or a place overlap nothing.
    """
    at, kind, end = fresh(matches, "edge", "is_claim", "claim_end")
    own = claims.select(F.col(key).alias(key), F.col("s").alias(at), F.col("e").alias(end), F.lit(1).alias(kind)).dropna()
    edges = matches.select("*", F.col("e").alias(at), F.lit(0).alias(kind)).unionByName(own, allowMissingColumns=True)
    # a match goes before the claims that start where it ends
    before = Window.partitionBy(key).orderBy(at, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = edges.withColumn(at, F.max(end).over(before)).where(F.col(kind) == 0)
    taken = F.col(key).isNotNull() & (F.col(at) > F.col("s"))
    return swept.where(~F.coalesce(taken, F.lit(False))).select(*matches.columns)


def longest_prefix(df: DataFrame, digits: Column, prefixes: DataFrame) -> DataFrame:
    """df with the name of its three-digit prefix, else of its two-digit one."""
    p3, n3, p2, n2 = names = fresh(df, "p3", "n3", "p2", "n2")
    three, two = (dimension(prefixes.where(F.length("prefix") == n).select(F.col("prefix").alias(p), F.col("name").alias(m))) for n, p, m in ((3, p3, n3), (2, p2, n2)))
    joined = df.join(three, digits.substr(1, 3) == F.col(p3), "left").join(two, digits.substr(1, 2) == F.col(p2), "left")
    return joined.withColumn("institution", F.coalesce(n3, n2)).drop(*names)


def with_catalogue(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fields with the number and display name of the catalogue; those it lacks are left out."""
    return fields.join(dimension(catalogue), "field_name")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def count_check(loaded: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Sources whose rows loaded are not as many as their metadata (key, row_count) say, missing ones included."""
    n = loaded.groupBy(key).agg(F.count("*").alias("loaded"))
    both = metadata.join(n, key, "full_outer").select(key, F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), F.coalesce("loaded", F.lit(0)).cast("long").alias("loaded"))
    return both.where("row_count <> loaded")


def with_sidecar(rows: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a sidecar index, the last row of a key by its position where it has one (seq).

    The sidecar is a table that the planner reads anew for each query, so a changed file needs no reload.
    """
    last = sidecar
    if "seq" in sidecar.columns:
        others = [c for c in sidecar.columns if c not in (key, "seq")]
        last = sidecar.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("last")).select(key, "last.*")
    return rows.join(last, key, "left")


def collisions(fields: DataFrame, subject: str = "subject", value: str = "value") -> DataFrame:
    """Applicant's values that belong to another person of the document and to no other reading of the applicant."""
    own = fields.where(F.col(subject) == "applicant")
    others = fields.where(F.col(subject) != "applicant").select("doc_id", value).distinct()
    support = own.groupBy("doc_id", value).agg(F.count("*").alias("readings"))
    return own.join(others, ["doc_id", value], "left_semi").join(support, ["doc_id", value]).where("readings = 1").drop("readings")




def attach_identity(evidence: DataFrame, docs: DataFrame, identities: DataFrame) -> DataFrame:
    """Evidence with the document at its path and that document's identity, where there are any."""
    at = docs.select(F.col("original_path").alias("path"), F.col("id").alias("document_id"))
    return evidence.join(at, "path", "left").join(identities.select("document_id", "identity_id"), "document_id", "left")


def apply_buckets(evidence: DataFrame, buckets: DataFrame) -> DataFrame:
    """Evidence with the verdict of a review by crop path; without one it stays as it is."""
    joined = evidence.join(buckets, "path", "left")
    return joined.withColumn("verified", F.coalesce(F.col("bucket") == "verified", F.col("verified"))).drop("bucket")
