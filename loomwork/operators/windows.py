"""Latest rows, queue order, keepers of duplicates and other ordered work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.names import fresh


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    (nth,) = fresh(df, "nth")
    return df.withColumn(nth, F.row_number().over(w)).where(f"{nth} = 1").drop(nth)


def last_rows(df: DataFrame, key: str, seq: str, usable: Column | None = None) -> DataFrame:
    """Last row of each key by seq; with `usable`, the last of those that are."""
    rows = df if usable is None else df.where(usable)
    rest = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq])).alias("r")).select(key, "r.*")


def claim_plan(jobs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k queued jobs to run next: other files before PDFs, then the oldest. A top-k, so Spark keeps k rows a task."""
    queued = jobs.where("status = 'queued'").select(F.col("id").alias("job_id"), "document_id", "started_at")
    named = queued.join(docs.select(F.col("id").alias("document_id"), "filename"), "document_id")
    pdf = F.lower("filename").endswith(".pdf").alias("is_pdf")
    return named.select("job_id", "document_id", pdf, "started_at").orderBy("is_pdf", "started_at", "job_id").limit(k)


def duplicate_plan(files: DataFrame) -> DataFrame:
    """Files of equal size and hash: keeper (lowest root, then shortest path, then path) and copies."""
    order = F.struct("root_rank", F.length("path").alias("length"), "path")
    keeper = files.groupBy("bytes", "sha256").agg(F.min(order)["path"].alias("keeper"), F.count("*").alias("copies"))
    return files.join(keeper, ["bytes", "sha256"]).withColumn("action", F.when(F.col("path") == F.col("keeper"), "keep").otherwise("duplicate"))


def collision_names(files: DataFrame) -> DataFrame:
    """New names in one folder: clashing ones, without regard to case, get 8 digits of their path's hash."""
    n = F.count("*").over(Window.partitionBy(F.lower("name")))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)?$", 1)
    hashed = F.concat(stem, F.lit("~"), F.substring(F.sha2("path", 256), 1, 8), ext)
    return files.withColumn("target", F.when(n > 1, hashed).otherwise(F.col("name")))


def with_sections(lines: DataFrame, is_header: Column) -> DataFrame:
    """Lines (doc_id, line_no, line) with the nearest header at or above them."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(w))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_reading(readings: DataFrame) -> DataFrame:
    """Most confident reading of each field of a document, the first on ties."""
    return latest(readings, ["doc_id", "field_name"], [F.desc("confidence"), F.asc("seq")])


def pass_log(readings: DataFrame, fields: int) -> DataFrame:
    """Per document and pass: fields filled so far, new ones, recall in percent."""
    first = readings.where("value is not null").groupBy("doc_id", "field_name").agg(F.min("pass").alias("pass"))
    new = first.groupBy("doc_id", "pass").agg(F.count("*").alias("delta"))
    passes = readings.select("doc_id", "pass").distinct().join(new, ["doc_id", "pass"], "left").fillna({"delta": 0})
    w = Window.partitionBy("doc_id").orderBy("pass")
    filled = passes.withColumn("filled", F.sum("delta").over(w)).withColumn("before", F.lag("delta").over(w))
    return filled.withColumn("recall", F.round(F.col("filled") * 100 / fields, 1))


def stop_pass(log: DataFrame, early: bool = False) -> DataFrame:
    """First pass at which a document stops, and whether it fails.

    Two passes without gain from pass 3 on, or 95 percent from pass 4 on; with early, pass 4 at most. Where the log has
    them, native_chars of 300 or more, or a print reading (printed) with four fields or 1,500 characters (chars), stop after
    pass 1; a document with no field by pass 2 and fewer than 25 letters and digits (alnum) fails.
    """
    has = set(log.columns)
    stop = ((F.col("delta") == 0) & (F.col("before") == 0) & (F.col("pass") >= 3)) | ((F.col("recall") >= 95) & (F.col("pass") >= 4))
    if early:
        stop = stop | (F.col("pass") >= 4)
    if "native_chars" in has:
        stop = stop | (F.col("native_chars") >= 300)
    if {"printed", "chars"} <= has:
        stop = stop | (F.col("printed") & ((F.col("filled") >= 4) | (F.col("chars") >= 1500)))
    out = [F.min(F.when(stop, F.col("pass"))).alias("stop_pass"), F.max("pass").alias("last_pass")]
    if "alnum" in has:
        out.append(F.bool_or((F.col("pass") >= 2) & (F.col("filled") == 0) & (F.col("alnum") < 25)).alias("fails"))
    return log.groupBy("doc_id").agg(*out)


def corpus_stop(log: DataFrame, documents: int, early: bool = False, wanted: int = 25) -> DataFrame:
    """One row, stop_pass: the pass at which a whole corpus stops, by the log's sums over documents; a row for each pass."""
    sums = log.groupBy("pass").agg(F.sum("delta").alias("delta"), F.sum("filled").alias("filled"))
    w = Window.orderBy("pass")
    rows = sums.withColumn("before", F.lag("delta").over(w))
    stop = (F.col("delta") == 0) & (F.col("before") == 0) & (F.col("pass") >= 3)
    stop = stop | (F.lit(early) & ((F.col("pass") >= 4) | (F.col("filled") >= wanted * documents)))
    return rows.agg(F.min(F.when(stop, F.col("pass"))).alias("stop_pass"))


def evidence_rank(corroborated: DataFrame, key: str) -> DataFrame:
    """Identifiers of each key in order: passports before licences, more documents first, then the identifier."""
    kind = F.when(F.col("kind") == "passport", 0).when(F.col("kind") == "licence", 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(kind, F.desc("sources"), "canonical")
    return corroborated.withColumn("place", F.row_number().over(w))


def gallery(evidence: DataFrame) -> DataFrame:
    """Evidence with its place in the gallery (verified first, then document and page) and the thumbnail mark."""
    w = Window.partitionBy("identity_id").orderBy(F.desc("verified"), "doc_id", "page")
    return evidence.withColumn("place", F.row_number().over(w)).withColumn("thumbnail", F.col("verified") & (F.col("place") == 1))


def catalogue_order(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fields with their place in a document: by catalogue number, unknown ones last by name."""
    joined = fields.join(catalogue, "field_name", "left")
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("number"), "field_name")
    return joined.withColumn("place", F.row_number().over(w))


def smallest_first(pages: DataFrame, k: int) -> DataFrame:
    """The k smallest documents to process next, by pages, then path: a top-k."""
    return pages.orderBy("pages", "path").limit(k)
