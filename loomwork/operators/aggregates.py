"""Counts, summaries and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.dates import expiry_verdict
from loomwork.functions.names import fresh
from loomwork.functions.keys import identifier, identity_id, tier
from loomwork.operators.select import number_state


def count_by(df: DataFrame, column: str) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("(blank)"))
    return df.groupBy(label.alias(column)).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame) -> DataFrame:
    s = F.col("status")
    return df.agg(F.count("*").alias("total"), *(F.count_if(s == v).alias(v) for v in ("queued", "processing", "extracted", "failed")))


def index_summary(index: DataFrame) -> DataFrame:
    state = number_state(F.col("number"), F.col("valid"))
    return index.agg(
        F.count("*").alias("total"),
        *(F.count_if(state == v).alias(v) for v in ("verified", "failed", "unverifiable", "absent")),
        F.count_if("review").alias("to_review"),
        F.count_if(F.col("expiry").isNotNull()).alias("with_expiry"),
        F.count_if(F.col("sex") == "").alias("without_sex"),
        F.sum("record_count").alias("records"),
        F.count_distinct("number").alias("numbers"),
    )


def expiry_census(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    v = expiry_verdict(F.col(column), first, last)
    kinds = ("valid", "absent", "malformed", "before_window", "after_window")
    return df.select(v.alias("v")).agg(*(F.count_if(F.col("v") == k).alias(k) for k in kinds), F.count_if(~F.col("v").isin("valid", "absent")).alias("rejected"))


def identify(people: DataFrame) -> DataFrame:
    return people.withColumn("identity_id", identity_id(F.col("family"), F.col("given"), F.col("dob")))


def identities(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, rows without an identity). A group shows its first eight documents; larger lists aren't kept."""
    named = identify(people)
    w = Window.partitionBy("identity_id").orderBy("document_id")
    placed = named.where("identity_id is not null").withColumn("place", F.row_number().over(w))
    groups = placed.groupBy("identity_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "extracted").alias("extracted"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= 8, F.col("document_id")))), ",").alias("members"),
    )
    return groups, named.where("identity_id is null")


def name_clusters(people: DataFrame) -> DataFrame:
    """Names that have more than one date of birth."""
    from loomwork.functions.dates import dob_key
    from loomwork.functions.keys import name_key

    keyed = people.where("family is not null").select(name_key(F.col("family")).alias("family"), name_key(F.col("given")).alias("given"), dob_key(F.col("dob")).alias("dob"))
    return keyed.groupBy("family", "given").agg(F.count_distinct("dob").alias("dobs")).where("dobs > 1")


def best_values(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Best value of each field: approved first, then confidence, then the first seen."""
    order = F.struct("approved", "confidence", -F.col("seq"))
    return fields.where("value is not null").groupBy(*keys, "field_name").agg(F.max_by(F.struct("value", "approved", "confidence"), order).alias("b")).select(*keys, "field_name", "b.*")


def corroborate(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct documents behind each canonical identifier (kind, value, document_id), its tier and rank."""
    canon = values.withColumn("canonical", identifier(F.col("value"))).where("canonical <> ''")
    counted = canon.groupBy(*keys, "kind", "canonical").agg(F.count_distinct("document_id").alias("sources"))
    tiered = counted.withColumn("tier", tier(F.col("kind"), F.col("canonical"), F.col("sources")))
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("sources"), "canonical")
    return tiered.withColumn("place", F.row_number().over(w)) if keys else tiered


def source_histogram(corroborated: DataFrame) -> DataFrame:
    return corroborated.groupBy("kind", "sources").agg(F.count("*").alias("identifiers"))


def promote_first(fields: DataFrame, key: str, name: str) -> DataFrame:
    return fields.where((F.col("field_name") == name) & F.col("value").isNotNull()).groupBy(key).agg(F.min_by("value", "seq").alias(name))


def pass_metrics(readings: DataFrame, valid=None) -> DataFrame:
    """By pass: documents, filled cells after it, newly filled ones (delta), regressions, and valid values read.

    readings: doc_id, field_name, pass, value. A regression is an empty reading of a field that has a value from before.
    """
    full = F.coalesce(F.trim("value"), F.lit("")) != ""
    field = Window.partitionBy("doc_id", "field_name").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.max(full).over(field), F.lit(False))
    marked = readings.select("doc_id", "pass", "value", full.alias("full"), had.alias("had"), (F.coalesce(valid, F.lit(False)) if valid is not None else full).alias("good"))
    per = marked.groupBy("pass").agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count_if(F.col("full") & ~F.col("had")).alias("delta"),
        F.count_if(~F.col("full") & F.col("had")).alias("regressions"),
        F.count_if(F.col("full") & F.col("good")).alias("valid"),
    )
    # a row for each pass
    return per.withColumn("filled", F.sum("delta").over(Window.orderBy("pass")))


def label_report(labels: DataFrame) -> DataFrame:
    """By kind: labels, those with text, those that fail (verify.judge_labels) and the mean seconds."""
    return labels.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if("has_text").alias("with_text"), F.count_if("fails").alias("would_fail"), F.round(F.avg("secs"), 6).alias("mean_secs")
    )


def word_report(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Files by root and word, and by root those with two words or more (word null). hits: doc_id, word; files: doc_id, root."""
    named = hits.select("doc_id", "word").distinct().join(files, "doc_id")
    each = named.groupBy("root", "word").agg(F.count("*").alias("files"))
    several = named.groupBy("root", "doc_id").agg(F.count("*").alias("n")).where("n >= 2").groupBy("root").agg(F.count("*").alias("files"))
    return each.unionByName(several.select("root", F.lit(None).cast("string").alias("word"), "files"))


def with_photo(evidence: DataFrame) -> DataFrame:
    """One row: identities, and those of them with a verified photo."""
    return evidence.agg(F.count_distinct("identity_id").alias("identities"), F.count_distinct(F.when(F.col("verified"), F.col("identity_id"))).alias("with_photo"))


def flag_rates(flags: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with each flag and their percentage of all."""
    total = docs.agg(F.count("*").alias("total"))
    per = flags.groupBy("code").agg(F.count_distinct("doc_id").alias("documents"))
    # one row, so the product has a row for each code
    return per.join(F.broadcast(total)).select("code", "documents", F.round(F.col("documents") * 100 / F.col("total"), 2).alias("percent"))


def gate_survey(pages: DataFrame) -> DataFrame:
    """Verdict of each document from its worst page."""
    worst = pages.groupBy("doc_id").agg(
        F.min("probe_conf").alias("conf"), F.min("alnum").alias("alnum"), F.max("ink").alias("ink"), F.bool_and(F.col("kind") == "printed").alias("printed"), F.count("*").alias("pages")
    )
    verdict = F.when(F.col("ink") < 0.02, "blank").when(F.col("printed") & (F.col("conf") >= 0.6) & (F.col("alnum") >= 40), "parked").when(F.col("conf") < 0.1, "unreadable").otherwise("read")
    return worst.withColumn("verdict", verdict)


def cross_tab(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Agreement of two detectors: confirmed, disputed, rescued, rejected."""
    cell = F.when(first & second, "confirmed").when(first, "disputed").when(second, "rescued").otherwise("rejected")
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def score_bands(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int").alias("band")).agg(F.count("*").alias("n"))


def worst_groups(df: DataFrame, key: str, good: Column, k: int = 12, least: int = 3) -> DataFrame:
    """The k groups with the lowest share of good rows, and of those the ones with enough rows: a report of k rows."""
    rated = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(good.cast("int")), 6).alias("ratio"))
    return rated.orderBy("ratio", "n", key).limit(k).where(F.col("n") >= least)


def majority_type(pages: DataFrame, kind: str = "kind", none: str = "blank") -> DataFrame:
    """Most common specific kind of each document; mixed on ties, other without any."""
    counted = pages.groupBy("doc_id", kind).agg(F.count("*").alias("n"))
    top = counted.groupBy("doc_id").agg(F.max(F.when(F.col(kind) != none, F.col("n"))).alias("most"))
    joined = counted.where(F.col(kind) != none).join(top, "doc_id").where("n = most").groupBy("doc_id").agg(F.count("*").alias("ties"), F.min(kind).alias("only"))
    return top.join(joined, "doc_id", "left").select("doc_id", F.when(F.col("most").isNull(), "other").when(F.col("ties") > 1, "mixed").otherwise(F.col("only")).alias("type"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def next_version(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    last = extractions.groupBy("document_id").agg(F.max("version").alias("last"))
    return docs.join(last, docs["id"] == last["document_id"], "left").select(docs["id"], (F.coalesce("last", F.lit(0)) + 1).alias("next"))


def consolidated(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each key: a column for each field, and whether it is approved."""
    best = best_values(fields, [key])
    wide = best.groupBy(key).pivot("field_name", names).agg(F.first("value").alias("value"), F.first("approved").alias("approved"))
    renamed = {f"{n}_value": n for n in names} | {f"{n}_approved": f"{n}__approved" for n in names}
    return wide.withColumnsRenamed(renamed)


def health(docs: DataFrame, extractions: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: documents, those without an extraction, failed ones, jobs in work, and the warnings these give."""
    (has,) = fresh(docs, "has")
    done = extractions.select(F.col("document_id").alias("id")).distinct().withColumn(has, F.lit(True))
    one = docs.join(done, "id", "left").agg(F.count("*").alias("documents"), F.count_if(F.col(has).isNull()).alias("without_extraction"), F.count_if(F.col("status") == "failed").alias("failed"))
    two = jobs.agg(F.count_if(F.col("status") == "processing").alias("in_work"))
    # two single rows
    both = one.join(F.broadcast(two))
    warnings = F.array(F.when(F.col("without_extraction") > 0, "missing_extractions"), F.when(F.col("failed") * 5 > F.col("documents"), "many_failures"))
    return both.withColumn("warnings", F.array_join(F.filter(warnings, lambda x: x.isNotNull()), ","))


def regroup_evidence(crops: DataFrame) -> DataFrame:
    """Crops (doc_id, folder, page, score) as a record for each page: number, best score and scores in order."""
    return crops.groupBy("doc_id", "folder", "page").agg(F.count("*").alias("crops"), F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_list(F.col("score").cast("string"))), ";").alias("scores"))
