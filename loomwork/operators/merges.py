"""Merging of passes, sources and reviews into one reading of each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_passes(readings: DataFrame, least: float = 0.60) -> DataFrame:
    """Monotonic merge of passes: (doc_id, field_name, pass, value, confidence) -> one row for each field.

    A value is never erased, and replaced only by a later one with confidence of `least` or more. So the winner
    is the last of the first non-empty pass and the confident non-empty passes: an aggregate, not a loop.
    regressions counts the empty passes after the first value.
    """
    full = F.col("value").isNotNull() & (F.col("value") != "")
    readings = readings.select("doc_id", "field_name", "pass", "value", "confidence")
    first = readings.groupBy("doc_id", "field_name").agg(F.min(F.when(full, F.col("pass"))).alias("first"))
    joined = readings.join(first, ["doc_id", "field_name"])
    counts = full & ((F.col("pass") == F.col("first")) | (F.col("confidence") >= least))
    return joined.groupBy("doc_id", "field_name").agg(
        F.max_by("value", F.when(counts, F.col("pass"))).alias("value"),
        F.max_by("confidence", F.when(counts, F.col("pass"))).alias("confidence"),
        F.count_if(~full & (F.col("pass") > F.col("first"))).alias("regressions"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two sources (keys, value, confidence, digits_ok).

    Agreement lifts confidence by 0.05 up to 0.97; on disagreement a value whose digits were not read loses, else
    the less confident one, ties to the right; confidence is then 0.6 at most and the loser is kept beside.
    """
    a, b = (df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("value", "confidence", "digits_ok"))) for p, df in (("l", left), ("r", right)))
    joined = a.join(b, keys, "full_outer")
    l, r = F.col("l_value"), F.col("r_value")
    both = l.isNotNull() & r.isNotNull()
    agree = both & (F.lower(F.trim(l)) == F.lower(F.trim(r)))
    lost = ~F.coalesce("l_digits_ok", F.lit(True))
    won = ~F.coalesce("r_digits_ok", F.lit(True))
    take_left = F.when(lost != won, won).otherwise(F.col("l_confidence") > F.col("r_confidence"))
    return joined.select(
        *keys,
        F.when(agree | ~both, F.coalesce(l, r)).when(take_left, l).otherwise(r).alias("value"),
        F.when(agree, F.least(F.lit(0.97), F.greatest("l_confidence", "r_confidence") + 0.05))
        .when(~both, F.coalesce("l_confidence", "r_confidence"))
        .otherwise(F.least(F.lit(0.6), F.when(take_left, F.col("l_confidence")).otherwise(F.col("r_confidence"))))
        .alias("confidence"),
        F.when(both & agree, "both").when(both, F.when(take_left, "left").otherwise("right")).when(l.isNotNull(), "left").otherwise("right").alias("origin"),
        F.when(both & ~agree, F.when(take_left, r).otherwise(l)).alias("alternate_value"),
    )


def merge_readings(regex: DataFrame, model: DataFrame) -> DataFrame:
    """Pattern readings with a model's (doc_id, field_name, subject, entry, value, confidence, digits_ok, note).

    The model fills blanks; agreement keeps the higher confidence; on disagreement the model's value is taken at 0.6
    at most with a warning, unless its digits were not read. Other people's rows are appended under their label, with
    their number where there are several; a value of an unknown owner is always a warning. note is the model's verdict.
    """
    known = model.withColumns({c: F.lit(None).cast(k) for c, k in (("entry", "int"), ("note", "string")) if c not in model.columns})
    own = known.where("subject in ('applicant', 'unknown')").select(
        "doc_id", "field_name", F.col("value").alias("m"), F.col("confidence").alias("mc"), F.col("digits_ok").alias("md"), (F.col("subject") == "unknown").alias("mu"), "note"
    )
    joined = regex.join(own, ["doc_id", "field_name"], "left")
    v, m = F.col("value"), F.col("m")
    agree = F.lower(F.trim(v)) == F.lower(F.trim(m))
    unread = ~F.coalesce("md", F.lit(True))
    merged = joined.select(
        "doc_id",
        "field_name",
        F.when(m.isNull(), v).when(v.isNull(), m).when(agree | unread, v).otherwise(m).alias("value"),
        F.when(m.isNull(), F.col("confidence"))
        .when(v.isNull(), F.col("mc"))
        .when(agree, F.greatest("confidence", "mc"))
        .when(unread, F.col("confidence"))
        .otherwise(F.least(F.lit(0.6), F.col("mc")))
        .alias("confidence"),
        F.when(m.isNotNull() & (F.col("mu") | v.isNotNull() & ~agree), "warning").otherwise("ok").alias("status"),
        F.when(m.isNotNull(), F.col("note")).alias("note"),
    )
    number = F.when(F.col("entry") > 1, F.concat(F.lit(" "), F.col("entry").cast("string"))).otherwise("")
    rest = known.where("subject not in ('applicant', 'unknown')").select(
        "doc_id", F.concat(F.initcap("subject"), number, F.lit(": "), F.col("field_name")).alias("field_name"), "value", "confidence", F.lit("warning").alias("status"), "note"
    )
    return merged.unionByName(rest)


def pick_type(types: DataFrame, local: str, other: str, confidence: str, least: float = 0.6) -> DataFrame:
    """The classifier's type if it is sure enough, else the local one; whether they differ."""
    sure = F.col(other).isNotNull() & (F.col(confidence) >= least)
    return types.withColumn("type", F.when(sure, F.col(other)).otherwise(F.col(local))).withColumn("differs", F.col(other).isNotNull() & (F.col(other) != F.col(local)))


def upsert_verified(fields: DataFrame, rows: DataFrame, keys: list[str], policy: str = "verified") -> DataFrame:
    """Fields merged with verified rows, and what was done: inserted, updated, unchanged, preserved or kept.

    Corrected or approved values stay; with policy preserve, so does every value that is there.
    """
    old = fields.select(*keys, F.col("value").alias("old"), F.coalesce("approved", F.lit(False)).alias("approved"), F.col("corrected_value").isNotNull().alias("corrected"))
    new = rows.select(*keys, F.col("value").alias("new"))
    joined = old.join(new, keys, "full_outer")
    o, n = F.col("old"), F.col("new")
    action = (
        F.when(n.isNull(), "kept")
        .when(o.isNull(), "inserted")
        .when(o == n, "unchanged")
        .when(F.col("approved") | F.col("corrected") | F.lit(policy == "preserve"), "preserved")
        .otherwise("updated")
    )
    return joined.select(*keys, action.alias("action"), F.when(action.isin("inserted", "updated"), n).otherwise(o).alias("value"))


def upsert_outcome(docs: DataFrame, merged: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """After an upsert (doc_id, action): documents (id, status) with their new status, and the audit rows.

    A document that got or kept a verified field is extracted, whatever it was, but one that a reviewer has closed
    (approved or rejected) stays so. An audit row has the counts of a document's actions that changed something.
    """
    n = merged.groupBy("doc_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "unchanged", "preserved")))
    seen = docs.join(n, docs["id"] == n["doc_id"], "left")
    good = F.coalesce(F.col("inserted") + F.col("updated") + F.col("unchanged"), F.lit(0)) > 0
    status = F.when(good & ~F.col("status").isin("approved", "rejected"), "extracted").otherwise(F.col("status"))
    audit = n.where("inserted + updated > 0").select("doc_id", F.lit("upsert").alias("action"), "inserted", "updated", "preserved", F.lit(at).cast("timestamp").alias("at"))
    return seen.select("id", status.alias("status")), audit


def audit_critical(fields: DataFrame, valid, approved) -> DataFrame:
    """Verdict of each critical field: valid, invalid, protected_invalid or empty."""
    empty = F.col("value").isNull() | (F.trim("value") == "")
    return fields.withColumn("verdict", F.when(empty, "empty").when(valid, "valid").when(approved, "protected_invalid").otherwise("invalid"))


def overlay_reviews(fields: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with the latest correction and approval, rejected approvals of empty values).

    events: field_id, at, correction, approve.
    """
    last = events.groupBy("field_id").agg(
        F.max_by("correction", F.when(F.col("correction").isNotNull(), F.col("at"))).alias("correction"),
        F.max_by("approve", F.when(F.col("approve").isNotNull(), F.col("at"))).alias("approve"),
    )
    joined = fields.join(last, "field_id", "left")
    value = F.coalesce("correction", "value")
    empty = value.isNull() | (F.trim(value) == "")
    bad = F.coalesce("approve", F.lit(False)) & empty
    out = joined.select("field_id", value.alias("value"), (F.coalesce("approve", F.lit(False)) & ~empty).alias("approved"))
    return out, joined.where(bad).select("field_id")


def settle_verdicts(flags: DataFrame, verdicts: DataFrame, pages: DataFrame, readings: DataFrame | None = None, least: float = 0.4) -> DataFrame:
    """State, value and confidence of each flag (doc_id, field_name, value; confidence if there is one).

    A correction needs a cited box, where verdicts have a column box, and its value in a reading or on the page. A
    confirmation of four digits or more needs them there. Whatever is left is unresolved, with a confidence of `least` at most.
    """
    texts = pages.select("doc_id", "text")
    if readings is not None:
        texts = texts.unionByName(readings.select("doc_id", "text"))
    texts = texts.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    joined = flags.join(verdicts, ["doc_id", "field_name"], "left").join(texts, "doc_id", "left")
    cited = F.col("box").isNotNull() if "box" in verdicts.columns else F.lit(True)
    squeezed = F.regexp_replace(F.lower("text"), r"\s+", " ")
    figures = F.regexp_replace("value", r"\D", "")
    corrected = (F.col("verdict") == "corrected") & cited & F.contains(squeezed, F.regexp_replace(F.lower(F.trim("new_value")), r"\s+", " "))
    confirmed = (F.col("verdict") == "confirmed") & ((F.length(figures) < 4) | F.contains(F.regexp_replace("text", r"\D", ""), figures))
    state = F.when(corrected, "corrected").when(confirmed, "confirmed").otherwise("unresolved")
    confidence = F.col("confidence") if "confidence" in flags.columns else F.lit(None).cast("double")
    return joined.select(
        "doc_id",
        "field_name",
        state.alias("state"),
        F.when(corrected, F.col("new_value")).otherwise(F.col("value")).alias("value"),
        F.when((state == "unresolved") & (confidence > least), F.lit(least)).otherwise(confidence).alias("confidence"),
    )


def choose_lines(first: DataFrame, second: DataFrame, keys: list[str], least: float = 0.30) -> DataFrame:
    """Of two readings of each line, the second if it is confident enough and more so than the first.

    Lines that only the second has need two letters or digits.
    """
    a, b = (df.select(*keys, F.col("text").alias(f"{p}_text"), F.col("confidence").alias(f"{p}_conf")) for p, df in (("a", first), ("b", second)))
    joined = a.join(b, keys, "full_outer")
    better = F.col("b_text").isNotNull() & (F.col("a_text").isNull() | ((F.col("b_conf") >= least) & (F.col("b_conf") > F.col("a_conf"))))
    real = F.col("a_text").isNotNull() | (F.length(F.regexp_replace("b_text", "[^A-Za-z0-9]", "")) >= 2)
    return joined.where(real).select(*keys, F.when(better, F.col("b_text")).otherwise(F.col("a_text")).alias("text"), F.when(better, F.col("b_conf")).otherwise(F.col("a_conf")).alias("confidence"))


def assign_evidence(rows: DataFrame, include_review: bool = False) -> DataFrame:
    """State of each evidence row (decision, matches, identity_id), once for each occurrence."""
    confirmed = F.col("decision") == "confirmed"
    state = (
        F.when(confirmed & (F.col("matches") == 1) & F.col("identity_id").isNotNull(), "assigned")
        .when((F.col("decision") == "review") & F.lit(include_review), "needs_review")
        .otherwise("unassigned")
    )
    key = F.sha2(F.concat_ws("|", "file", "page", "part"), 256)
    return rows.withColumn("occurrence", key).withColumn("state", state).dropDuplicates(["occurrence"])


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def fingerprint(df: DataFrame, rule: str) -> DataFrame:
    """One row: a hash of the rule's version and all rows, whatever their order, and the row count."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).select(F.sha2(F.concat_ws("|", F.lit(rule), "n", "s"), 256).alias("fingerprint"), F.col("n").alias("row_count"))


def needs_rebuild(df: DataFrame, rule: str, known: str | None) -> bool:
    return fingerprint(df, rule).first()["fingerprint"] != known


def load_verified(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified rows (content_hash, field_name, value, verif) of documents not known yet, with ids made from content."""
    new = records.where("verif = 'ok'").join(docs.select("content_hash"), "content_hash", "left_anti")
    document = F.substring(F.sha2(F.concat(F.lit("doc|"), "content_hash"), 256), 1, 16)
    field = F.substring(F.sha2(F.concat_ws("|", F.lit("field"), "content_hash", "field_name"), 256), 1, 16)
    return new.select(document.alias("document_id"), field.alias("field_id"), "field_name", "value").dropDuplicates(["field_id"])


def load_corpus(records: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, extractions and fields to insert for verified rows (content_hash, path, field_name, value, verif).

    Documents known by content or by path are skipped; ids are made from content; a document whose extension isn't
    accepted is loaded with a warning; a document without a verified row has no extraction.
    """
    from loomwork.functions.text import category

    def made(*parts):
        return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)

    new = records.join(docs.select("content_hash"), "content_hash", "left_anti").join(docs.select("path"), "path", "left_anti").where("verif = 'ok'")
    document, extraction = made(F.lit("doc"), "content_hash"), made(F.lit("extraction"), "content_hash")
    files = new.groupBy("content_hash").agg(F.min("path").alias("path"))
    warning = F.when(category(F.col("path")) == "other", "format")
    documents = files.select(document.alias("id"), "content_hash", "path", F.lit("extracted").alias("status"), warning.alias("warning"))
    extractions = files.select(extraction.alias("id"), document.alias("document_id"), F.lit(1).alias("version"))
    fields = new.groupBy("content_hash", "field_name").agg(F.min("value").alias("value"))
    return documents, extractions, fields.select(made(F.lit("field"), "content_hash", "field_name").alias("id"), extraction.alias("extraction_id"), "field_name", "value")


def load_scores(fields: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores put into fields: inserted, updated, unchanged, or skipped where a reviewer corrected the field."""
    joined = fields.select("doc_id", F.col("value").alias("old"), "corrected_value").join(scores.select("doc_id", F.col("score").alias("new")), "doc_id", "full_outer")
    action = (
        F.when(F.col("new").isNull(), "kept").when(F.col("corrected_value").isNotNull(), "skipped").when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    )
    return joined.select("doc_id", action.alias("action"), F.when(action.isin("inserted", "updated"), F.col("new")).otherwise(F.coalesce("corrected_value", "old")).alias("value"))


def reaudit(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Documents whose bytes are not what their extension claims become failed; nothing is deleted."""
    from loomwork.functions.text import category
    from loomwork.operators.verify import claims_hold

    joined = docs.join(kinds, "id", "left")
    bad = F.col("kind").isNotNull() & ~claims_hold(category(F.col("filename")), F.col("kind"))
    return joined.select("id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), bad.alias("changed"))
