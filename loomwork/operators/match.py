"""Catalogue matching: labelled candidates of each field, their scores and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import checks
from loomwork.functions.names import fresh
from loomwork.operators.labels import labelled

#: Display order of the subjects of a document.
SUBJECTS = ("applicant", "spouse", "child", "other")


def candidates(lines: DataFrame, catalogue: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, line_no, line) x catalogue (field, label pattern, value pattern): one row for each label that occurs.

    The catalogue is a list of columns in one projection, so lines are read once whatever its length.
    """

    def one(field: str, label: str, value: str) -> Column:
        hit = F.col("line").rlike(f"(?i){label}")
        found = F.nullif(F.regexp_extract("line", f"(?i){label}\\W*({value})", 1), F.lit(""))
        return F.when(hit, F.struct(F.lit(field).alias("field_name"), found.alias("value")))

    every = F.filter(F.array(*(one(*row) for row in catalogue)), lambda x: x.isNotNull())
    return lines.select("doc_id", "line_no", F.explode(every).alias("c")).select("doc_id", "line_no", "c.*")


def catalogue_candidates(lines: DataFrame, pack: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) x a pack of labels (see labels.pack): one row for each field that a line has a label of, once.

    Of the labels of a line the longest count. The value is what follows the first `:`, `=` or TAB, or else a dash between
    blanks; null where nothing does.
    """
    value = F.coalesce(*(F.nullif(F.trim(F.regexp_extract("line", p, 1)), F.lit("")) for p in (r"^[^:=\t]*[:=\t](.*)$", r"^[^:=\t]*? - (.*)$")))
    found = labelled(lines.select("doc_id", "line_no", "line"), pack)
    longest = F.max("size").over(Window.partitionBy("doc_id", "line_no", "line"))
    return found.withColumn("longest", longest).where("size = longest").select("doc_id", "line_no", "field_name", value.alias("value")).distinct()


def choose(found: DataFrame, score: Column) -> DataFrame:
    """One row for each field of a document: the candidate with the best score, and its status.

    matched with one distinct value, ambiguous with several, missing where only labels occur.
    """
    w = Window.partitionBy("doc_id", "field_name").orderBy(F.desc_nulls_last("score"), "line_no", "value")
    counted = found.groupBy("doc_id", "field_name").agg(F.count_distinct("value").alias("values"))
    (nth,) = fresh(found, "nth")
    best = found.withColumn("score", F.when(F.col("value").isNotNull(), score)).withColumn(nth, F.row_number().over(w)).where(f"{nth} = 1")
    status = F.when(F.col("values") == 0, "missing").when(F.col("values") == 1, "matched").otherwise("ambiguous")
    return best.join(counted, ["doc_id", "field_name"]).select("doc_id", "field_name", "value", status.alias("status"))


#: Words around a label that speak against a field, by field; a candidate with one loses to all without.
AGAINST = {
    "residential_address": "previous|former|prior|past|postal|mailing|employer|company",
    "postal_address": "previous|former|prior|residential",
    "previous_address": "current|postal|mailing",
    "given_names": "company|business|employer|trading|account|bank",
    "family_name": "company|business|employer|trading|account|bank",
    "employer_details": "previous|former|applicant|spouse|guarantor",
    "gross_annual_income": "net|after tax|take home|spouse|monthly",
    "net_monthly_income": "gross|before tax|annual|spouse",
    "loan_amount_requested": "owing|owed|outstanding|existing|balance|limit",
    "existing_loan_amount": "requested|borrow|applied",
}
#: Words that speak for one.
FOR = {
    "residential_address": "current|residential|home",
    "previous_address": "previous|former|prior|past",
    "employer_details": "current|company|pty|ltd",
    "gross_annual_income": "gross|before tax|annual|per annum",
    "net_monthly_income": "net|after tax|take home|monthly",
    "loan_amount_requested": "requested|borrow|amount sought|loan amount",
    "existing_loan_amount": "owing|outstanding|existing|current balance",
}


def disambiguated(name: Column, line: Column, value: Column) -> Column:
    """Score of a candidate: words in its line for and against the field, then the value's length, 200 at most."""
    text, out = F.lower(line), F.least(F.length(value), F.lit(200))
    for table, weight in ((FOR, 1000), (AGAINST, -2000)):
        for field, words in table.items():
            out = out + F.when((name == field) & text.rlike(rf"\b(?:{words})\b"), weight).otherwise(0)
    return out


def confidence(kind: Column, value: Column, snippet: Column | None = None) -> Column:
    """Score from 0 to 1 by the kind of field and how much there is of the value, and where given of its snippet of text.

    A snippet of 45 characters or more adds 0.03, one of less than 25 takes 0.03.
    """
    base = F.when(kind.isin("identifier", "date"), 0.9).when(kind.isin("email", "phone"), 0.85).otherwise(0.7)
    more = F.when(F.length(value) >= 8, 0.05).otherwise(0.0)
    if snippet is not None:
        n = F.length(F.coalesce(snippet, F.lit("")))
        more = more + F.when(n >= 45, 0.03).when(n < 25, -0.03).otherwise(0.0)
    return F.when(value.isNull(), 0.0).otherwise(F.round(base + more, 2))


def postcode_by_context(text: Column) -> Column:
    """A postcode that stands after a state or a label; bare four-digit numbers are none."""
    states = "NSW|VIC|QLD|SA|WA|TAS|ACT|NT"
    return F.nullif(F.regexp_extract(text, rf"(?i)(?:\b(?:{states})\W{{1,12}}|post\s?code\W{{1,20}})([0-9]{{4}})\b", 1), F.lit(""))


def with_state_context(fields: DataFrame) -> DataFrame:
    """Postcodes checked against the state of their document: confidence less 0.25, 0.45 at least, or more 0.03, 0.99 at most."""
    state = F.max(F.when(F.col("field_name") == "state", F.upper("value"))).over(Window.partitionBy("doc_id"))
    fits = checks.postcode_state(F.col("value")) == F.col("doc_state")
    moved = F.when(fits, F.least(F.lit(0.99), F.col("confidence") + 0.03)).when(~fits, F.greatest(F.lit(0.45), F.col("confidence") - 0.25)).otherwise(F.col("confidence"))
    return fields.withColumn("doc_state", state).withColumn("confidence", F.when(F.col("field_name") == "postcode", F.round(moved, 6)).otherwise(F.col("confidence")))


#: What a field record may say of its source and origin.
SOURCES, ORIGINS = ("print", "handwriting", "native", "model"), ("regex", "model", "both", "reviewer")


def sanitised(rows: DataFrame, most: int = 400) -> DataFrame:
    """Field records that are well formed: names of 1 to 64 characters, values up to 500, evidence up to 200, confidence clamped.

    Unknown subjects are other; source and origin, where there are such columns, print and regex. A document keeps its
    first `most` records by name, the feature of the sanitiser.
    """
    more = {}
    if "evidence" in rows.columns:
        more["evidence"] = F.substring("evidence", 1, 200)
    for c, known, default in (("source", SOURCES, "print"), ("origin", ORIGINS, "regex")):
        if c in rows.columns:
            more[c] = F.when(F.col(c).isin(*known), F.col(c)).otherwise(default)
    good = rows.where("field_name is not null and trim(field_name) <> '' and value is not null").select(
        "doc_id",
        F.substring(F.trim("field_name"), 1, 64).alias("field_name"),
        F.substring("value", 1, 500).alias("value"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"),
        F.when(F.col("subject").isin(*SUBJECTS), F.col("subject")).otherwise("other").alias("subject"),
        *(v.alias(c) for c, v in more.items()),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("field_name", "value", F.desc("confidence"), "subject"))
    return good.withColumn("nth", place).where(F.col("nth") <= most).drop("nth")


def state_checked(fields: DataFrame, as_of: str) -> DataFrame:
    """All fields of a document checked anew with its state: valid and code of each, confidence moved as by with_state_context."""
    from loomwork.operators.verify import validate_fields

    moved = with_state_context(fields)
    # the state matters to postcodes alone
    return validate_fields(moved, as_of, "doc_state")


def entity_slots(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """First person and organisation of each document from a table (doc_id, kind, pos, text) of entities."""
    first = entities.groupBy("doc_id").agg(*(F.min_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in ("person", "organisation")))
    given, family = F.substring_index("person", " ", 1), F.regexp_extract("person", r"^\S+\s+(.*)$", 1)
    return docs.join(first, "doc_id", "left").select("doc_id", given.alias("given_names"), F.nullif(family, F.lit("")).alias("family_name"), F.col("organisation").alias("employer"))
