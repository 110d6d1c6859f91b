"""Checks of field rows, documents, files and labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import checks
from loomwork.functions.dates import dob_reliable, let
from loomwork.functions.names import fresh
from loomwork.functions.text import extension
from loomwork.functions.vocabulary import INSTRUCTION_WORDS, LABEL_WORDS, SINGLE_LABELS, STOP_WORDS, STREET_PHRASES, STREET_WORDS

LABELS = tuple(LABEL_WORDS)


def validate_fields(fields: DataFrame, as_of: str, state: str | None = None) -> DataFrame:
    """fields (field_name, value) with valid, code, canonical and message by the rule of the field's name.

    state names a column with the state that a postcode has to be in, where it is not null.
    """
    n, v = F.col("field_name"), F.col("value")
    day = F.lit(as_of).cast("date")
    birth, zone = checks.dob_error(v, day), checks.postcode_error(v, F.col(state) if state else None)
    d = checks.digits(v)
    #: whether it holds, the canonical form, why not, and what a valid one is called
    rules = {
        "abn": (checks.abn_valid(v), checks.abn_canonical(v), F.when(F.length(d) != 11, "length").when(d.substr(1, 1) == "0", "leading_zero").otherwise("checksum"), "business number with its check sum"),
        "tfn": (checks.tfn_valid(v), d, F.when(F.length(d).isin(8, 9), "checksum").otherwise("length"), "tax file number with its check sum"),
        "acn": (checks.acn_valid(v), d, F.when(F.length(d) == 9, "checksum").otherwise("length"), "company number with its check digit"),
        "medicare": (checks.medicare_valid(v), d, F.when(F.length(d).isin(10, 11), "checksum").otherwise("length"), "card number with its check digit"),
        "card": (checks.card_valid(v), F.when(~checks.masked(v), d), F.when(F.length(d).between(13, 19), "checksum").otherwise("length"), "card number"),
        "bsb": (checks.bsb_valid(v), checks.bsb_canonical(v), F.when(F.length(d) == 6, "unassigned").otherwise("length"), "branch number"),
        "phone": (checks.phone_valid(v), checks.phone_canonical(v), F.lit("shape"), "phone number"),
        "postcode": (zone.isNull(), v, zone, "postcode"),
        "date_of_birth": (birth.isNull(), F.date_format(F.try_to_date(F.array_join(checks.dob_parts(v), "/"), "dd/MM/yyyy"), "yyyy-MM-dd"), birth, "date of birth"),
    }
    valid, canonical, code, message = (F.lit(None).cast("boolean"), *(F.lit(None).cast("string"),) * 3)
    for name, (ok, form, why, said) in rules.items():
        ok = F.coalesce(ok, F.lit(False))
        valid = F.when(n == name, ok).otherwise(valid)
        canonical = F.when((n == name) & ok, form).otherwise(canonical)
        code = F.when((n == name) & ~ok, F.concat(F.lit(f"{name}_"), F.coalesce(why, F.lit("shape")))).otherwise(code)
        message = F.when(n == name, F.concat(F.when(ok, "a ").otherwise("not a "), F.lit(said))).otherwise(message)
    code = F.when(~n.isin(*rules), "no_rule").otherwise(F.coalesce(code, F.lit("ok")))
    return fields.withColumns({"valid": valid, "code": code, "canonical": canonical, "message": message})


NAME_FIELDS = ("given_names", "family_name", "middle_name", "preferred_name", "previous_name")
ADDRESS_FIELDS = ("residential_address", "postal_address", "previous_address")
ID_FIELDS = ("drivers_licence", "passport_details", "passport_number", "licence_number")
EMAIL_FIELDS, PHONE_FIELDS = ("email", "email_address"), ("mobile", "mobile_number")


def ascii_words(c: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def among(w: Column, every: list[str] | tuple[str, ...]) -> Column:
    """How many of some words are in a list."""
    return F.size(F.filter(w, lambda x: x.isin(*every)))


def looks_dated(c: Column) -> Column:
    """Whether a value has a day, month and year, in numbers or with a name, and little else."""
    p = F.filter(F.split(F.lower(c), "[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"), lambda x: x != "")
    n = F.size(F.filter(p, lambda x: x.rlike("^[0-9]")))
    names = F.size(F.filter(p, lambda x: x.rlike("^[a-z]{3,9}$")))
    return (F.length(c) <= 24) & ((n >= 3) | ((n >= 2) & (names >= 1)))


def sanity(name: Column, value: Column, own_labels: list[str] | tuple[str, ...] = ()) -> Column:
    """Why a value can't be one, or null.

    label, question, instruction, not_a_name, not_a_date, not_an_email, not_a_mobile, not_an_address, not_an_id. Fields
    whose values have a form are judged by it; other values of several words are labels if they are made of label
    words, or of the field's own labels, and instructions if they have the words of sentences to the reader.
    """
    raw = F.trim(value)

    def typed() -> Column:
        d = checks.digits(raw)
        bare = F.filter(F.split(F.lower(raw), "[^a-z]+"), lambda x: x != "")
        long_words = F.size(F.filter(F.split(raw, r"\s+"), lambda x: x.rlike("[A-Za-z]{3}")))
        street = (among(bare, STREET_WORDS) > 0) | F.exists(F.array(*map(F.lit, STREET_PHRASES)), lambda x: F.array_join(bare, " ").contains(x))
        # the rule is about digits, whatever parts them: 04 and eight more, or 61 (0) 4 and eight more
        mobile = ((F.length(d) == 10) & F.startswith(d, F.lit("04")) | (F.length(d) == 11) & F.startswith(d, F.lit("614")) | (F.length(d) == 12) & F.startswith(d, F.lit("6104"))) & ~raw.rlike("[A-Za-z]{3}")
        # one @ with something before it, and after it a host of two labels or more
        mail = F.split(raw, "@")
        host = F.try_element_at(mail, F.lit(2))
        email = (F.size(mail) == 2) & (F.length(mail[0]) > 0) & ~raw.rlike(r"\s") & host.rlike(r"^[^.].*\..{2,}$")
        return (
            F.when(name.isin(*EMAIL_FIELDS), F.when(~F.coalesce(email, F.lit(False)), "not_an_email").otherwise("ok"))
            .when(name.isin(*PHONE_FIELDS), F.when(~mobile, "not_a_mobile").otherwise("ok"))
            .when(name.isin(*ADDRESS_FIELDS), F.when(~(raw.rlike("[0-9]") & street & ~raw.contains("|") & (F.length(raw) >= 8)), "not_an_address").otherwise("ok"))
            .when(name.isin(*ID_FIELDS), F.when(~(raw.rlike("[0-9]") & (long_words <= 2) & (F.length(raw) <= 24)), "not_an_id").otherwise("ok"))
        )

    def prose(w: Column) -> Column:
        n = F.size(w)
        single = ~raw.rlike(r"\s")
        own = F.array_join(w, " ").isin(*(" ".join(re.findall("[a-z0-9]+", x.lower())) for x in own_labels)) if own_labels else F.lit(False)
        return (
            F.when(single, F.when(F.array_join(w, " ").isin(*SINGLE_LABELS), "label").otherwise("ok"))
            .when((n >= 2) & own, "label")
            .when((n <= 10) & (among(w, LABEL_WORDS) >= 0.8 * n), "label")
            .when((n >= 4) & (among(w, INSTRUCTION_WORDS) >= 1) | (among(w, INSTRUCTION_WORDS) == n), "instruction")
            .when((n >= 6) & (among(w, STOP_WORDS) >= 0.3 * n), "instruction")
            .when((n >= 4) & raw.rlike("^[a-z]"), "instruction")
            .otherwise("ok")
        )

    def named(kept: Column) -> Column:
        size = F.size(F.filter(F.split(kept, r"\s+"), lambda x: x != ""))
        return F.when(kept == "", "label").when((size > 4) | kept.rlike(r"[0-9()/\\@#]"), "not_a_name").otherwise("ok")

    # the name of the field is tested first, so that a value goes through its own rules only
    verdict = let(
        ascii_words(raw),
        lambda w: F.when(F.size(w) == 0, "label")
        .when(name == "date_of_birth", F.when(looks_dated(raw), "ok").otherwise("not_a_date"))
        .when(F.endswith(raw, F.lit("?")), "question")
        .when(name.isin(*NAME_FIELDS), named(trim_labels(raw)))
        .otherwise(F.coalesce(F.when(name.isin(*EMAIL_FIELDS, *PHONE_FIELDS, *ADDRESS_FIELDS, *ID_FIELDS), typed()), prose(w))),
    )
    return F.nullif(verdict, F.lit("ok"))


def trim_labels(c: Column) -> Column:
    """A name without label words, or what has no letter or digit, at either end."""
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")

    def bare(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))

    keep = F.transform(w, lambda x, i: F.when(~(bare(x).isin(*LABELS) | (bare(x) == "")), i))
    first, last = F.array_min(keep), F.array_max(keep)
    return F.when(first.isNotNull(), F.array_join(F.slice(w, first + 1, last - first + 1), " ")).otherwise("")


def verify_records(fields: DataFrame) -> DataFrame:
    """fields with verif (ok, cjk, junk) and reason. The same value of a field is judged once, however many rows have it."""
    name, value, why, state = fresh(fields, "judged_name", "judged_value", "judged_reason", "judged_verif")
    pairs = fields.select(F.col("field_name").alias(name), F.col("value").alias(value)).distinct()
    cjk, found = F.col(value).rlike(r"[぀-ヿ一-鿿가-힯]"), sanity(F.col(name), F.col(value))
    judged = pairs.withColumn(why, found).select(
        name, value, F.when(cjk, F.lit(None)).otherwise(F.col(why)).alias(why), F.when(cjk, "cjk").when(F.col(why).isNotNull(), "junk").otherwise("ok").alias(state)
    )
    same = F.col("field_name").eqNullSafe(F.col(name)) & F.col("value").eqNullSafe(F.col(value))
    return fields.join(judged, same, "left").withColumn("reason", F.col(why)).withColumn("verif", F.col(state)).drop(name, value, why, state)


def verify_stats(verified: DataFrame) -> DataFrame:
    """Counts of each field by verdict."""
    return verified.groupBy("field_name").agg(*(F.count_if(F.col("verif") == v).alias(v) for v in ("ok", "cjk", "junk")))


def verify_reasons(verified: DataFrame, subject: str = "subject") -> DataFrame:
    """Counts by reason over all fields, and by subject and field, as one table: level, subject, field_name, reason, n."""
    junk = verified.where("reason is not null")
    sets = junk.groupingSets([["reason"], [subject, "field_name", "reason"]], subject, "field_name", "reason").agg(F.grouping("field_name").alias("all"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("all") == 1, "reason").otherwise("field").alias("level"), F.col(subject).alias("subject"), "field_name", "reason", "n")


def critical_valid(name: Column, value: Column) -> Column:
    """Shapes of the critical fields; null for others."""
    return (
        F.when(name == "date_of_birth", dob_reliable(value))
        .when(name == "bsb", value.rlike("^[0-9]{3}-[0-9]{3}$"))
        .when(name == "account_number", value.rlike("^[0-9]{6,10}$"))
    )


def flags(pages: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Long table doc_id, page, code of the rules that hold; one pass over the pages for all rules."""
    codes = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())
    return pages.select("doc_id", "page", F.explode(codes).alias("code"))


#: Fields that identify a person, and those that a type of document is expected to have.
IDENTITY_FIELDS = (
    "given_names family_name date_of_birth residential_address mobile_number email_address drivers_licence_number passport_details tax_file_number"
).split()
EXPECTED = {
    "loan_application": ("given_names", "family_name", "date_of_birth"),
    "drivers_licence": ("family_name", "date_of_birth", "drivers_licence_number"),
    "passport": ("family_name", "date_of_birth", "passport_details"),
    "bank_statement": ("account_number", "bsb"),
}


def question_flags(docs: DataFrame, pages: DataFrame, fields: DataFrame, readings: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Long table doc_id, code, page, field_name of what a reviewer should look at.

    docs: doc_id, type, other_type. pages: doc_id, page, kind, degraded. fields: doc_id, page, field_name, value, subject,
    source, confidence, digits_read, alternate, valid. readings: doc_id, page, one, two (texts of two readers).
    """
    none = F.lit(None)

    def rows(frame: DataFrame, rules: dict[str, Column], page: Column, name: Column) -> DataFrame:
        codes = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())
        return frame.select("doc_id", F.explode(codes).alias("code"), page.cast("int").alias("page"), name.cast("string").alias("field_name"))

    out = rows(pages, {"PAGE_DEGRADED": F.col("degraded"), "PAGE_KIND_UNCERTAIN": F.col("kind") == "uncertain"}, F.col("page"), none)
    unsure = F.coalesce(F.col("type"), F.lit("")).isin("", "other", "mixed")
    out = out.unionByName(rows(docs, {"DOC_TYPE_UNSURE": unsure, "DOC_TYPE_DISAGREE": F.coalesce(F.col("other_type"), F.lit("")) != ""}, none, none))
    identity, subject = F.col("field_name").isin(*IDENTITY_FIELDS), F.coalesce(F.col("subject"), F.lit("unknown"))
    each = {
        "SOURCES_DISAGREE": F.coalesce(F.col("alternate"), F.lit("")) != "",
        "DIGITS_NOT_READ": F.col("digits_read") == F.lit(False),
        "LOW_CONFIDENCE": (F.col("source") == "handwriting") & (F.coalesce("confidence", F.lit(1.0)) < least),
        "INVALID_VALUE": F.col("valid") == F.lit(False),
        "OWNER_UNKNOWN": identity & (subject == "unknown"),
    }
    out = out.unionByName(rows(fields, each, F.col("page"), F.col("field_name")))
    own = fields.where(subject.isin("applicant", "unknown")).groupBy("doc_id", "field_name").agg(
        F.count_distinct(F.nullif(F.regexp_replace(F.lower("value"), "[^a-z0-9]", ""), F.lit(""))).alias("n")
    )
    out = out.unionByName(rows(own, {"OWNER_AMBIGUOUS": identity & (F.col("n") > 1)}, none, F.col("field_name")))
    wanted = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in EXPECTED.items() for x in kv))
    missing = docs.select("doc_id", F.explode(wanted[F.col("type")]).alias("field_name")).join(own.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti")
    out = out.unionByName(rows(missing, {"MISSING_EXPECTED": F.lit(True)}, none, F.col("field_name")))
    if readings is not None:
        differ = F.size(F.array_except(digit_runs(F.col("one")), digit_runs(F.col("two")))) + F.size(F.array_except(digit_runs(F.col("two")), digit_runs(F.col("one"))))
        out = out.unionByName(rows(readings, {"READERS_DISAGREE": differ > 0}, F.col("page"), none))
    return out


def digit_runs(text: Column, least: int = 6) -> Column:
    """Numbers of `least` digits or more, blanks and hyphens inside them aside."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9][0-9 -]*[0-9]"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.length(x) >= least))


def park(pages: DataFrame, hits: DataFrame | None = None, sure: float = 0.6, least: int = 40) -> DataFrame:
    """doc_id, park: whether every page is printed, was read with confidence and has text, and no pattern hit the document."""
    every = pages.groupBy("doc_id").agg(
        (F.bool_and(F.col("kind") == "printed") & (F.min("probe_conf") >= sure) & (F.min("alnum") >= least)).alias("park")
    )
    if hits is None:
        return every
    found = hits.select("doc_id").distinct().withColumn("hit", F.lit(True))
    return every.join(found, "doc_id", "left").select("doc_id", (F.col("park") & F.col("hit").isNull()).alias("park"))


#: First bytes of files, in hex, and their kind.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("504B0304", "office"), ("4D5A", "program"))


def sniff(head: Column) -> Column:
    """Kind of a file by its first bytes, else text where 95 percent are printable and 90 percent of the letters Latin, else binary.

    Text is UTF-8, or UTF-16 with a byte order mark; empty without any byte. Any bytes have a kind: a character that is cut off at
    the end doesn't count, other bytes that are no UTF-8 count as characters that can't be printed.
    """
    h = F.hex(head)
    out = F.when(F.length(head) == 0, "empty")
    for magic, kind in MAGIC:
        out = out.when(F.startswith(h, F.lit(magic)), kind)
    little = F.startswith(h, F.lit("FFFE"))
    return out.when(little | F.startswith(h, F.lit("FEFF")), F.when(_wide_text(h, little), "text").otherwise("binary")).when(_narrow_text(head, h), "text").otherwise("binary")


def _narrow_text(head: Column, h: Column) -> Column:
    """Whether bytes read as UTF-8 are text."""
    # the start of a character at the end: a lead byte with fewer bytes after it than it asks for
    cut = F.length(F.regexp_extract(h, "([CD].|E.(?:[89AB].)?|F[0-7](?:[89AB].){0,2})$", 1)) / 2
    text = F.make_valid_utf8(F.substring(head, F.lit(1), (F.length(head) - cut).cast("int")).cast("string"))
    printable = F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]", ""))
    letters, latin = F.length(F.regexp_replace(text, r"\P{L}", "")), F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return (printable >= 0.95 * F.length(text)) & (latin >= 0.9 * letters) & (F.length(text) > 0)


def _wide_text(h: Column, little: Column) -> Column:
    """Whether bytes in hex, with a mark first, are text of UTF-16: 95 percent printable, 90 percent below U+0250. A last odd byte doesn't count."""
    units = F.regexp_extract_all(F.substring(h, F.lit(5), F.length(h) - 4), F.lit("([0-9A-F]{4})"), F.lit(1))
    # the high byte first in both orders
    code = F.transform(units, lambda u: F.conv(F.when(little, F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2))).otherwise(u), 16, 10).cast("int"))
    printable = F.size(F.filter(code, lambda c: ((c >= 32) & (c != 127) & (c != 0xFFFD)) | c.isin(9, 10, 13)))
    latin = F.size(F.filter(code, lambda c: c < 0x250))
    return (F.size(code) > 0) & (printable >= 0.95 * F.size(code)) & (latin >= 0.9 * F.size(code))


def claims_hold(category: Column, kind: Column) -> Column:
    """Whether the bytes are what the extension claims."""
    return F.when(category == "other", False).otherwise(category == kind)


def curation(files: DataFrame) -> DataFrame:
    """files (path, bytes, category, kind, is_blank) with the stage that removes them, if any; the first counts."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stage = (
        F.when(name.rlike(r"^(\.|~\$|Thumbs\.db)|\.(tmp|partial|crdownload)$"), "junk_name")
        .when(F.col("kind") == "program", "junk_type")
        .when(F.col("bytes") < 100, "tiny")
        .when((F.col("category") != "other") & ~claims_hold(F.col("category"), F.col("kind")), "corrupt")
        .when(F.col("category") == "other", "unsupported")
        .when(F.col("is_blank"), "blank")
    )
    return files.withColumn("stage", stage)


#: First bytes, in hex, of files whose extension can be told by them; the offset in bytes, the extension, and others that say the same.
TRUE_EXTENSIONS = (
    ("89504E47", 0, "png", ()),
    ("FFD8FF", 0, "jpg", ("jpeg",)),
    ("424D", 0, "bmp", ()),
    ("49492A00", 0, "tif", ("tiff",)),
    ("4D4D002A", 0, "tif", ("tiff",)),
    ("57454250", 8, "webp", ()),
    ("25504446", 0, "pdf", ()),
    ("7B5C727466", 0, "rtf", ()),
)


def proposed_extension(path: Column, head: Column) -> Column:
    """The extension that a file's first bytes ask for, if it has another one; else null."""
    h, own = F.hex(head), F.ltrim(extension(path), F.lit("."))
    out = F.lit(None).cast("string")
    for magic, at, name, alike in reversed(TRUE_EXTENSIONS):
        here = (F.substring(h, 2 * at + 1, len(magic)) == magic) & (F.startswith(h, F.lit("52494646")) if name == "webp" else F.lit(True))
        out = F.when(here, F.when(~own.isin(name, *alike), name)).otherwise(out)
    return out


def rename_plan(files: DataFrame) -> DataFrame:
    """from, to, reason of files (path, head) whose extension is not that of their content; no two names are the same.

    A file keeps its stem; where the name is taken, by any file of the listing or by an earlier one of the plan, ~1, ~2 and so on follow
    the stem, the least number that is free. Paths are told apart without regard to case, as some file systems do. Files that
    are renamed count as there, so the moves can be made in any order and undone.
    """
    pattern = r"^(.*?)(?:~(\d{1,9}))?(\.[^./]*)?$"

    def parts(path: Column) -> list[Column]:
        number = F.regexp_extract(path, pattern, 2)
        # a number with a leading nought is part of the stem
        odd = number.rlike("^0")
        stem = F.regexp_extract(path, pattern, 1)
        return [F.when(odd, F.concat(stem, F.lit("~"), number)).otherwise(stem), F.when(odd | (number == ""), 0).otherwise(number.cast("int"))]

    listing = files.select("path", "head").dropDuplicates(["path"]).withColumn("new", proposed_extension(F.col("path"), F.col("head"))).drop("head")
    stem, number = parts(F.col("path"))
    rows = listing.select("path", "new", stem.alias("stem"), number.alias("number"), F.ltrim(extension(F.col("path")), F.lit(".")).alias("old"))
    moved = rows.where("new is not null").withColumn("group", F.lower(F.concat_ws(".", "stem", "new")))
    there = rows.select(F.lower(F.concat_ws(".", "stem", "old")).alias("group"), "number").distinct()
    # the first of a group that asks for a number that no file has gets it
    asked = moved.join(there.withColumn("taken", F.lit(True)), ["group", "number"], "left")
    first = F.row_number().over(Window.partitionBy("group", "number").orderBy("path"))
    asked = asked.withColumn("gets", F.col("taken").isNull() & (first == 1)).drop("taken")
    used = there.join(moved.select("group").distinct(), "group", "left_semi").unionByName(asked.where("gets").select("group", "number")).groupBy("group").agg(F.array_sort(F.collect_set("number")).alias("used"))
    # the n-th of the others gets the n-th free number: n - 1 and one more for each used number up to there
    rest = asked.where("not gets").withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("path"))).join(used, "group", "left")
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("n") - 1, lambda k, u: F.when(u <= k, k + 1).otherwise(k))
    named = asked.where("gets").drop("gets").unionByName(rest.withColumn("number", free.cast("int")).select("path", "new", "stem", "number", "old", "group"))
    target = F.concat("stem", F.when(F.col("number") > 0, F.concat(F.lit("~"), F.col("number").cast("string"))).otherwise(""), F.lit("."), "new")
    return named.select(F.col("path").alias("from"), target.alias("to"), F.concat(F.lit("."), F.when(F.col("old") == "", "(none)").otherwise(F.col("old")), F.lit(" -> ."), "new").alias("reason"))


def judge_labels(labels: DataFrame, least: float = 0.85) -> DataFrame:
    """Labels with fails: a photo or blank page without text, surely enough."""
    return labels.withColumn("fails", F.col("kind").isin("photo", "blank") & ~F.col("has_text") & (F.col("confidence") >= least))


def confirmed(judged: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Judged labels of which only those fail that a second look (keys, fails) fails too; without one the first counts."""
    second, mark = again.select(*keys, F.col("fails").alias("again")), F.coalesce("again", F.lit(True))
    return judged.join(second, keys, "left").withColumn("fails", F.col("fails") & mark).drop("again")


def file_keep(judged: DataFrame) -> DataFrame:
    """A file stays if any of its pages has content."""
    return judged.groupBy("file").agg(F.bool_or(~F.col("fails")).alias("keep"))


def page_route(kind: Column, probability: Column, ink: Column) -> Column:
    return F.when(ink < 0.02, "skip").when((kind == "handwritten") | (probability < 0.5), "model").otherwise("print")


def page_estimate(text: Column, per_page: int = 350) -> Column:
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.greatest(F.lit(1), F.ceil(n / per_page)).cast("int")


def any_of(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, rules)


def move_plan(survey: DataFrame, docs: DataFrame, root: str, dest: str, status: str) -> DataFrame:
    """Where to move surveyed files of a status, or why not."""
    joined = survey.join(docs, "id", "left")
    skip = F.when(F.col("path").isNull(), "no_document").when(~F.startswith("path", F.lit(root)), "outside_root").when(F.col("status") != status, "other_status")
    return joined.select("id", "path", F.when(skip.isNull(), F.concat(F.lit(dest), F.substring("path", len(root) + 1, 1 << 20))).alias("target"), skip.alias("skip"))


def restore_plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Moves to undo: the moved file is there and its old place is free."""
    there = listing.select(F.col("path").alias("target"))
    return manifest.where("target is not null").join(there, "target", "left_semi").join(listing.select("path"), "path", "left_anti").select(F.col("target").alias("from"), F.col("path").alias("to"))
