"""Extraction of typed fields from document texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import checks
from loomwork.functions.names import fresh
from loomwork.operators.labels import form_pack, labelled

#: Shapes of the sweep (name, Java pattern, confidence), from the public forms of the values.
SHAPES = [
    ("email", r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\b", 0.98),
    # after 0, 61 or +61: a mobile number, 4 and two, three and three digits, or an area's digit and twice four
    ("phone", r"(?<![\d+])(?:\+61[ -]?|61 |\(?0)(?:4\d{2}[ -]?\d{3}[ -]?\d{3}|[2378]\)?[ -]?\d{4}[ -]?\d{4})(?!\d)", 0.95),
    ("phone_us", r"\+1 \([0-9]{3}\) 555-[0-9]{4}", 0.95),
    # four times four digits, parted alike
    ("card", r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)", 0.90),
    ("abn", r"(?<!\d)\d{2}(?: ?\d{3}){3}(?!\d)", 1.0),
    ("bsb", r"(?<![\d-])\d{3}[ -]\d{3}(?![\d-])", 0.55),
    ("postcode", r"(?<![\w$.,/-])(?!0[01])\d{4}(?![\w,@-])", 0.50),
    ("date", r"(?<!\d)\d{1,2}([/.-])\d{1,2}\1\d{4}(?!\d)", 0.85),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", 0.90),
    ("secret", r'\b[a-z_]+ = "[^"]+"', 0.80),
    ("currency", r"\$ ?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{2})?(?![\d,])", 0.80),
]
SHAPE = {name: pattern for name, pattern, _ in SHAPES}
#: What a text must hold for a pattern to match, as this is found out much faster: a piece of text, or a digit.
NEEDS = {SHAPE["email"]: "@", SHAPE["phone_us"]: "555-", SHAPE["secret"]: ' = "', SHAPE["currency"]: "$"} | {SHAPE[n]: r"\d" for n in ("phone", "card", "abn", "bsb", "postcode", "date", "ipv4")}
#: Characters before a match that are kept with it.
BEFORE = 30


#: Stands around matches; texts that hold it are split by the pattern itself.
MARK = "\x01"


def parts(text: Column, pattern: str) -> Column:
    """A text as an array of the pieces between the matches of a pattern and the matches, in turn: one pass of the pattern."""
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    turns = F.flatten(F.zip_with(pieces, values, lambda p, v: F.array(p, v)))
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(F.contains(text, F.lit(MARK)), F.slice(turns, 1, F.lit(2) * F.size(values) + 1)).otherwise(marked)


def places(turns: Column) -> Column:
    """Matches among `parts` as an array of (s, e, value), offsets from 0; no built-in tells offsets, so they are running sums."""
    none = F.array().cast("array<struct<s:int,e:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))

    def step(a, x):
        e = a["at"] + F.length(x)
        own = F.array(F.struct(a["at"].alias("s"), e.alias("e"), x.alias("value")))
        return F.struct(e.alias("at"), (~a["match"]).alias("match"), F.when(a["match"], F.concat(a["out"], own)).otherwise(a["out"]).alias("out"))

    return F.when(F.size(turns) > 1, F.aggregate(turns, start, step)["out"]).otherwise(none)


def when_needed(text: Column, pattern: str, digit: Column, made: Column, none: Column) -> Column:
    """made if the text has what the pattern needs, else none."""
    need = NEEDS.get(pattern)
    if need is None:
        return made
    return F.when(digit if need == r"\d" else F.contains(text, F.lit(need)), made).otherwise(none)


def matched(docs: DataFrame, shapes) -> tuple[DataFrame, list[str]]:
    """doc_id, text and the `parts` of texts, which aren't null, by each shape, and the names of these columns.

    A pattern runs over the texts that have what it needs, and once for a text, as its parts are a column.
    """
    names, text = [f"match_{k}" for k in range(len(shapes))], F.col("text")
    rows = docs.where("text is not null").select("doc_id", "text", text.rlike("[0-9]").alias("digit"))
    every = (when_needed(text, p, F.col("digit"), parts(text, p), F.array(F.lit(""))).alias(n) for n, (_, p, _) in zip(names, shapes, strict=True))
    return rows.select("doc_id", "text", *every), names


def values_of(docs: DataFrame, shapes=SHAPES) -> DataFrame:
    """doc_id, field_name, value, confidence of every match of every shape: one pass of each pattern, as no place is asked for."""
    text = F.col("text")

    def named(name: str, pattern: str, confidence: float) -> Column:
        values = when_needed(text, pattern, F.col("digit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("field_name"), v.alias("value"), F.lit(confidence).alias("confidence")))

    every = F.concat(*(named(*shape) for shape in shapes))
    rows = docs.where("text is not null").select("doc_id", "text", text.rlike("[0-9]").alias("digit"))
    return rows.select("doc_id", F.explode(every).alias("m")).select("doc_id", "m.*")


def sweep(docs: DataFrame, shapes=SHAPES) -> DataFrame:
    """doc_id, field_name, s, e, value, confidence, before (up to BEFORE characters) of every match of every shape.

    One pass over the texts: the shapes are columns of one projection, not copies of the rows.
    """

    def named(column: str, name: str, confidence: float) -> Column:
        return F.transform(
            places(F.col(column)),
            lambda m: F.struct(F.lit(name).alias("field_name"), m["s"].alias("s"), m["e"].alias("e"), m["value"].alias("value"), F.lit(confidence).alias("confidence"), ahead(F.col("text"), m["s"], BEFORE).alias("before")),
        )

    rows, columns = matched(docs, shapes)
    every = F.concat(*(named(c, n, q) for c, (n, _, q) in zip(columns, shapes, strict=True)))
    return rows.select("doc_id", F.explode(every).alias("m")).select("doc_id", "m.*")


def ahead(text: Column, s: Column, n: int) -> Column:
    """Up to n characters right before place s."""
    return F.substring(text, F.greatest(F.lit(1), s - n + 1), F.least(s, F.lit(n)))


def near_label(text: Column, s: Column, label: str, before: int) -> Column:
    """Whether a label ends right before place s, within `before` characters."""
    return F.substring(text, F.greatest(F.lit(1), s - before + 1), F.least(s, F.lit(before))).rlike(f"(?i)(?:{label})\\W{{0,12}}$")


#: Words that label a business number, a branch number and a date of birth.
ABN_WORDS, BSB_WORDS, DOB_WORDS = ("abn",), ("bsb", "branch"), ("dob", "birth", "born")


def words_before(before: Column) -> Column:
    """Lower-case words of what stands before a value; dots inside abbreviations are dropped.

    Labels before a value are told by words, because the characters before it are cut at a fixed number: a pattern would also match in a
    word whose beginning is cut off, and would have to spell out each way of writing A.B.N.
    """
    return F.filter(F.split(F.replace(F.lower(before), F.lit("."), F.lit("")), "[^a-z0-9]+"), lambda x: x != "")


def ends_with(before: Column, words: tuple[str, ...], gap: int) -> Column:
    """Whether the last word is one of these, with at most `gap` other characters after it."""
    rest = F.length(before) - F.length(F.regexp_replace(before, "[^A-Za-z0-9]+$", ""))
    return F.coalesce(F.try_element_at(words_before(before), F.lit(-1)).isin(*words) & (rest <= gap), F.lit(False))


def mentions(before: Column, words: tuple[str, ...]) -> Column:
    return F.exists(words_before(before), lambda x: x.isin(*words))


def owned(matches: DataFrame) -> DataFrame:
    """Matches without those that lie in a stronger identifier.

    Cards, phones and business numbers that are valid or labelled own their digits; a card's digits are no business number.
    Two sweeps over a document's matches (see joins.drop_overlaps): a match is at its start in a sweep that takes it for a claim, at its
    end in one that asks whether it overlaps one. The matches are made once and shuffled once, by doc_id.
    """
    name = F.col("field_name")
    first, second, own = fresh(matches, "card_end", "claim_end", "sure")

    def taken(rows: DataFrame, claim: Column, end: str) -> tuple[DataFrame, Column]:
        """rows with the greatest end of the claims that start before theirs, and whether one overlaps them."""
        placed = claim & F.col("s").isNotNull() & F.col("e").isNotNull()
        order = F.when(claim, F.col("s")).otherwise(F.col("e")), claim.cast("int")
        before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(end, F.max(F.when(placed, F.col("e"))).over(before)), F.coalesce(F.col("doc_id").isNotNull() & (F.col(end) > F.col("s")), F.lit(False))

    card, abn = name == "card", name == "abn"
    rows, clash = taken(matches.where(name.isNotNull()), card, first)
    sure = abn & F.coalesce(checks.abn_valid(F.col("value")) | ends_with(F.expr("right(before, 12)"), ABN_WORDS, 3), F.lit(False))
    rows = rows.where(~abn | ~clash).withColumn(own, sure)
    rows, clash = taken(rows, name.isin("card", "phone", "phone_us") | F.col(own), second)
    weak = name.isin("bsb", "postcode") | (abn & ~F.col(own))
    return rows.where(~weak | ~clash).select(*matches.columns)


SEPARATED = r"^([^:\t=-]*)[:\t=-](.*)$"
#: Confidence of a line that the readers don't know.
UNREAD = 0.75


def validators(as_of: str) -> dict[str, Callable[[Column], Column]]:
    """Checks that a labelled value must pass to count, by field."""
    return {
        "bsb": checks.bsb_valid,
        "abn": checks.abn_valid,
        "mobile_number": checks.phone_valid,
        "date_of_birth": lambda v: checks.dob_error(v, F.lit(as_of).cast("date")).isNull(),
        "postcode": lambda v: checks.postcode_error(v).isNull(),
    }


def labelled_lines(
    docs: DataFrame,
    patterns: list[tuple[str, str]] | None = None,
    confidence: float = 0.95,
    valid: dict[str, Callable[[Column], Column]] | None = None,
    readings: DataFrame | None = None,
    pack: DataFrame | None = None,
) -> DataFrame:
    """doc_id, line_no, field_name, label, value, confidence of lines `label: value`.

    The first field in order that a line with a value of two characters or more has a label of claims it: by the labels of a
    pack (see labels.pack; those of forms unless given), joined to the runs of its first words, or by patterns that occur in it. If the
    value fails the field's check, the line says nothing. With a pack, equal lines of one doc_id and number count once. Text has one confidence, or with readings (doc_id, line,
    confidence; see line_confidence) that of its line, and UNREAD where there is none.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.trim("line")
    lines = lines.select("doc_id", "line_no", line.alias("line"), F.regexp_extract(line, SEPARATED, 1).alias("label"), F.trim(F.regexp_extract(line, SEPARATED, 2)).alias("value"))
    # lines without a value are gone before labels are looked for
    lines = lines.where(F.length("value") > 1)
    if patterns is None:
        named = labelled(lines, form_pack(docs.sparkSession) if pack is None else pack)
        out = named.groupBy(*lines.columns).agg(F.min_by("field_name", "rank").alias("field_name"))
    else:
        name = F.lit(None).cast("string")
        for field, pattern in reversed(patterns):
            name = F.when(F.col("line").rlike(f"(?i){pattern}"), field).otherwise(name)
        out = lines.withColumn("field_name", name).where("field_name is not null")
    for field, check in (valid or {}).items():
        out = out.where((F.col("field_name") != field) | F.coalesce(check(F.col("value")), F.lit(False)))
    if readings is None:
        known = out.withColumn("confidence", F.lit(confidence))
    else:
        said = readings.select("doc_id", F.col("line").alias("read"), "confidence")
        same = F.trim(F.regexp_replace("line", r"\s+", " ")) == F.col("read")
        known = out.join(said, (out["doc_id"] == said["doc_id"]) & same, "left").select(out["*"], F.coalesce("confidence", F.lit(UNREAD)).alias("confidence"))
    return known.select("doc_id", "line_no", "field_name", "label", "value", "confidence")


def _apart(m: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda c: (m["s"] < c["e"]) & (c["s"] < m["e"]))


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))["value"]


def primary_values(docs: DataFrame, as_of: str) -> DataFrame:
    """doc_id, field_name, value, confidence of the identifiers that a text holds, labelled or not; no shuffle.

    The first valid business number outside cards; the first valid branch number outside stronger identifiers, those
    after a label first; the first plausible date right after a label of birth; the first phone number and e-mail.
    """
    text, day = F.col("text"), F.lit(as_of).cast("date")

    shapes = [s for s in SHAPES if s[0] in ("card", "abn", "phone", "bsb", "date")]
    rows, columns = matched(docs, shapes)
    email = F.when(F.contains("text", F.lit("@")), F.regexp_extract("text", SHAPE["email"], 0)).otherwise("")
    spans = rows.select("doc_id", "text", *(places(F.col(c)).alias(n) for c, (n, _, _) in zip(columns, shapes, strict=True)), email.alias("email"))
    spans = spans.withColumn("abn", F.filter("abn", lambda m: _apart(m, F.col("card"))))
    # columns of their own, as they are used more than once
    spans = spans.withColumn("valid_abn", F.filter("abn", lambda m: checks.abn_valid(m["value"])))
    valid_abn = F.col("valid_abn")
    labelled_abn = F.filter("abn", lambda m: ends_with(ahead(text, m["s"], 12), ABN_WORDS, 3))
    spans = spans.withColumn("claims", F.concat(valid_abn, labelled_abn, "phone", "card"))
    spans = spans.withColumn("bsb", F.filter("bsb", lambda m: _apart(m, F.col("claims")) & checks.bsb_valid(m["value"])))
    spans = spans.withColumn("anchored", F.filter("bsb", lambda m: mentions(ahead(text, m["s"], 30), BSB_WORDS)))
    anchored = F.col("anchored")
    born = F.filter("date", lambda m: ends_with(ahead(text, m["s"], 24), DOB_WORDS, 12) & checks.dob_error(m["value"], day).isNull())

    def row(name: str, value: Column, confidence: Column | float) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(name).alias("field_name"), F.nullif(value, F.lit("")).alias("value"), c.alias("confidence"))

    every = F.array(
        row("abn", _first(valid_abn), 1.0),
        row("bsb", F.coalesce(_first(anchored), _first(F.col("bsb"))), F.when(F.size(anchored) > 0, 0.95).otherwise(0.55)),
        row("date_of_birth", F.translate(_first(born), ".-", "//"), 0.85),
        row("mobile_number", _first(F.col("phone")), 0.95),
        row("email_address", F.col("email"), 0.98),
    )
    return spans.select("doc_id", F.explode(F.filter(every, lambda x: x["value"].isNotNull())).alias("f")).select("doc_id", "f.*")


def income_values(docs: DataFrame) -> DataFrame:
    """doc_id, field_name, value, confidence: the largest amount if over 30,000 as gross, the second as net income."""
    amounts = F.transform(F.regexp_extract_all("text", F.lit(SHAPE["currency"]), F.lit(0)), lambda v: F.translate(v, "$, ", "").cast("double"))
    top = F.sort_array(amounts, asc=False)

    def row(name: str, k: int, confidence: float) -> Column:
        v = F.try_element_at(F.col("top"), F.lit(k))
        return F.struct(F.lit(name).alias("field_name"), v.alias("amount"), F.lit(confidence).alias("confidence"))

    rows = F.array(row("gross_annual_income", 1, 0.88), row("net_monthly_income", 2, 0.84))
    kept = F.filter(rows, lambda r: r["amount"].isNotNull() & ((r["field_name"] != "gross_annual_income") | (r["amount"] > 30_000)))
    return (
        docs.where("text is not null")
        .select("doc_id", top.alias("top"))
        .where(F.size("top") > 0)
        .select("doc_id", F.explode(kept).alias("f"))
        .select("doc_id", "f.field_name", F.concat(F.lit("$"), F.format_number("f.amount", 2)).alias("value"), "f.confidence")
    )


def extract_fields(docs: DataFrame, as_of: str, readings: DataFrame | None = None) -> DataFrame:
    """The whole extraction: doc_id, field_name, value, confidence, one row for each field of a document.

    Identifiers and labelled lines compete by confidence, the earlier one first on ties; amounts fill what is left.
    One shuffle, on document and field.
    """
    sources = [
        primary_values(docs, as_of).selectExpr("*", "1 as rank", "-1 as line_no"),
        labelled_lines(docs, valid=validators(as_of), readings=readings).selectExpr("doc_id", "field_name", "value", "confidence", "1 as rank", "line_no"),
        income_values(docs).selectExpr("*", "0 as rank", "-1 as line_no"),
    ]
    every = sources[0].unionByName(sources[1]).unionByName(sources[2])
    order = F.struct("rank", "confidence", (-F.col("line_no")).alias("place"))
    return every.groupBy("doc_id", "field_name").agg(F.max_by("value", order).alias("value"), F.max_by("confidence", order).alias("confidence"))


def extraction_rows(fields: DataFrame, as_of: str) -> DataFrame:
    """One row for each document: doc_id, fields and confidences (maps), valid_abn, valid_bsb, valid_dob."""
    both = F.collect_list(F.struct("field_name", "value", "confidence"))
    rows = fields.groupBy("doc_id").agg(F.array_sort(both).alias("f"))

    def mapped(column: str) -> Column:
        return F.map_from_arrays(F.transform("f", lambda x: x["field_name"]), F.transform("f", lambda x: x[column]))

    def holds(field: str, rule: Callable[[Column], Column]) -> Column:
        value = F.col("fields")[field]
        return F.coalesce(rule(value), F.lit(False))

    rules = validators(as_of)
    return rows.select("doc_id", mapped("value").alias("fields"), mapped("confidence").alias("confidences")).select(
        "*", holds("abn", rules["abn"]).alias("valid_abn"), holds("bsb", rules["bsb"]).alias("valid_bsb"), holds("date_of_birth", rules["date_of_birth"]).alias("valid_dob")
    )


def bind_currency(matches: DataFrame) -> DataFrame:
    """Two largest amounts of a document: gross income if over 30,000, then net income."""
    amount = F.regexp_replace("value", "[$, ]", "").cast("double")
    top = matches.where("field_name = 'currency'").groupBy("doc_id").agg(F.max(amount).alias("gross"), F.collect_set(amount).alias("all"))
    second = F.try_element_at(F.sort_array("all", asc=False), F.lit(2))
    return top.select("doc_id", F.when(F.col("gross") > 30_000, F.col("gross")).alias("gross"), second.alias("net"))


def wide(matches: DataFrame, names: list[str]) -> DataFrame:
    """One row for each document: the first match of each field, and whether checksums pass."""
    first = matches.groupBy("doc_id").pivot("field_name", names).agg(F.min_by("value", "s"))
    out = first
    if "card" in names:
        out = out.withColumn("card_ok", checks.card_valid(F.col("card")))
    if "abn" in names:
        out = out.withColumn("abn_ok", checks.abn_valid(F.col("abn")))
    return out


#: A label that begins inside a line, after two blanks or more or a bar: words, then a colon.
NEXT_LABEL = r"(?:\s{2,}|\s*\|\s*)[A-Z][A-Za-z' ]{1,30}:.*$"


def clean_value(kind: Column, value: Column) -> Column:
    """The value without an inline next label and trailing punctuation; e-mails, dates, amounts and phones cut to their shape."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), NEXT_LABEL, ""), r"[\s,;:.]+$", "")
    shaped = {
        "email": r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}",
        "date": r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}",
        "currency": r"\$?[0-9][0-9,]*(?:\.[0-9]{2})?",
        "phone": r"\+?[0-9(][0-9() -]{6,}[0-9]",
    }
    out = bare
    for k, p in shaped.items():
        out = F.when((kind == k) & bare.rlike(p), F.regexp_extract(bare, p, 0)).otherwise(out)
    return out


#: Letters that are read for digits, and the digits.
MISREAD, MEANT = "OoQIli|SB", "000111158"


def repaired_abn(value: Column) -> Column:
    """The value, or its reading with letters taken for digits, if that passes the checksum and has six real digits."""
    fixed = F.translate(value, MISREAD, MEANT)
    real = F.length(F.regexp_replace(value, r"\D", ""))
    return F.when(checks.abn_valid(value), checks.digits(value)).when((real >= 6) & checks.abn_valid(fixed), checks.digits(fixed))


def choose_abn(matches: DataFrame) -> DataFrame:
    """doc_id, abn: of a document's candidates (doc_id, s, value, before) the best, a checksum counting 100 and a label 50.

    The first one on ties; a candidate without either is none, and repaired readings count as their digits.
    """
    digits = repaired_abn(F.col("value"))
    score = F.when(digits.isNotNull(), 100).otherwise(0) + F.when(mentions(F.col("before"), ABN_WORDS) | F.array_join(words_before(F.col("before")), " ").contains("business number"), 50).otherwise(0)
    scored = matches.select("doc_id", "s", F.coalesce(digits, checks.digits(F.col("value"))).alias("abn"), score.alias("score")).where("score > 0")
    best = F.struct("score", (-F.col("s")).alias("place"))
    return scored.groupBy("doc_id").agg(F.max_by("abn", best).alias("abn"), F.max("score").alias("score"))


def word_hits(docs: DataFrame, words: list[str], name: str | None = None) -> DataFrame:
    """doc_id, word, n for the words that occur in the text, and in the file name where a column holds it."""

    def count(w: str) -> Column:
        found = [F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"\b{w}\b")) for c in (F.col("text"), *([F.translate(F.col(name), "_-.", "   ")] if name else []))]
        return sum(found[1:], found[0])

    counts = F.array(*(F.struct(F.lit(w).alias("word"), count(w).alias("n")) for w in words))
    return docs.select("doc_id", F.explode(counts).alias("h")).where("h.n > 0").select("doc_id", "h.word", "h.n")


def pattern_names(text: Column, shapes=SHAPES) -> Column:
    """Names of the shapes that occur, in order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p, _ in shapes)), lambda x: x.isNotNull())


def assemble_pages(pages: DataFrame, sep: str = "\n") -> DataFrame:
    """Text of each document from its pages in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(F.array_join(ordered, sep).alias("text"))


def line_confidence(readings: DataFrame, native: DataFrame | None = None, exact: float = 0.95) -> DataFrame:
    """Best confidence of each line of a document, white space aside; lines of native text that no reading has are exact."""

    def lines(frame: DataFrame) -> DataFrame:
        return frame.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))

    read = lines(readings).groupBy("doc_id", "line").agg(F.max("confidence").alias("confidence"))
    if native is None:
        return read
    own = lines(native).select("doc_id", "line").where("line <> ''").distinct()
    return read.unionByName(own.join(read, ["doc_id", "line"], "left_anti").withColumn("confidence", F.lit(exact)))


def digits_read(value: Column, text: Column) -> Column:
    """Whether the digits of a value occur among the page's; null with fewer than four."""
    d = checks.digits(value)
    return F.when(F.length(d) >= 4, F.contains(checks.digits(text), d))


def score_after_heading(docs: DataFrame, heading: str, low: int = 200, high: int = 1200, siblings: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, others: the first number in range within 40 characters after a heading, and the scores of sibling headings.

    A number with a sibling's heading between the heading and itself is the sibling's.
    """
    between = r"(?:(?!" + "|".join(siblings) + r")\W|(?!" + "|".join(siblings) + r")[A-Za-z]){0,40}?" if siblings else r"\W{0,40}?"
    value = F.regexp_extract("text", rf"(?is){heading}{between}(?<![0-9])([0-9]{{3,4}})\b", 1)
    number = F.when(value != "", value.cast("int"))

    def other(name: str) -> Column:
        v = F.regexp_extract("text", rf"(?is){name}\W{{0,40}}?([0-9]{{3,4}})\b", 1)
        return F.struct(F.lit(name).alias("heading"), F.when(v != "", v.cast("int")).alias("score"))

    found = F.filter(F.array(*map(other, siblings)), lambda x: x["score"].between(low, high)) if siblings else F.array().cast("array<struct<heading:string,score:int>>")
    return docs.select("doc_id", F.when(number.between(low, high), number).alias("score"), found.alias("others"))


def flatten_extract(records: DataFrame) -> DataFrame:
    """Nested results (doc_id, applicant map, others array) as rows: doc_id, subject, entry, field_name, value.

    Values may be structs (value, evidence, page); then these are columns too. `checked_extract` tells whether digits were read.
    """
    own = records.select("doc_id", F.lit("applicant").alias("subject"), F.lit(1).alias("entry"), F.explode("applicant").alias("field_name", "value"))
    rest = records.select("doc_id", F.posexplode("others").alias("pos", "p")).select(
        "doc_id", F.col("p.relationship").alias("subject"), "pos", F.explode("p.fields").alias("field_name", "value")
    )
    entry = F.dense_rank().over(Window.partitionBy("doc_id", "subject").orderBy("pos"))
    out = own.unionByName(rest.withColumn("entry", entry).drop("pos"))
    return out.select("doc_id", "subject", "entry", "field_name", "value.*") if out.schema["value"].dataType.typeName() == "struct" else out


def checked_extract(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Flattened rows (doc_id, page, value, ...) with digits_read and confidence: 0.35 with digits that no reader has, 0.85 with digits
    that one has, 0.7 with too few to tell. pages: doc_id, page, text."""
    joined = rows.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    read = digits_read(F.col("value"), F.coalesce("text", F.lit("")))
    return joined.withColumn("digits_read", read).withColumn("confidence", F.when(read, 0.85).when(~read, 0.35).otherwise(0.7)).drop("text")


#: Street types and states of an address.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Lane|Crescent|Way|Terrace|Parade"
STATES = "NSW|VIC|QLD|SA|WA|TAS|ACT|NT"


def address(c: Column) -> Column:
    """unit, number, name, type, suburb, state, postcode, and whether state and postcode agree."""
    p = rf"(?i)^(?:(?:unit\s*)?([0-9A-Z]+)\s*[/,]\s*)?([0-9]+[A-Z]?)\s+(.+?)\s+({STREETS})\b[,\s]+(.+?)[,\s]+({STATES})\s+([0-9]{{4}})$"
    names = ("unit", "number", "name", "type", "suburb", "state", "postcode")
    parts = [F.nullif(F.regexp_extract(F.trim(c), p, k + 1), F.lit("")) for k in range(7)]
    state, code = F.upper(parts[5]), parts[6]
    return F.struct(*(x.alias(n) for n, x in zip(names, parts, strict=True)), (checks.postcode_state(code) == state).alias("coherent"))
