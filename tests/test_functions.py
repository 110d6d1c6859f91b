import pytest
from pyspark.sql import functions as F

from loomwork.functions import checks, dates, keys, text
from loomwork.operators import extract, merges, verify


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("raw", "key", "reliable"),
    [
        ("24/11/1963", "19631124", True),
        ("24 . 11 . 1963", "19631124", True),
        ("04/05/1963", "04051963", True),
        ("1988-06-14", "19880614", True),
        ("24th Nov 1963", "19631124", True),
        ("November 24, 1963", "19631124", True),
        ("16JUL2019", "20190716", True),
        ("14/06/88", "19880614", True),
        ("28 JUN 84", "19840628", True),
        ("31/02/1980", "31021980", False),
        ("32 Foo 1980", "321980", False),
        ("born long ago", "", False),
        ("", "", False),
        (None, "", False),
    ],
)
def test_dates_of_birth(spark, raw, key, reliable):
    got = spark.createDataFrame([(raw,)], "v string").select(dates.dob_key(F.col("v")), dates.dob_reliable(F.col("v"))).first()
    assert tuple(got) == (key, reliable)


def test_checksums(spark):
    row = spark.sql("select '51 824 753 556' abn, '51 824 753 557' bad, '4111 1111 1111 1111' card, '123 456 782' tfn, '0412 345 678' phone, '+61 412 345 678' world")
    got = row.select(
        checks.abn_valid(F.col("abn")), checks.abn_valid(F.col("bad")), checks.card_valid(F.col("card")), checks.tfn_valid(F.col("tfn")), checks.phone_valid(F.col("phone")), checks.phone_canonical(F.col("world"))
    ).first()
    assert tuple(got) == (True, False, True, True, True, "0412345678")


def test_expiries(spark):
    raw = ["2027-04-30", "2027-04", "04/2027", "4/27", "13/2027", "soon", "", None, "01/2001", "01/2099"]
    got = values(spark, [(v,) for v in raw], "v string", dates.expiry_verdict(F.col("v"), "2024-01", "2034-12"))
    assert got == ["valid"] * 4 + ["malformed"] * 2 + ["absent"] * 2 + ["before_window", "after_window"]


def test_identifiers(spark):
    raw = [("passport", "aus n1234567"), ("passport", "N12/x"), ("licence", "12 345-678"), ("licence", "ABC12345"), ("other", "1")]
    canon = keys.identifier(F.col("v"))
    got = spark.createDataFrame(raw, "k string, v string").select(canon, keys.tier(F.col("k"), canon, F.lit(2))).collect()
    assert [tuple(r) for r in got] == [("N1234567", "triple_checked"), ("N12", "format_fail"), ("12345678", "triple_checked"), ("ABC12345", "format_fail"), ("1", "format_fail")]


def test_sample_bucket(spark):
    import hashlib

    got = values(spark, [("a",), ("b",)], "v string", keys.sample_bucket(F.col("v"), 10_000))
    assert got == [int(hashlib.sha256(v).hexdigest(), 16) % 10_000 for v in (b"a", b"b")]


def test_text(spark):
    got = spark.sql("select \"mary-jane o'NEIL\" n, '=1+1' f, '../x' p, 'assets/a b.png' q").select(
        text.title_case(F.col("n")), text.csv_guard(F.col("f")), text.asset_url(F.col("p")), text.asset_url(F.col("q"))
    )
    assert tuple(got.first()) == ("Mary-Jane O'Neil", "'=1+1", None, "/assets/a%20b.png")


def test_offsets_and_ownership(spark):
    body = "Card 4111 1111 1111 1111, ABN 51 824 753 556, BSB 062-000, call 0412 345 678."
    found = extract.sweep(spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string"))
    for r in found.collect():
        assert body[r.s : r.e] == r.value
    kept = {(r.field_name, r.value) for r in extract.owned(found).collect()}
    assert ("abn", "51 824 753 556") in kept and ("bsb", "062-000") in kept and ("phone", "0412 345 678") in kept
    assert not any(n == "bsb" and v != "062-000" for n, v in kept)


def test_labelled_lines(spark):
    docs = spark.createDataFrame([(1, "Family Name: Doe\nBSB - 062-000\nnothing\nName:")], "doc_id long, text string")
    got = extract.labelled_lines(docs, [("family_name", "family name"), ("bsb", "bsb"), ("name", "name")]).orderBy("line_no").collect()
    assert [(r.field_name, r.value) for r in got] == [("family_name", "Doe"), ("bsb", "062-000")]


def test_sanity(spark):
    rows = [("family_name", "Family Name"), ("family_name", "Doe"), ("family_name", "Doe2"), ("email", "a@b"), ("date_of_birth", "soon"), ("x", "Why?"), ("x", "Please tick")]
    got = values(spark, rows, "n string, v string", verify.sanity(F.col("n"), F.col("v")))
    assert got == ["label", None, "not_a_name", "not_an_email", "not_a_date", "question", "instruction"]


def test_pass_merge_is_the_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(d, "f", p, rng.choice(["", None, "a", "b", "c"]), rng.choice([0.3, 0.6, 0.9])) for d in range(200) for p in range(1, 7)]
    got = {r.doc_id: (r.value, r.confidence) for r in merges.merge_passes(spark.createDataFrame(rows, "doc_id int, field_name string, pass int, value string, confidence double")).collect()}
    for d in range(200):
        value, conf = None, None
        for _, _, _, v, c in (r for r in rows if r[0] == d):
            if v and (not value or c >= 0.60):
                value, conf = v, c
        assert got[d] == (value, conf)


def test_address(spark):
    a = spark.sql("select 'Unit 2, 14 High Street, St Kilda VIC 3182' a").select(extract.address(F.col("a")).alias("a")).first().a
    assert (a.unit, a.number, a.name, a.suburb, a.state, a.postcode, a.coherent) == ("2", "14", "High", "St Kilda", "VIC", "3182", True)


def test_checks_to_the_decisions(spark):
    """A leading zero, the older tax file numbers, issue numbers, lengths of cards, postcodes between the ranges."""
    cases = [
        (checks.abn_valid, "01 824 753 556", False),
        (checks.tfn_valid, "81854402", True),
        (checks.tfn_valid, "81854403", False),
        (checks.medicare_valid, "2123456701", True),
        (checks.medicare_valid, "2123456700", False),
        (checks.card_valid, "411111111116", False),
        (checks.card_valid, "4111 **** **** 1111", True),
        (checks.bsb_valid, "000-000", False),
        (checks.bsb_valid, "001-000", True),
    ]
    for f, value, want in cases:
        assert spark.range(1).select(f(F.lit(value))).first()[0] == want, (f.__name__, value)
    states = {v: spark.range(1).select(checks.postcode_state(F.lit(v))).first()[0] for v in ("0199", "0450", "3000", "20", "0850")}
    assert states == {"0199": None, "0450": "UNKNOWN", "3000": "VIC", "20": None, "0850": "NT"}
    mismatch = [spark.range(1).select(checks.postcode_error(F.lit(v), F.lit(s))).first()[0] for v, s in (("3000", "vic"), ("3000", "NSW"), ("0450", "NSW"), ("0100", "VIC"))]
    assert mismatch == [None, "state_mismatch", None, "zone"]


def test_curation_order(spark):
    rows = [("/a/x.exe", 500, "other", "program", False), ("/a/x.xyz", 500, "other", "text", False), ("/a/x.pdf", 500, "pdf", "text", False), ("/a/x.xyz", 5, "other", "text", False)]
    got = verify.curation(spark.createDataFrame(rows, "path string, bytes int, category string, kind string, is_blank boolean")).collect()
    assert [r.stage for r in got] == ["junk_type", "unsupported", "corrupt", "tiny"]


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("given_names", "(in full)", "label"),
        ("given_names", "or family name Reddy", None),
        ("given_names", "01/JINGYI", "not_a_name"),
        ("drivers_licence", "or Medicare card.", "not_an_id"),
        ("residential_address", "to request your tax file number (TFN)", "not_an_address"),
        ("residential_address", "12 High Street, Richmond", None),
        ("residential_address", "PO Box 12, Richmond", None),
        ("date_of_birth", "Are you an Australian Resident?", "not_a_date"),
        ("date_of_birth", "14 June 1988", None),
        ("mobile_number", "1300 123 456", "not_a_mobile"),
        ("mobile_number", "+61 412 345 678", None),
        ("email_address", "a@b.com", None),
        ("employer_details", "Mr", None),
        ("employer_details", "Email", "label"),
        ("employer_details", "Date of birth", "label"),
        ("employer_details", "you must attach the form", "instruction"),
        ("employer_details", "Smith and Sons Builders", None),
        ("employer_details", ",", "label"),
    ],
)
def test_value_sanity(spark, name, value, want):
    assert values(spark, [(name, value)], "n string, v string", verify.sanity(F.col("n"), F.col("v"))) == [want]


def test_all_shapes_equal_a_plain_version(spark):
    """The library's patterns in Python's engine give the same values."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    extra = [(-1, "Ph (02) 9999 8888, +61 412 345 678, 0412345678; ABN 51824753556 on 14/02/1980; BSB 062-000; $1,234.50 and $99 at 3000 VIC. a.b+c@d-e.com.au 4111-1111-1111-1111 1234")]
    rows = [(r.doc_id, r.text) for r in docs] + extra
    found = extract.values_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, n, m[0]) for i, t in rows if t for n, p, _ in extract.SHAPES for m in re.finditer(p, t, re.ASCII)]
    assert sorted((r.doc_id, r.field_name, r.value) for r in found) == sorted(want)
    assert {n for i, n, _ in want if i == -1} >= {"phone", "abn", "date", "bsb", "currency", "postcode", "email", "card"}


def test_owners_of_digits(spark):
    body = "ABN: 51 824 753 557 then 824 753 and 062-000, card 4111 1111 1111 1111, call 0412 345 678"
    owned = extract.owned(extract.sweep(spark.createDataFrame([(1, body)], "doc_id long, text string")))
    assert sorted((r.field_name, r.value) for r in owned.collect()) == [("abn", "51 824 753 557"), ("bsb", "062-000"), ("bsb", "824 753"), ("card", "4111 1111 1111 1111"), ("phone", "0412 345 678")]


def test_texts_are_swept_once(spark):
    """The owners of digits come from one pass over the texts and one shuffle; values and places are those of a plain version, also beside marks."""
    import random
    import re

    rnd = random.Random(3)
    bits = ["4111 1111 1111 1111", "ABN: ", "51 824 753 556", "51 824 753 557", "062-000", " 3000 ", "0412 345 678", "\x01", "x", ", ", "14/02/1980", "a@b.com", "$1,200", " é\n", "+1 (212) 555-0199", "1.2.3.4", 'key = "v"']
    rows = [(k, "".join(rnd.choices(bits, k=rnd.randrange(14)))) for k in range(300)]
    docs = spark.createDataFrame([*rows, (300, None)], "doc_id long, text string")
    found = extract.sweep(docs)
    every = sorted((i, n, m.start(), m.end(), m[0]) for i, t in rows for n, p, _ in extract.SHAPES for m in re.finditer(p, t, re.ASCII))
    assert sorted((r.doc_id, r.field_name, r.s, r.e, r.value) for r in found.collect()) == every
    valid = {"51 824 753 556"}
    text, want = dict(rows), []
    for i in text:
        mine = [x for x in every if x[0] == i]
        over = lambda x, claims: any(x[2] < c[3] and c[2] < x[3] for c in claims)
        abns = [x for x in mine if x[1] == "abn" and not over(x, [c for c in mine if c[1] == "card"])]
        sure = [x for x in abns if x[4] in valid or re.search(r"(?i)(?<![a-z0-9])abn[^A-Za-z0-9]{0,3}$", text[i][max(0, x[2] - 12) : x[2]])]
        claims = [x for x in mine if x[1] in ("card", "phone", "phone_us")] + sure
        weak = [x for x in mine if x[1] in ("bsb", "postcode")] + [x for x in abns if x not in sure]
        want += [x for x in mine if x[1] not in ("bsb", "postcode", "abn")] + sure + [x for x in weak if not over(x, claims)]
    owned = extract.owned(found)
    assert sorted((r.doc_id, r.field_name, r.s, r.e, r.value) for r in owned.collect()) == sorted(want)
    plan = owned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Except" not in plan


def test_whole_extraction(spark):
    """Labels, priorities and flags of one document; another with nothing; a null text."""
    text = "DOB: 14.02.1980\nIssued 01/01/2020\nBSB: TBC\nbranch code = 062-000\nFull Name: x\nNet salary: $4,000\nABN - 51 824 753 556\n$90,000.00"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = extract.extraction_rows(extract.extract_fields(docs, "2025-06-30"), "2025-06-30").collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.fields["bsb"] == "062-000" and r.fields["date_of_birth"] == "14.02.1980" and r.fields["net_monthly_income"] == "$4,000" and r.fields["gross_annual_income"] == "$90,000.00"
    assert (r.valid_abn, r.valid_bsb, r.valid_dob) == (True, True, True) and r.confidences["abn"] == 1.0


def test_helper_columns_do_not_clash(spark):
    """Operators keep columns that are named like their helpers."""
    from loomwork.operators import joins, match, select, windows

    names = "nth one two claims chosen p3 n3 p2 n2 has".split()
    rows = [(k, "062", 0, 4, *(f"{n}{k}" for n in names)) for k in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "code", "s", "e", *names])
    keys = spark.createDataFrame([(1, "A", "062", "Bank"), (2, "B", "06", "Other")], "doc_id long, value string, prefix string, name string")
    outs = [
        windows.latest(df, ["doc_id"], [F.asc("code")]),
        joins.fallback_match(df, keys.withColumnRenamed("prefix", "code"), "doc_id", "code", "value"),
        joins.drop_overlaps(df, spark.createDataFrame([(9, 0, 1)], "doc_id long, s long, e long")),
        joins.longest_prefix(df, F.col("code"), keys.select("prefix", "name")),
        select.select_ids(df, keys.select("doc_id"), "doc_id"),
    ]
    for out in outs:
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), out.columns
    found = spark.createDataFrame([(1, "f", "v", 1, "x")], "doc_id long, field_name string, value string, line_no int, nth string")
    assert match.choose(found, F.lit(1)).count() == 1


def test_label_keys(spark):
    """Labels are found however their words are parted, in the first words of a line; the first field in order claims it."""
    from loomwork.operators import extract, labels

    assert len(labels.FORM_FIELDS) == 60 == len(set(labels.FORM_FIELDS)) and len(labels.CATALOGUE) == 100 == len({f for f, _ in labels.CATALOGUE})
    lines = ["Date-of_Birth: 01/02/1980", "DateOfBirth = 2", "GIVEN NAME\tAnn", "Driver’s licences: 44", "surname:x", "Surnames - xy", "nothing here: 12", "", ": 77", "Family name of the second applicant's former wife or husband at that time: Bo"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "Surname: " + "é" * 100_000), (5, "dob: 1" + "2" * 9 + "\n" + "x" * 200_000 + ": surname")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.field_name for r in extract.labelled_lines(docs).collect()}
    assert got == {(1, 0): "date_of_birth", (1, 2): "given_names", (1, 3): "drivers_licence", (1, 5): "family_name", (1, 9): "family_name", (4, 0): "family_name", (5, 0): "date_of_birth"}
    own = labels.pack(spark, [("colour", "Colour / Hue"), ("hue", "Hue")])
    found = extract.labelled_lines(spark.createDataFrame([(1, "hue: red")], "doc_id long, text string"), pack=own).collect()
    assert [(r.field_name, r.value) for r in found] == [("colour", "red")]


def test_cost_of_a_line_is_the_same_for_any_pack(spark):
    """The plan has one join for all labels, not an expression for each."""
    from loomwork.operators import extract, labels

    docs = spark.createDataFrame([(1, "a: bc")], "doc_id long, text string")

    def size(n):
        pack = labels.pack(spark, [(f"f{k}", f"Label {k}") for k in range(n)])
        return len(extract.labelled_lines(docs, pack=pack)._jdf.queryExecution().optimizedPlan().toString())

    assert size(500) < size(5) + 200


def test_overlaps_of_very_many_spans(spark):
    """100,000 spans of one document, against a plain sweep; ties, empty spans, nulls and negative places."""
    import bisect
    import random

    from loomwork.operators import joins

    rnd = random.Random(5)

    def drawn(n, size):
        return [(1, a, a + rnd.choice((0, 1, 5, size))) for a in (rnd.randrange(-50, 30 * n) for _ in range(n))]

    matches, claims = drawn(100_000, 40), drawn(50_000, 60) + [(1, 5000, 40_000)]
    order = sorted((s, e) for _, s, e in claims)
    starts, best, most = [s for s, _ in order], [], -(10**9)
    for _, e in order:
        best.append(most := max(most, e))
    free = [m for m in matches if not ((k := bisect.bisect_left(starts, m[2])) and best[k - 1] > m[1])]
    odd = [(None, 1, 9), (2, None, None), (3, 4, 4)]
    table = spark.createDataFrame([(*m, "x") for m in matches + odd], "doc_id long, s long, e long, top string")
    got = joins.drop_overlaps(table, spark.createDataFrame([*claims, (None, 0, 50), (2, 0, 9), (3, None, 5)], "doc_id long, s long, e long"))
    assert got.columns == ["doc_id", "s", "e", "top"]
    assert sorted(((r.doc_id, r.s, r.e) for r in got.collect()), key=repr) == sorted(free + odd, key=repr)


def test_written_index(spark, tmp_path):
    """Lookups equal a search of the texts, and read one folder for each term and no other."""
    from loomwork.operators import index

    rows = [(k, f"word{k % 7} common x{k}", f"owner{k % 3}" if k % 4 else None) for k in range(500)] + [(None, "common word1", ""), (7, None, "common")]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string")
    path = str(tmp_path / "index")
    index.write_index(df, "doc_id", ["text", "owner"], path, buckets=32)
    got = {r.key for r in index.find_in(spark, path, ["Common", "word1"], ["text"], buckets=32).collect()}
    assert got == {k for k, t, _ in rows if t and {"common", "word1"} <= set(t.split())}
    assert {r.key for r in index.find_in(spark, path, ["common", "owner2"], buckets=32).collect()} == {k for k, t, o in rows if o == "owner2" and t} and index.find_in(spark, path, ["none"], buckets=32).count() == 0
    found = index.lookup(spark, path, ["word1"], buckets=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(token_bucket" in plan or "token_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(token,word1)" in plan or "In(token, [word1])" in plan
    files = found.select(F.input_file_name().alias("file")).distinct().collect()
    assert len({r.file.split("token_bucket=")[1].split("/")[0] for r in files}) == 1


def test_renames(spark):
    """No two names are the same, in any case of letters, nor one that is there; the inverse restores every name."""
    png, pdf = b"\x89PNG....", b"%PDF-1.7"
    files = {"/a/x.txt": png, "/a/x.pdf": png, "/a/X.png": png, "/a/x~1.gif": png, "/a/x~2.png": b"text", "/a/y": pdf, "/a/y.pdf": b"no", "/a/ok.jpeg": b"\xff\xd8\xff\xe0", "/a/w": b"RIFF....WEBPVP8", "/a/r": b"RIFF....WAVE", "/b.c/z": png, "/a/.h": png, "/a/none": b"", "/a/null": None, "/a/q~01.x": png}
    df = spark.createDataFrame([(p, bytearray(h) if h is not None else None, "x") for p, h in files.items()], "path string, head binary, number string")
    got = {r["from"]: r["to"] for r in verify.rename_plan(df).collect()}
    assert set(got) == {"/a/x.txt", "/a/x.pdf", "/a/x~1.gif", "/a/y", "/a/w", "/b.c/z", "/a/.h", "/a/q~01.x"}
    assert got["/a/x~1.gif"] == "/a/x~1.png" and got["/a/y"] == "/a/y~1.pdf" and got["/b.c/z"] == "/b.c/z.png" and got["/a/q~01.x"] == "/a/q~01.png"
    assert sorted((got["/a/x.txt"], got["/a/x.pdf"])) == ["/a/x~3.png", "/a/x~4.png"]
    after = [*(set(files) - set(got)), *got.values()]
    assert len({x.lower() for x in after}) == len(files)
    plan = spark.createDataFrame(list(got.items()), "path string, target string")
    back = {r["from"]: r["to"] for r in verify.restore_plan(plan, spark.createDataFrame([(x,) for x in after], "path string")).collect()}
    assert {back.get(x, x) for x in after} == set(files)
    assert verify.rename_plan(df.limit(0)).count() == 0
