from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from loomwork.operators import verify
from loomwork.sources import readers, writers

SCHEMA = StructType([StructField("file", StringType()), StructField("ok", BooleanType())])


def test_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"file": "a", "ok": true}\nnot json\n{"file": "b", "ok": false}\n')
    good, bad = readers.read_records(spark, str(tmp_path / "log.jsonl"), SCHEMA)
    assert sorted(map(tuple, good.collect())) == [("a", True), ("b", False)]
    assert [r[0] for r in bad.collect()] == ["not json"]


def test_index_and_lists(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"file": "a"}, {"ok": true}]')
    assert [r.file for r in readers.read_index(spark, str(tmp_path / "i.json"), SCHEMA, "file").collect()] == ["a"]
    (tmp_path / "list.txt").write_text("x.pdf\n\ny.exe\nx.pdf\n")
    assert [r.path for r in readers.read_path_list(spark, str(tmp_path / "list.txt"), [".pdf"]).collect()] == ["x.pdf"]
    (tmp_path / "v.csv").write_text("file,ok\na,true\n")
    assert [tuple(r) for r in readers.read_verdicts(spark, str(tmp_path / "v.csv"), SCHEMA).collect()] == [("a", True)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "a" / ".hidden").write_bytes(b"x")
    (tmp_path / "a" / "y.txt").write_bytes(b"plain text")
    files = readers.scan_files(spark, [str(tmp_path / "a")])
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in files.select("path", verify.sniff(F.col("head")).alias("kind")).collect()}
    assert got == {"x.pdf": "pdf", "y.txt": "text"}
    texts = readers.read_texts(spark, str(tmp_path / "a" / "y.txt"), cap=5).first()
    assert (texts.text, texts.truncated) == ("plain", True)


def test_heads_of_large_files(spark, tmp_path):
    """A file beyond what the source of whole files may read has its head all the same, and its content if that is asked for."""
    (tmp_path / "large file%20é.bin").write_bytes(b"%PDF" + bytes(range(256)) * 40)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / ".hidden").write_bytes(b"x" * 9000)
    limit = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "8000")
        rows = readers.scan_files(spark, [str(tmp_path)], large=8000).select("path", "bytes", "head").collect()
    finally:
        spark.conf.set(limit, before)
    got = {r.path.rsplit("/", 1)[1][:5]: (r.bytes, bytes(r.head)) for r in rows}
    assert got == {"large": (10_244, (b"%PDF" + bytes(range(256)) * 40)[:4096]), "small": (3, b"abc")}
    whole = {r.bytes: bytes(r.content) for r in readers.scan_files(spark, [str(tmp_path)], large=8000).collect()}
    assert whole == {10_244: b"%PDF" + bytes(range(256)) * 40, 3: b"abc"}


def test_texts_of_any_character_set(spark, tmp_path):
    body = "Année 漢字 😀 <x>"
    files = {
        "utf8.txt": (body.encode(), body, "UTF-8"),
        "mark.json": (("\ufeff" + body).encode(), body, "UTF-8"),
        "le.xml": (("\ufeff" + body).encode("utf-16-le"), body, "UTF-16LE"),
        "be.txt": (("\ufeff" + body).encode("utf-16-be"), body, "UTF-16BE"),
        "bare_le.txt": ("plain".encode("utf-16-le"), "plain", "UTF-16LE"),
        "latin.txt": ("café".encode("latin-1"), "café", "ISO-8859-1"),
        "odd.txt": (b"\xff\xfea\x00b", "a", "UTF-16LE"),
        "half.txt": (b"\xff\xfea\x00\x3d\xd8b\x00\x00\xdc", "a\ufffdb\ufffd", "UTF-16LE"),
        "empty.txt": (b"", "", "UTF-8"),
        "long.txt": (("é" * 50_000 + "x").encode(), "é" * 50_000 + "x", "UTF-8"),
    }
    for name, (raw, _, _) in files.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "no.bin").write_bytes(b"x")
    for cap in (None, 3, 8, 50_001, 12_500):
        got = {r.path.rsplit("/", 1)[1]: (r.text, r.truncated, r.charset) for r in readers.read_texts(spark, str(tmp_path), cap, [".txt", ".xml", ".json"]).collect()}
        # characters beyond the first plane count once in a text of Spark, as they do in Python
        # Spark's file sources leave out files without any byte
        assert got == {n: (t[:cap], cap is not None and len(t) > cap, c) for n, (raw, t, c) in files.items() if raw}


def test_any_bytes_have_a_kind(spark):
    """Bytes that are no UTF-8, characters cut at the end, UTF-16 of odd length and noise."""
    import random

    noise = random.Random(3).randbytes(4096)
    heads = {
        "cut2": ("é" * 100).encode()[:-1],
        "cut4": b"words " * 30 + "😀".encode()[:3],
        "latin1": ("caf\xe9 " * 40).encode("latin-1"),
        "one_bad": b"plain text " * 40 + b"\xff" + b" and more" * 9,
        "utf16le": "\ufeffHello there".encode("utf-16-le"),
        "utf16be_odd": "\ufeffHello there".encode("utf-16-be") + b"x",
        "utf16_noise": b"\xff\xfe" + noise,
        "utf16_han": "\ufeff漢字漢字".encode("utf-16-le"),
        "lone_surrogate": b"\xff\xfe" + b"\x00\xd8" * 50,
        "mark_only": b"\xff\xfe",
        "noise": noise,
        "lead": b"\xe2",
        "nul": b"abc\x00def" * 10,
        "none": b"",
    }
    rows = spark.createDataFrame(list(heads.items()), "name string, head binary")
    got = {r.name: r.kind for r in rows.select("name", verify.sniff(F.col("head")).alias("kind")).collect()}
    text = {"cut2", "cut4", "one_bad", "utf16le", "utf16be_odd"}
    assert got == {n: "empty" if n == "none" else "text" if n in text else "binary" for n in heads}


def test_scan_of_tables(spark):
    """The registered query computes all of its columns."""
    import __spark_entry__

    got = __spark_entry__.queries()["src1_file_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 14 and all(r.parquet and r.kind == "binary" and r.bytes > 0 for r in got)


def test_guarded_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'say "x"'), (None, "-2")], "`=a` string, b string")
    writers.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["'=a", "b"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("'=1", 'say "x"'), (None, "'-2")], key=repr)


def test_snapshots(spark, tmp_path):
    df = spark.range(3).selectExpr("cast(id as string) as path")
    for kind in ("parquet", "json", "text"):
        writers.write_snapshot(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.json(str(tmp_path / "json")).count() == spark.read.text(str(tmp_path / "text")).count() == 3


def test_metadata(spark):
    rows = spark.createDataFrame([('{"engine": "x", "pages": 3}',), ("broken",), (None,)], "j string")
    assert [tuple(r)[1:] for r in readers.with_metadata(rows, "j").collect()] == [("x", None, 3), (None, None, None), (None, None, None)]
