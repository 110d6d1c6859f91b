"""Edge cases of the operators over pages, and damaged archives."""

import random
import zlib

import brute
import pytest

from loomwork.llm import html, warc

SCHEMA = "page_id long, url string, html string, payload string, kind string"


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "equal " * 40 + "</p>"
    rows = [(5, "http://a/ b\r\nX: y", body), (2, "http://b", body), (2, "http://b", body), (None, None, body), (7, "u", None), (8, "u", ""), (9, "u", "é" * 49), (10, "u", "é" * 49), (11, None, "z" * 100)]
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def test_round_trip(spark, pages):
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(pages).collect())
    n = len("<p>" + "equal " * 40 + "</p>")
    assert got == sorted(
        [(5, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (0, n, "revisit", 2), (7, 0, "response", None), (8, 0, "response", None), (9, 98, "response", None), (10, 98, "response", None), (11, 100, "response", None)],
        key=lambda r: r,
    ) if all(x[3] is None or x[3] for x in got) else False
    assert warc.report(pages.limit(0)).count() == 0


def test_digests(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import hashlib

    want = {r.page_id: hashlib.sha256((r.html or "").encode()).hexdigest() for r in rows.collect()}
    assert {r.page_id: r.payload_digest for r in warc.report(rows).collect()} == want


def records(n=6, plain=False):
    out = []
    for k in range(n):
        payload = f"payload {k} ".encode() * 20
        data = warc.record(str(k), f"http://x/{k}", payload, __import__("hashlib").sha256(payload).hexdigest(), "response", None)
        out.append(data if plain else warc.member(data))
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    parts = records(plain=plain)
    whole = (b"" if plain else b"\x00").join(parts)
    assert [h["warc-record-id"] for *_, h, _ in warc.salvage(whole)] == [f"<{warc.URN}{k}>" for k in range(6)]
    rng = random.Random(7)
    for _ in range(60):
        k = rng.randrange(6)
        broken = bytearray(parts[k])
        kind = rng.randrange(3)
        if kind == 0:
            at = rng.randrange(len(broken))
            broken[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del broken[rng.randrange(len(broken)) :]
        else:
            broken = bytearray(b"\x1f\x8b\x08 WARC/1.1\r\nnoise") + broken
        data = b"".join([*parts[:k], bytes(broken), *parts[k + 1 :]])
        found = list(warc.salvage(data))
        good = [h["warc-record-id"] for _, _, why, h, _ in found if why is None]
        others = [f"<{warc.URN}{j}>" for j in range(6) if j != k]
        assert [g for g in good if g in others] == others
        ends = [(s, e) for s, e, *_ in found]
        assert all(a[1] <= b[0] for a, b in zip(ends[:-1], ends[1:], strict=True)) and ends[-1][1] <= len(data)
        if len(good) < 6:
            assert any(why for _, _, why, _, _ in found) or not broken


def test_gaps_are_rows(spark, tmp_path):
    parts = records()
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + b"garbage" + parts[1][:-9] + parts[2])
    got = warc.read(spark, str(tmp_path)).collect()
    assert [r.kind for r in sorted(got, key=lambda r: r.start)] == ["record", "gap", "record"]
    assert zlib.decompress(parts[2], 31).startswith(b"WARC/1.1")


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Records fill files up to the bound, one that is larger has a file of its own, and all come back."""
    rng = random.Random(1)
    rows = [(k, f"http://x/{k}", "".join(chr(33 + rng.randrange(90)) for _ in range(4000 if k != 7 else 90_000))) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write(pages, str(tmp_path / "w"), file_bytes=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 8 and sorted(s > 20_001 for s in sizes)[-2:] == [False, True]
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in got} == {"record"} and {r.payload.decode() for r in got} == {h for *_, h in rows}


def test_very_long_pages_and_many_copies(spark):
    long = "<p>" + "x y z " * 400_000 + "</p>"
    rows = [(k, None, long if k < 2 else "<p>" + "same " * 50) for k in range(400)]
    got = warc.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(0, None), (1, 0), (2, None)} | {(k, 2) for k in range(3, 400)}
    assert {r.payload_bytes for r in got if r.page_id < 2} == {len(long)}


def test_a_gap_in_own_archives_is_an_error(spark, monkeypatch, tmp_path):
    whole = warc.write

    def damaged(pages, path):
        whole(pages, path)
        f = next(p for p in __import__("pathlib").Path(path).glob("part-*") if p.stat().st_size > 50)
        data = bytearray(f.read_bytes())
        data[40] ^= 255
        f.write_bytes(data)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(Exception, match="gap in"):
        warc.report(spark.createDataFrame([(1, "u", "html " * 50)], "page_id long, url string, html string")).collect()


def test_html_edges(spark, pages):
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[7] == got[8] == "" and got[9] == "é" * 49 and len(html.extract(pages).collect()) == 9
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>a &amp; b<br>c  d</p></article><footer>f</footer>", "T\na & b\nc d"),
        ("<nav><a href=x>Home</a></nav><main><p>One.<p>Two <b>bold</b>.</main><aside>x</aside>", "One.\nTwo bold."),
        ("<body><div class='top-banner'>Sale</div><div id=content><p>First text.</p><div class=ad>Buy</div><p>Second.</p></div><div class=comments>hi</div>", "First text.\nSecond."),
        ("<p>1 < 2 and a<b</p>", "1 < 2 and a"),
        ("no markup at all", "no markup at all"),
        ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", "x"),
        ("<div><p>open <p>tags <i>never closed", "open\ntags never closed"),
        ("<ul><li><a href=1>menu one</a><li><a href=2>menu two</a></ul><p>The text itself.</p>", "The text itself."),
        ("<div class=header>Site</div><article><div class='post-header'><h1>T</h1></div><p>x</p><section id=comments>c</section></article>", "T\nx"),
        ("<form><p>name</p></form><p>&#x41;&nbsp;b&copy;</p>", "A b©"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_articles_that_hold_something_small():
    """The stretch with the most text is kept, whatever elements hold it."""
    body, card = "<p>" + "long text of the body " * 20 + "</p>", "<article><p>a teaser card</p></article>"
    text = ("long text of the body " * 20).strip()
    assert html.main_text(f"<div>{body}{body}</div><nav>x</nav><div>{card}{card}</div>") == f"{text}\n{text}"
    assert html.main_text(f"<article>{body}</article><article>{body}<p>end</p></article><footer>f</footer>") == f"{text}\n{text}\nend"
    assert html.main_text(f"<article>{body}<div class=ad>Buy</div><p>end</p></article><nav>x</nav>{card}") == f"{text}\nend"


LONG = "a sentence of the text that goes on for a while, as they do. " * 4


def test_surge_and_dive_decide():
    """Without article, main or class names: what is kept follows from the lengths alone."""
    text, other = LONG.strip(), "one more paragraph of the same text, " * 5
    page = (
        "<body><div><div>Site name</div><div>Contact us at the desk</div></div>"
        f"<div><h2>A heading</h2></div><div><p>{text}<p>short<p>{other}</div>"
        "<div>Copyright 2020 Example Inc.</div><div><p>Imprint<p>Terms</div></body>"
    )
    assert html.main_text(page) == f"A heading\n{text}\nshort\n{other.strip()}"


def test_window_and_threshold_decide(monkeypatch):
    text = LONG.strip()
    page = f"<body><div>{text}</div><div>{text}</div></body>"
    # the edges of two boxes leave two empty lines: a window of one dives there, one of three bridges them
    assert html.stretches(html.lines(page), 1) != html.stretches(html.lines(page), 3)
    page = f"<body><div><div>{text}</div><div>{text}</div></div><div><p>a note of few words</p></div></body>"
    assert "note" not in html.main_text(page)
    monkeypatch.setattr(html, "STEEP", 0)
    assert [html.main_text(f"<div>{text}</div><span>n</span>"), html.main_text(page)][1].endswith(text)
    rows = html.lines(page)
    assert len(html.stretches(rows, 1)) > len(html.stretches(rows, 3))


def test_class_names_are_whole_words():
    """Article text under names that only hold such a word stays."""
    body = f"<p>{LONG}</p>"
    for name in ("related-work", "form-follows", "shadow", "address-book", "headers", "adverbs", "commentary"):
        assert html.main_text(f"<article>{body}<div class='{name}'><p>kept text</p></div></article>").endswith("kept text"), name
    for name in ("ad", "top-banner", "cookie-notice", "comment-list", "related-posts", "x sidebar"):
        assert "kept text" not in html.main_text(f"<article>{body}<div class='{name}'><p>kept text</p></div></article>"), name


def test_stretches_equal_a_plain_version():
    rng = random.Random(3)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, 3, 20, 60, 100, 400]) for _ in range(rng.randrange(1, 40))]
        heads = [bool(n) and n < 60 and rng.random() < 0.3 for n in sizes]
        rows = [html.Line("x" * n, 0, 0, h) for n, h in zip(sizes, heads, strict=True)]
        for window in (1, 2, 3, 6):
            assert html.stretches(rows, window) == brute.stretches(sizes, heads, window), (sizes, heads, window)


def test_pages_equal_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute.op10(r.html or "") for r in rows.collect()}
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_very_long_pages_and_ties():
    long = "".join(f"<p>paragraph {k} of a very long page</p>" for k in range(20_000))
    assert html.main_text(f"<div>{long}</div>").count("\n") == 19_999
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    one, two = "first " * 40, "other " * 40
    page = f"<div><section><p>{one}</section></div><nav>x</nav><div><section><p>{two}</section></div>"
    assert html.main_text(page) == one.strip()


def test_long_pages_take_time_in_proportion():
    """Unclosed elements, closing tags without one, and flat pages without an article: seconds for 100,000 of them."""
    import time

    n, words = 100_000, "some words of a paragraph of usual length in a page without an article "
    began = time.time()
    assert html.main_text(f"<div>{words}" * n).count("\n") == n - 1
    assert html.main_text(f"<p>{words}</p>" * n).count("\n") == n - 1
    assert html.main_text(f"<div><p>{words}</p>" * n + "</div>" * n).count("\n") == n - 1
    assert html.main_text("<div>" * n + words + "</span></section>" * n) == words.strip()
    assert html.main_text(f"<div>{words}</div><nav>x</nav>" * n).count("\n") >= 0
    assert time.time() - began < 60


def test_lines_decide_without_article():
    """On pages without article or main the surge and the dive alone choose the text, and blocks beside it are left out."""
    text = "A sentence of the text that is long enough to count as one. " * 4
    page = f"<div class=x><a href=/>one</a></div><div><span>short</span></div><div>{'<p>' + text + '</p>'}{'<p>' + text + '</p>'}</div><div>end</div><div>note</div><div>tail</div>"
    assert html.main_text(page) == f"{text.strip()}\n{text.strip()}"
