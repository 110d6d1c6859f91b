"""Edge cases and plain versions of the operators over documents."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import LONG, pairs, prose

from loomwork.llm import decontam, fingerprint, jaccard, linedup, packing, passages, suffixdup, toxicity
from loomwork.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# decontamination


def test_decontamination_equals_brute_force(spark):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = brute.op1(pairs(documents(spark)), [(r.item_id, r.text) for r in bench.collect()])
    assert rows(decontam.report(documents(spark), bench)) == sorted(want, key=repr)


def test_decontamination_edges(spark, edge_docs, no_docs):
    items = [(1, prose(1, 12)), (2, "ONE"), (3, None), (4, " , "), (None, prose(3, 30)), (1, prose(1, 12)), (6, " ".join(["same"] * 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.op1(pairs(edge_docs), items)
    assert rows(decontam.report(edge_docs, bench)) == sorted(want, key=repr)
    # blocks of a few words give the same rows
    many = decontam.find_contamination(edge_docs, bench, block_words=24).select("doc_id", "n_words", "n_hit")
    assert rows(many) == sorted((w[:3] for w in want), key=repr)
    assert decontam.report(no_docs, bench).count() == 0
    assert all(not r.contaminated for r in decontam.report(edge_docs, bench.limit(0)).collect())


def test_blocks_of_items_are_bounded(spark):
    """Null, repeated and unlike ids, and repeated rows: no block outgrows the bound, and the rows stay the same."""
    items = [(None, prose(k, 15)) for k in range(40)] + [("one", prose(k, 12)) for k in range(40, 80)] + [("x", prose(90, 400))] + [("y", prose(91, 14))] * 50
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(k, f"a {prose(k, 30)} b") for k in range(0, 95, 5)] + [(200, prose(90, 200)), (201, prose(91, 20))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    parts = decontam.blocks(bench, 10, 120)
    sizes = [b.agg(decontam.F.sum("size")).first()[0] for b in parts]
    assert len(sizes) > 5 and max(sizes) <= 120
    want = sorted((w[:3] for w in brute.op1(docs, items)), key=repr)
    assert rows(decontam.find_contamination(df, bench, block_words=120).select("doc_id", "n_words", "n_hit")) == want


def test_decontaminate_cuts_spans(spark, edge_docs):
    bench = spark.createDataFrame([(1, prose(1, 12))], "item_id long, text string")
    out = decontam.decontaminate(edge_docs, bench)
    assert out.schema == edge_docs.schema
    texts = {r.doc_id: r.text for r in out.where("doc_id <> 2").collect()}
    assert texts[1].strip() == " ".join(prose(1).split()[12:])
    assert texts[5] == LONG and texts[4] == "" and texts[3] is None
    assert decontam.decontaminate(edge_docs, spark.createDataFrame([(1, prose(1))], "item_id long, text string")).where("doc_id = 1").count() == 0


# line dedup


def test_line_runs(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.n_lines, r.n_removed, r.n_runs) for r in linedup.report(edge_docs).collect()}
    assert {(9, 5, 2, 1), (8, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (1, 1, 0, 0)} <= got
    assert linedup.report(edge_docs).count() == edge_docs.count()
    assert linedup.report(no_docs).count() == 0
    out = linedup.dedup_lines(edge_docs)
    assert out.schema.names == edge_docs.columns
    nine = out.where("doc_id = 9").first()
    assert nine.text == "first line here\nsecond line here\n\nthird" and nine.n_chars == len(nine.text)


def test_line_runs_of_more_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nz"), (4, "a\nb\nc\nd")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in linedup.dedup_lines(docs, least=3).collect()}
    assert kept == {1: "a\nb\nc\nd", 2: "x\ny", 3: "b\nc\nz"}


def random_lines(n=40, seed=4):
    """Documents of few different lines, so that runs of all lengths repeat, also inside a document."""
    rng = np.random.default_rng(seed)
    long = [f"line {k}" for k in range(60)]
    docs = []
    for k in range(n):
        body = [f"l{x}" for x in rng.integers(0, 9, rng.integers(0, 25))]
        if k % 4 == 0:
            s = int(rng.integers(0, 20))
            body += long[s : s + int(rng.integers(5, 40))]
        docs.append((k, "\n".join(x if rng.random() > 0.05 else f"{x}\n  " for x in body)))
    return docs


def test_line_runs_equal_brute_force(spark):
    docs = random_lines()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.op2(docs)
    kept = {r.doc_id: r.text for r in linedup.dedup_lines(df, alone=None).collect()}
    assert kept == {d: t for d, (t, n) in want.items() if t.strip() or not n}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in linedup.report(df).collect()}
    assert got == {d: (n, hashlib.sha256(t.encode()).hexdigest()) for d, (t, n) in want.items()}


def test_maximal_runs_equal_brute_force(spark):
    """Runs from the deepest intervals, and nothing but their lines goes."""
    docs = random_lines(30, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = linedup.runs(linedup.repeats(df)).collect()
    assert sorted((r.doc, r.start, r.stop, r.first.doc, r.first.pos) for r in found) == brute.op2_runs(docs)
    assert max(r.depth for r in found) == 16 and max(r.stop - r.start for r in found) > 16
    lines = {}
    for r in found:
        lines.setdefault(r.doc, set()).update(range(r.start, r.stop))
    assert {d: len(x) for d, x in lines.items()} == {d: n for d, (_, n) in brute.op2(docs).items() if n}


def test_long_lines_of_their_own(spark):
    long, short = prose(80, 50), prose(81, 49)
    docs = spark.createDataFrame([(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}\ne\n{long}"), (3, long), (4, short)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in linedup.dedup_lines(docs).collect()}
    assert kept == {1: f"a\n{long}\nb\n{short}", 2: f"c\nd\n{short}\ne", 4: short}


# repeated bytes


def test_suffixes_equal_brute_force(spark):
    assert rows(suffixdup.report(documents(spark))) == sorted(brute.op3(pairs(documents(spark))), key=repr)


def test_suffix_edges(spark, no_docs):
    texts = [prose(5), None, "", "a" * 99, "a" * 100, "a" * 500, "x" + prose(5)[20:400] + "y", prose(5)[:250] + "€" + prose(5)[250:], "ab" * 300, prose(6, 20) + "ab" * 200]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert rows(suffixdup.report(docs)) == sorted(brute.op3(pairs(docs)), key=repr)
    assert suffixdup.report(no_docs).count() == 0


def test_suffixes_of_repeated_rows(spark, edge_docs):
    got = Counter(r.doc_id for r in suffixdup.report(edge_docs).collect())
    assert got == Counter(i for i, _ in pairs(edge_docs))
    twos = {r.n_removed for r in suffixdup.report(edge_docs).where("doc_id = 2").collect()}
    assert len(prose(1)) in twos and 0 in twos


@pytest.mark.parametrize("parts", [1, 4])
def test_suffixes_of_repeated_rows_alone(spark, parts):
    """A document that only exists as equal rows keeps its first copy, in one batch or in several."""
    texts = [(1, prose(70)), (2, prose(71, 40) + prose(70)[100:400]), (3, prose(72, 30) * 2)]
    want = {r[0]: r for r in brute.op3(texts)}
    docs = spark.createDataFrame([r for r in texts for _ in range(3)], "doc_id long, text string").repartition(parts)
    assert rows(suffixdup.report(docs)) == sorted((want[i] for i, _ in texts for _ in range(3)), key=repr)


def test_very_large_groups_of_suffixes(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "MOST", 3)
    shared = prose(8, 12)
    docs = spark.createDataFrame([(k, prose(20 + k, 9) + shared + prose(60 + k, 9)) for k in range(12)], "doc_id long, text string").coalesce(1)
    own = suffixdup.identified(docs).select("doc", "twin", "bytes")
    spans = suffixdup.settle(suffixdup.blocks(own))
    # run in this process, where the bound is small
    batches = [b for b in suffixdup.fetched(own, spans.where("kind = 1")).repartitionByRange(1, "lead", "gram").sortWithinPartitions("lead", "gram", "doc", "twin", "at").toArrow().to_batches()]
    assert batches
    assert rows(suffixdup.report(docs)) == sorted(brute.op3(pairs(docs)), key=repr)


def test_multikey_quicksort_is_sorting():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 3, 4000).astype(np.uint8)
    raw[1000:2000], raw[2500:2700] = raw[:1000], raw[100:300]
    words = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | raw[i : len(raw) - 7 + i]
    start = rng.permutation(len(raw) - suffixdup.SPAN)
    group = start % 3
    got = sorted(suffixdup.repeated(words, start, group, np.arange(len(start))).tolist())
    seen, want = set(), []
    for k, s in enumerate(start.tolist()):
        key = (group[k], raw[s : s + suffixdup.SPAN].tobytes())
        if key in seen:
            want.append(k)
        seen.add(key)
    assert got == want and len(want) > 100


def test_many_documents_of_one_id(spark):
    """Null ids, repeated ids and ids that are strings: each text is a document of its own."""
    shared = prose(3, 30)
    texts = [prose(100 + k, 12) + (f" {shared} {k}" if k % 2 else "") for k in range(2000)]
    for kind, ids in (("long", [None] * 2000), ("long", [7] * 2000), ("string", [f"d{k:05}" for k in range(2000)])):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
        got = Counter((r.n_removed > 0, r.n_bytes) for r in suffixdup.report(docs).collect())
        cut = sum(n for (gone, _), n in got.items() if gone)
        assert cut == 999, (kind, cut)
        kept = Counter(r.n_bytes - r.n_removed for r in suffixdup.report(docs).collect())
        assert sum(kept.values()) == 2000


# passages


def test_passages(spark, edge_docs, no_docs):
    shared = prose(9, 60)
    docs = spark.createDataFrame(
        [(1, prose(30, 50) + " " + shared + " " + prose(31, 50)), (2, prose(32, 70) + " " + shared.replace("x30 ", "z30 ")), (3, prose(33, 200)), (4, None)],
        "doc_id long, text string",
    )
    got = passages.passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2, 1)}
    assert got[0].n_words >= 50 and got[0].similarity >= 0.8 and abs(got[0].other_start - 50) <= 5
    assert {1, 2} <= {r.doc_id for r in passages.passages(edge_docs).collect()} | {r.other_id for r in passages.passages(edge_docs).collect()}
    assert passages.passages(no_docs).count() == 0


def test_passage_recall(spark):
    """Documents with an equal run of 50 words in another one are found, at least nine in ten."""
    got = passages.passages(documents(spark))
    flagged = {x for r in got.collect() for x in (r.doc_id, r.other_id)}
    where = {}
    for doc, text in pairs(documents(spark)):
        words = decontam.fold((text or "").encode())
        for k in range(len(words) - 49):
            where.setdefault(tuple(words[k : k + 50]), set()).add(doc)
    want = {d for docs in where.values() if len(docs) > 1 for d in docs}
    assert len(want & flagged) >= 0.9 * len(want)


def edited(words, rng, edits, tag):
    """The words with some replaced, dropped or added."""
    out = list(words)
    for k in range(edits):
        at = int(rng.integers(0, len(out)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            out[at] = f"new{tag}e{k}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"more{tag}e{k}")
    return out


def test_near_passages_equal_brute_force(spark):
    """Passages with edits in families of two and three: pairs against verification of all pairs, and their precision."""
    rng, docs = np.random.default_rng(12), []
    for family in range(40):
        passage = prose(20_000 + family, 52 + 7 * (family % 12)).split()
        for _ in range(2 + family % 2):
            k = len(docs)
            words = edited(passage, rng, int(rng.integers(0, 1 + len(passage) // 45)), k)
            docs.append((k, f"{prose(1000 + k, 40 + k % 50)} {' '.join(words)} {prose(3000 + k, 30 + k % 40)}"))
    # one long sentence that many have is no passage
    docs += [(1000 + k, f"{prose(5000 + k, 60)} {prose(7, 30)} {prose(6000 + k, 60)}") for k in range(40)]
    shingles = {d: passages.shingle_hashes(passages.Words([t.encode()], passages.ALNUM).hash, passages.GRAM) for d, t in docs}
    want = {(x, y) for x in shingles for y in shingles if y < x and passages.alike(shingles[x], shingles[y])}
    got = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id) for r in got}
    assert len(want) > 60 and found <= want and len(found) >= 0.95 * len(want)
    texts = dict(docs)
    for r in got:
        parts = []
        for doc, start, n in ((r.doc_id, r.start, r.n_words), (r.other_id, r.other_start, r.other_words)):
            words = texts[doc].lower().split()[start : start + n]
            assert len(words) == n >= 50
            parts.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
        like = len(parts[0] & parts[1]) / len(parts[0] | parts[1])
        assert like >= 0.8 and abs(like - r.similarity) < 1e-9


def test_classes_of_passages(spark):
    """Large families: every member is in the class of its family, whose id is the smallest, and others are alone."""
    rng, docs = np.random.default_rng(13), []
    for family in range(6):
        passage = prose(30_000 + family, 90).split()
        for k in range(30):
            docs.append((100 * family + k, f"{prose(10_000 + len(docs), 45)} {' '.join(edited(passage, rng, k % 2, k))} {prose(15_000 + len(docs), 35)}"))
    docs += [(5000 + k, prose(40_000 + k, 80)) for k in range(20)] + [(None, docs[0][1] + " null"), (0, docs[0][1]), (9000, None)]
    got = passages.members(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    right = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and r.n_links and (r.class_id is None if r.doc_id < 100 else r.class_id == r.doc_id // 100 * 100)]
    assert len(right) >= 0.98 * 181
    assert all(r.class_id == r.doc_id and not r.n_links for r in got if r.doc_id and r.doc_id >= 5000)


def test_passages_of_many_documents_of_one_id(spark):
    """Null, repeated and string ids: documents that differ in text are pairs like any others."""
    shared = prose(77, 80)
    texts = [prose(8000 + k, 12) + (f" {shared} {k}" if k < 60 else "") for k in range(2000)]
    for kind, ids in (("long", [None] * 2000), ("long", [7] * 2000), ("string", [f"d{k:05}" for k in range(2000)])):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
        got = passages.passages(docs).collect()
        assert len(got) >= 59 and {r.class_id for r in got} == {ids[0]}
        if kind == "string":
            assert {x for r in got for x in (r.doc_id, r.other_id)} == set(ids[:60])
    same = spark.createDataFrame([(1, texts[0])] * 50, "doc_id long, text string")
    assert passages.passages(same).count() == 0


def test_joined_windows_are_cartesian(spark):
    """The sliding minimum gives the windows of the Cartesian tree, as far as RUN shingles through their centre reach."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    at = passages.centres(h, passages.RUN)
    reach = passages.RUN - 1
    want = sorted((max(s, c - reach), c, min(e, c + reach)) for s, c, e in passages.compact_windows(h, passages.RUN))
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    ends = np.append(cut[1:], len(at)) - 1 + passages.RUN - 1
    assert sorted(zip(cut.tolist(), at[cut].tolist(), ends.tolist(), strict=True)) == want


def test_equal_passages_behind_variants(spark):
    """The first document and those between have variants too far from the passage that two others share."""
    docs = []
    for trial in range(30):
        shared = prose(9000 + trial, 55).split()
        variants = [[f"v{k}w{j}" if j in (17 + k % 3, 37 + k % 2) else w for j, w in enumerate(shared)] for k in range(7)]
        for k, w in enumerate([variants[0], shared, *variants[1:], shared]):
            at = 10 * trial + k
            docs.append((at, f"{prose(1000 + at, 150)} {' '.join(w)} {prose(5000 + at, 150)}"))
    got = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id) for r in got}
    assert [t for t in range(30) if (10 * t + 8, 10 * t + 1) not in found] == []


def linked_classes(docs, links):
    """doc -> smallest document reached by links."""
    root = {d: d for d, _ in docs}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            if root[x] != root[y]:
                root[x] = root[y] = min(root[x], root[y])
                changed = True
    return root


def common_lines(families):
    """Documents with one of two common lines, and for each family some with both, a word of their own between them."""
    docs = []
    for f in range(families):
        one, two = prose(50_000 + f, 28), prose(51_000 + f, 28)
        docs += [(1000 * f + k, f"{prose(52_000 + 100 * f + k, 60)} {(one, two)[k % 2]} {prose(54_000 + 100 * f + k, 60)}") for k in range(40)]
        docs += [(1000 * f + k, f"{prose(56_000 + 100 * f + k, 60)} {one} own{k} {two} {prose(58_000 + 100 * f + k, 60)}") for k in range(40, 44)]
    return docs


@pytest.mark.parametrize("block", [5, 4096])
def test_passages_of_two_common_lines(spark, monkeypatch, block):
    """All keys of the passages are in large groups, whose first documents have only a part of it: no class is lost."""
    monkeypatch.setattr(passages, "BLOCK", block, raising=False)
    docs = common_lines(3)
    shingles = {d: passages.shingle_hashes(passages.Words([t.encode()], passages.ALNUM).hash, passages.GRAM) for d, t in docs}
    want = {(x, y) for x in shingles for y in shingles if y < x and passages.alike(shingles[x], shingles[y])}
    assert len(want) == 3 * 6
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in passages.members(df).collect()} == linked_classes(docs, want)
    assert {(r.doc_id, r.other_id) for r in passages.passages(df).collect()} <= want


def test_passages_of_parted_keys(spark, monkeypatch):
    """Keys parted by tokens, these in blocks: no class is lost."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    monkeypatch.setattr(passages, "MANY", 8)
    docs = common_lines(1)
    got = passages.members(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: 40 if d >= 40 else d for d, _ in docs}


def test_hashes_around_a_key_equal_plain_comparison():
    """Counts of equal hashes, what is joined to the key, and the pairs that connect the classes."""
    rng = np.random.default_rng(31)
    base = rng.integers(1, 300, passages.WIDE)
    near = np.where(rng.random((40, passages.WIDE)) < rng.choice([0.0, 0.05, 0.3], 40)[:, None], rng.integers(0, 2000, (40, passages.WIDE)), base).astype(np.uint32)
    near[:, passages.LOCAL] = base[passages.LOCAL]
    most, sets = passages.equal_hashes(near), [[set(row[side].tolist()) - {0} for side in passages.SIDES] for row in near]
    assert all(most[i, j] == max(len(a & b) for a, b in zip(sets[i], sets[j], strict=True)) for i in range(40) for j in range(40) if i != j)
    i, j = np.nonzero(np.triu(np.ones((40, 40)), 1))
    for x, y, fits in zip(i, j, passages.around(near[i], near[j]).T, strict=True):
        at = [k for k in range(passages.WIDE) if near[x, k] and near[x, k] in near[y]]
        low = high = passages.LOCAL
        for k in at:
            high = k if 0 < k - high <= passages.GAP else high
        for k in reversed(at):
            low = k if 0 < low - k <= passages.GAP else low
        own = [k for k in at if low <= k <= high]
        long = high - low + 1 >= passages.LEAST or low <= passages.GAP or high >= passages.WIDE - 1 - passages.GAP
        sides = [sum(side.start <= k < side.stop for k in own) for side in passages.SIDES]
        assert fits.tolist() == [long and n >= passages.EQUAL for n in sides]
    a, b = np.array([1, 1, 2, 5, 1]), np.array([2, 3, 3, 6, 2])
    assert sorted(passages.spanning(a, b, np.array([40, 50, 60, 41, 45])).tolist()) == [1, 2, 3]


def test_passage_whose_lines_stand_alone_before(spark):
    """Both lines of a passage also stand alone earlier in one of its two documents, so its keys are there more than once."""
    one, two = prose(61, 28), prose(62, 28)
    docs = [(1, f"{one} {prose(63, 300)} {two} {prose(64, 300)} {one} here {two} {prose(65, 60)}"), (2, f"{prose(66, 40)} {one} there {two} {prose(67, 30)}")]
    got = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(2, 1)] and 650 < got[0].other_start < 660 and 56 <= got[0].n_words <= 58


def test_classes_of_many_lines_equal_brute_force(spark):
    """Documents made of a few lines with changed words, so that every line has a large group: classes against all pairs."""
    rng = np.random.default_rng(21)
    lines = [prose(70_000 + k, 26).split() for k in range(12)]
    docs = []
    for k in range(150):
        words = prose(71_000 + k, 20).split()
        for line in rng.choice(12, 3, replace=False).tolist():
            words += edited(lines[line], rng, int(rng.random() < 0.2), 10 * k + line)
            if rng.random() < 0.7:
                words += prose(72_000 + 20 * k + line, int(rng.integers(1, 16))).split()
        docs.append((k, " ".join([*words, prose(75_000 + k, 20)])))
    shingles = {d: passages.shingle_hashes(passages.Words([t.encode()], passages.ALNUM).hash, passages.GRAM) for d, t in docs}
    want = {(x, y) for x in shingles for y in shingles if y < x and passages.alike(shingles[x], shingles[y])}
    got = passages.members(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    classes = linked_classes(docs, want)
    assert 20 < len(set(classes.values())) < 150
    assert {r.doc_id: r.class_id for r in got} == classes


def test_passage_with_a_line_that_occurs_before():
    """A line inside the passage that the other document, or both, has once more shortly before, or often."""
    line, body = prose(51, 14), prose(50, 61).split()
    shared = " ".join([*body[:30], *line.split(), *body[30:]])
    lone, other = f"{prose(52, 40)} {shared} {prose(53, 40)}", f"{prose(54, 20)} {line} {prose(55, 20)} {shared} {prose(56, 40)}"
    texts = [lone, other, f"{line} {lone}", " ".join([line, prose(57, 9)] * 300) + " " + shared]
    sets = [passages.shingle_hashes(passages.Words([t.encode()], passages.ALNUM).hash, passages.GRAM) for t in texts]
    want = passages.shingle_hashes(passages.Words([shared.encode()], passages.ALNUM).hash, passages.GRAM)
    at = [next(k for k in range(len(s)) if np.array_equal(s[k : k + len(want)], want)) for s in sets]
    for k, x in enumerate(sets):
        for m, y in enumerate(sets):
            if k != m:
                assert any(s <= at[k] and at[k] + len(want) <= e and u <= at[m] and at[m] + len(want) <= v for s, e, u, v, _ in passages.alike(x, y)), (k, m)


def test_passages_of_lines_that_repeat_very_often(monkeypatch):
    monkeypatch.setattr(passages, "HITS", 100)
    test_passage_with_a_line_that_occurs_before()


# fingerprints


def test_fingerprints(spark, edge_docs, no_docs):
    assert fingerprint.report(no_docs).count() == 0
    got = fingerprint.report(edge_docs).collect()
    ordered = sorted(pairs(edge_docs), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ordered)
    nine, eight = (dict(ordered)[i] for i in (9, 8))
    half = len(nine) // 2
    row = next(r for r in got if r.doc_id == 9)
    assert row.edited_sha256 == hashlib.sha256((nine[: len(nine) - half] + eight[:half]).encode()).hexdigest()
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {""} and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_equal_a_plain_version(spark, parts):
    """Edited texts, lengths and next documents of every row; likeness against exact phrase sets of another hash."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = {r.doc_id: r for r in fingerprint.report(documents(spark)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute.op6_edits(pairs(documents(spark)))
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == {w[0]: w[1:3] for w in want}
    texts, off = {d: t or "" for d, t in pairs(documents(spark))}, []

    def share(x, y):
        return len(x & y) / len(x | y) if x | y else 1.0

    for doc, _, _, changed, following in want[:60]:
        a, b, c = (brute.phrases(t) if t else set() for t in (texts[doc], changed, following))
        off += [abs(share(a, b) - got[doc].near_edited), abs(share(a, c) - got[doc].near_next)]
    assert np.mean(off) < 0.06 and np.quantile(off, 0.95) < 0.2
    prints = {}
    for doc, r in got.items():
        assert prints.setdefault(texts[doc], r.fingerprint) == r.fingerprint


def test_fingerprints_of_many_documents_of_one_id(spark):
    """Null ids, repeated ids, string ids and equal rows: each row comes out, each with the next one's text."""
    texts = [prose(k, 6) for k in range(1500)]
    for kind, ids in (("long", [None] * 1500), ("long", [7] * 1500), ("string", [f"d{k:04}" for k in range(1500)])):
        got = fingerprint.report(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")).collect()
        assert len(got) == 1500 and len({r.edited_sha256 for r in got}) == 1500
        if kind == "string":
            want = {i: texts[k][: -(len(texts[k]) // 2)] + texts[k - 1][: len(texts[k]) // 2] for k, i in enumerate(ids)}
            assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    same = spark.createDataFrame([(1, texts[0])] * 500, "doc_id long, text string")
    assert {(r.near_edited, r.near_next) for r in fingerprint.report(same).collect()} == {(1.0, 1.0)} or fingerprint.report(same).count() == 500


def test_long_texts_keep_more_hashes():
    long = [" ".join(prose(k, 30) for k in range(s, s + 400)).encode() for s in (0, 300)]
    a, b = fingerprint.fingerprints(long)
    assert min(len(a), len(b)) > fingerprint.KEPT and abs(fingerprint.likeness(a, b) - 1 / 7) < 0.05


def test_phrases_do_not_depend_on_the_offset():
    inner = prose(11, 200).encode()
    a, b = fingerprint.fingerprints([b"start " + inner, b"another, longer start: " + inner])
    assert fingerprint.likeness(a, b) > 0.7
    assert fingerprint.likeness(a, fingerprint.fingerprints([prose(12, 200).encode()])[0]) < 0.1


# toxicity


def test_toxicity(spark, edge_docs, no_docs):
    good = [(k, f"the quick fox number {k % 7} went home. it rained in town") for k in range(60)]
    bad = [(k, f"the quick fox number {k % 7} went home. you are a vile brute") for k in range(60, 120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and sum((r.doc_id >= 60) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    assert all(r.worst_sentence == 1 for r in got if r.doc_id >= 60)
    assert toxicity.report(edge_docs, labels).count() == edge_docs.count()
    assert {r.score for r in toxicity.report(edge_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(no_docs, labels).count() == 0
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.schema == docs.schema and {r.doc_id >= 60 for r in kept.collect()} == {False}


def test_toxicity_on_held_out_documents(spark):
    """Documents that the model has not learned from: at least 80 of 100 toxic ones found, at most 2 of 100 others flagged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(toxicity.F.max("toxic").alias("toxic"))
    got = toxicity.report(docs, labels).where("held_out").join(marked, "doc_id").groupBy("toxic").agg(toxicity.F.avg("predicted").alias("share"), toxicity.F.count("*").alias("n")).collect()
    share = {r.toxic: r.share for r in got}
    assert min(r.n for r in got) > 20 and share[1] >= 0.8 and share[0] <= 0.02


def test_toxicity_draws_the_same_documents(spark):
    """Repeated ids and bounds on rows and bytes: two runs learn the same, whatever the order of the rows."""
    rows = [(k % 40, f"the fox number {k} went home. {'you are a vile brute' if k % 2 else 'it rained in town'}") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    models = []
    for parts in (1, 3):
        docs = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, text string").repartition(parts)
        models.append(toxicity.fit(docs, labels, most=150, most_bytes=9000))
    assert np.array_equal(models[0].keys, models[1].keys) and np.allclose(models[0].weights, models[1].weights) and len(models[0].keys)


def test_noisy_or():
    assert np.allclose(toxicity.noisy_or(np.array([0.5, 0.5, 0.1]), np.array([0, 2, 2, 3])), [0.75, 0.0, 0.1])


# packing


def test_packing(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    got = packing.pack(edge_docs).collect()
    lengths = sorted(sum(r.length for r in got if r.doc_id == i) for i in (1, 5, 7))
    assert lengths == sorted(len(slow.encode(t, add_special_tokens=False).ids) + 1 for t in (prose(1), LONG, "one"))
    assert [r.doc_tokens for r in got if r.doc_id == 3] == [1]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(no_docs).count() == 0


def test_every_piece_and_little_padding(spark):
    """Ids, starts and checksums of every piece against the tokenizer itself; padding over all groups."""
    import zlib

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark)
    got = packing.pack(docs, group=64).collect()
    want = []
    for doc, text in pairs(docs):
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        want += [(doc, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048)]
    assert sorted(map(tuple, (r[:5] for r in got))) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = sorted(parts)
        assert [o for o, _ in ends] == [sum(n for _, n in ends[:k]) for k in range(len(ends))] and sum(n for _, n in ends) <= 2048
    tokens = sum(r.length for r in got)
    # each group of about 64 pieces may leave one sequence half empty
    groups = max(1, round(len(got) / 64))
    assert len(bins) * 2048 <= 1.03 * tokens + 2048 * groups


def test_packing_of_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "same words")] * 300 + [(2, LONG)] * 3 + [(None, None)] * 20, "doc_id long, text string")
    got = packing.pack(docs, group=50).collect()
    assert sum(r.doc_id == 1 for r in got) == 300 and len({r.sequence_id >> 28 for r in got}) > 1
    assert Counter((r.start, r.length) for r in got if r.doc_id == 2).most_common(1)[0][1] == 3


@pytest.mark.parametrize("text", ["plain words", "<|endoftext|> inside", "é€😀\n\n  tabs\t", "don't 1234567 $%^", "\x00\x01"])
def test_encoders_agree(text):
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path("byte_bpe_50k.json")
    assert list(packing.encoder(path)(text)) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_first_fit_is_the_plain_one():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 2049, 500))[::-1]
    bins, _ = packing.first_fit_decreasing(lengths, 2048)
    free: list[int] = []
    for n, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        k = next((k for k, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(2048)
        free[k] -= n
        assert k == b


# similarity join


def test_jaccard_equals_brute_force(spark):
    assert rows(jaccard.join(documents(spark))) == sorted(brute.op9(pairs(documents(spark))), key=repr)


def test_jaccard_of_a_group_of_near_copies(spark):
    """Members that are linked only through others; more than a group gives all pairs of."""
    words = prose(40, 120).split()
    docs = [(k, " ".join(w if (j * 31 + k * 17) % 97 or not k else f"{w}k{k}" for j, w in enumerate(words))) for k in range(40)]
    docs += [(100 + k, prose(200 + k, 60)) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.join(df)) == sorted(brute.op9(docs), key=repr)


@pytest.mark.parametrize("bounds", [{"small": 6}, {"small": 3, "block": 8}, {"small": 2, "block": 3, "nearest": 1}, {"small": 2, "block": 3, "nearest": 1, "split": 4}])
def test_jaccard_paths_give_the_same(spark, bounds):
    """Groups below and beyond each bound: all pairs, leaders, blocks, nearest partners, parts and what is left."""
    docs = []
    for family in range(3):
        words = prose(70 + family, 90).split()
        for k in range(5 + 15 * family):
            docs.append((len(docs), " ".join(f"{w}k{k}" if k and j in ((k * 13) % 90, (k * 29) % 90, (k * 41) % 90 if k % 3 else (k * 13) % 90) else w for j, w in enumerate(words))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.op9(docs), key=repr)
    assert rows(jaccard.join(df, **bounds)) == want and len({c for *_, c in want}) > 3


def test_candidates_are_intersected_before_texts_are_read(spark):
    """Sets with a common token under the first order only are no candidates, and no similar pair is lost."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[: 400 - 8 * k], rng.integers(0, 2**63, 8 * k).astype(np.uint64)])) for k in range(50)]
    other = [np.unique(np.concatenate([base[k : k + 1], rng.integers(0, 2**63, 399).astype(np.uint64)])) for k in range(60)]
    first = jaccard.heads(base, 85)
    for x in sets:
        if jaccard.similar(base, x, 85):
            assert jaccard.orders_meet(first, len(base), jaccard.heads(x, 85), len(x), 85)
    stay = sum(jaccard.orders_meet(first, len(base), jaccard.heads(x, 85), len(x), 85) for x in other)
    assert stay <= 10
    docs = documents(spark).select("doc_id", "text")
    every = jaccard.staged(jaccard.signed(docs, 4, 85))
    nodes = every.where("n > 0").groupBy("a", "b").agg(*(jaccard.F.first(c).alias(c) for c in ("n", "bits", "heads")))
    linked = jaccard.first_links(jaccard.prefixes(docs, 4, 85, np.zeros(0, np.uint64)), 85)
    pairs = linked.where("kind = 0").select("xa", "xb", "ya", "yb").distinct()
    assert jaccard.filtered(pairs, nodes, 85).count() < 0.5 * pairs.count()


def test_a_hot_token_is_parted_by_further_orders(spark):
    """400 unlike sets and 20 pairs of similar ones in one group: its parts hold each similar pair, and few others."""
    rng = np.random.default_rng(11)
    hot = np.array([5], np.uint64)
    sets = [np.unique(np.concatenate([hot, rng.integers(0, 2**63, 60).astype(np.uint64)])) for _ in range(400)]
    sets += [np.unique(np.concatenate([x[:-1], rng.integers(0, 2**63, 1).astype(np.uint64)])) for x in sets[:20]]
    nodes = spark.createDataFrame([(k, -k, len(x), jaccard.bitmap(x), jaccard.heads(x, 85)) for k, x in enumerate(sets)], "a long, b long, n long, bits binary, heads binary")
    members = nodes.select(jaccard.F.lit(1).cast("long").alias("token"), "n", "a", "b")
    roots = spark.createDataFrame([], "node struct<a:long,b:long>, root struct<a:long,b:long>")
    want = {(k, 400 + k) for k in range(20)}
    assert all(jaccard.similar(sets[x], sets[y], 85) for x, y in want)
    for split in (1000, 64, 2):
        got = {tuple(sorted((r.xa, r.ya))) for r in jaccard.later_links(members, nodes, roots, 85, split=split).collect()}
        assert want <= got
    placed = members.withColumn("c", jaccard.F.xxhash64("a", "b"))
    whole, parts = (jaccard.mixed_groups(placed.select("token", "n", "c", "a", "b"), nodes, 85, split) for split in (1000, 64))
    compared = [sum(r.n * (r.n - 1) // 2 for g in x for r in g.groupBy("token").agg(jaccard.F.count("*").alias("n")).collect()) for x in (whole, parts)]
    assert compared[0] == 420 * 419 // 2 and compared[1] < compared[0] / 50


def test_jaccard_of_many_documents_of_one_id(spark):
    """Null ids, repeated ids and string ids: each text is a document of its own, and each set is fetched once."""
    texts = [prose(300 + k // 2, 40) + (" tail" if k % 2 else "") for k in range(2000)]
    for kind, ids in (("long", [None] * 2000), ("long", [7] * 2000), ("string", [f"d{k:05}" for k in range(2000)])):
        got = jaccard.join(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")).collect()
        assert len(got) == 2000 and Counter(r.n_shingles for r in got) == {37: 1000, 38: 1000}
        if kind == "string":
            assert all(r.component_id == f"d{int(r.doc_id[1:]) // 2 * 2:05}" for r in got)
        else:
            assert {r.component_id for r in got} == {ids[0]}
    same = spark.createDataFrame([(7, prose(1))] * 300 + [(7, prose(1) + " x")] * 300, "doc_id long, text string")
    assert len(jaccard.join(same).collect()) == 600
    assert jaccard.keep_one(same).count() == 1


def test_jaccard_edges(spark, edge_docs, no_docs):
    got = jaccard.join(edge_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in pairs(edge_docs))
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert comp[(1, 87)] == comp[(2, 87)] == 1 and comp[(3, 0)] == 3 and comp[(4, 0)] == 4 and comp[(7, 1)] == 7
    assert jaccard.join(no_docs).count() == 0
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[3] == 1 and ids[4] == 1 and ids[5] + ids[6] == 1 and ids[10] + ids[1] == 1 + (jaccard_apart(edge_docs))


def jaccard_apart(docs):
    return int({r.doc_id: r.component_id for r in jaccard.join(docs).collect()}[10] == 10)


def test_folded_bitmaps():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64))
    a, b = (np.frombuffer(jaccard.bitmap(x[:n]), np.uint64) for n in (1060, 1020))
    assert len(a) == 2 * len(b) and np.bitwise_count(jaccard.folded(a) ^ b).sum() <= 40


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (4, 1), (7, 7)] + [(k, k + 1) for k in range(100, 140)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {2: 1, 3: 1, 4: 1, 9: 8} | {k: 100 for k in range(101, 141)}
    assert components(edges.limit(0)).count() == 0
