"""Conversations, vectors and tokens: plain versions and edge cases."""

import hashlib
import itertools
import math
import random

import brute_rounds as brute
import numpy as np
import public_tokenizers
import pytest
from conftest import LONG
from tokenizers import Tokenizer

from loomwork.llm import bpe, centroids, toxicity, turns

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def survivors(rows):
    s = turns.Survivors()
    for r in rows:
        s.add(*r)
    cost, edits = s.finish()
    return cost, edits.decode(), s


def by_trial(rows):
    """All edits with at most two inserted turns between rows."""
    best = (math.inf, "")
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, roles, edits, good = 5 * sum(gaps), "", "I" * gaps[0], True
            for k in range(gaps[0]):
                roles += "ua"[k % 2]
            for (initial, gone, cut), letter, more in zip(rows, letters, gaps[1:], strict=True):
                follows = "a" if roles[-1:] == "u" else "u"
                good &= not (gone and letter != "D")
                cost += {"D": 2, "K": 0, "R": 1}[letter] + 5 * (cut and letter != "D")
                roles += {"D": "", "K": initial, "R": follows}[letter]
                for _ in range(more):
                    roles += "a" if roles[-1:] == "u" else "u"
                edits += letter + "I" * more
            rest = roles[1:] if roles[:1] == "s" else roles
            if good and rest == "ua" * (len(rest) // 2) and (rest or not roles):
                best = min(best, (cost, edits))
    return best


def drawn(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.choice((0, 1, 2, 3, 5, 9, 40)))]
    return [(i, g, c and not g) for i, g, c in rows]


def test_edits():
    for seed in range(3000):
        rows = drawn(seed)
        assert survivors(rows)[:2] == brute.cheapest(rows)
        if len(rows) <= 3 and seed < 400:
            assert brute.cheapest(rows) == by_trial(rows)


def test_edits_leave_the_tree():
    tidy = [("ua"[k % 2], k % 7 == 3 and False, False) for k in range(5000)]
    assert len(survivors(tidy)[2].edits) > 4990
    # whether the first turn goes depends on the number of turns: nothing is final, and the tree has few nodes all the same
    cost, edits, s = survivors([("u", False, False)] * 5001)
    nodes, todo = 0, [s.root]
    while todo:
        nodes, todo = nodes + 1, todo[1:] + todo[0].children
    assert (cost, edits[:4], nodes < 9) == (2502, "DKRK", True)


def test_conversations(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, turns.report(rows).collect())) == sorted(brute.op11([tuple(r) for r in rows.collect()]))


ODD = [
    *[(1, None, None, None)] * 2,
    *[(1, 3, "user", "Hi.")] * 3,
    (1, 3, "user", "Abc!"),
    (1, 2, "assistant", "Yo"),
    (None, 1, "system", "S."),
    (None, 2, "user", "q?"),
    (None, 3, "assistant", "a.\n "),
    (5, (1 << 63) - 1, "tool", "x."),
    (5, -(1 << 63), "user", " \t"),
    *[(7, k % 3, "user", "same.") for k in range(50)],
    *[(8, k, "user" if k % 5 else "assistant", f"turn {k // 2}{'.' * (k % 3)}") for k in range(400)],
    (9, 1, "", "é" * 200_000 + "."),
]


def test_odd_conversations(spark):
    table = spark.createDataFrame([(*r, "x", 3, None) for r in ODD], "conv_id long, turn long, role string, text string, n string, kind int, digest string")
    assert sorted(map(tuple, turns.report(table).collect()), key=repr) == sorted(brute.op11(ODD), key=repr)
    assert turns.report(table.limit(0)).count() == 0 == turns.repair(table.limit(0)).count()


def test_repaired_rows(spark):
    table = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    found = {}
    for r in sorted(turns.repair(table).collect(), key=lambda r: (str(r.conv_id), r.place)):
        found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in {r[0] for r in ODD}:
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD if c == conv]
        assert hashlib.sha256("\n".join(found.get(conv, [])).encode()).hexdigest() == brute.repaired(own)[-1]


def test_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, centroids.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == sorted(brute.op12(rows))


def test_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(k % 30, [rnd.choice((-1.5, 0.25, 0.5, 1e-9)) for _ in range(64)]) for k in range(60)]
    rows += [(100, rows[0][1])] * 40 + [(None, [1e300] * 64), (None, [-1e300] + [0.0] * 63), (101, [math.nan] * 64), (102, [math.inf] * 64), (103, [0.0] * 63), (104, None), (105, [None] * 64), (106, [])]
    table = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, v int, lead string, x double")
    want = sorted(brute.op12(rows), key=repr)
    assert sorted(map(tuple, centroids.report(table).collect()), key=repr) == want
    assert centroids.report(table.limit(0)).count() == 0 == centroids.report(table.where("vec_id > 100")).count()
    few = [r for r in rows if r[0] == 100][:3]
    assert sorted(map(tuple, centroids.report(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect())) == sorted(brute.op12(few))


def test_bounds():
    """No bound is above the distance; the filter leaves few centroids of spread-out groups."""
    rnd = np.random.default_rng(1)
    middle = rnd.integers(-3000, 3000, (8, 64))
    x = (middle[rnd.integers(0, 8, 2000)] + rnd.integers(-200, 200, (2000, 64))).astype(np.int64)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1][:, :12]
    lead, rest, norm = centroids.project(x, turn)
    c_lead, c_rest, c_norm = centroids.project(middle, turn)
    bound = ((lead[:, None] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2 - centroids.SLACK * (norm[:, None] + c_norm[None] + 1)
    real = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (bound <= real).all()
    assert (bound <= real.min(1)[:, None]).sum() < 1.1 * len(x)
    best, distance = centroids.nearest(x, lead, rest, norm, middle, turn)
    assert (best == real.argmin(1)).all() and (distance == real.min(1)).all()


POOL = ["a", "b", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", " 've", "1", "23", "é", "字", "　", " ", "!", "!?", "😀", "<|endoftext|>", "<|endof", "text|>", "\t", "x" * 50, "ö" * 40, "ſ", "́", "١", "\r\n", "\x00", "ab cd"]


@pytest.mark.parametrize("sizes", [(1, 2, 8), (8, 16, 64), (256, 1024, 4096)])
def test_joins_of_chunks(monkeypatch, sizes):
    for name, n in zip(("LEAST", "USUAL", "LARGEST"), sizes, strict=True):
        monkeypatch.setattr(bpe, name, n)
    codec, library, rnd = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(7)
    texts = ["".join(rnd.choice(w) for _ in range(rnd.choice((3, 40, 200)))) for w in (rnd.sample(POOL, rnd.choice((1, 2, 5, 20))) for _ in range(1500))]
    for text, ids in zip(texts, codec.every([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want == codec.encode(text.encode()).tolist()
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == text
    assert codec.reused > 0


def test_long_words_and_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 1 << 16)
    codec, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in ("ab" * 200_000, "字" * 50_000, " " * 100_000, LONG):
        assert codec.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.held < 1 << 17
    broken = np.array([128, 129, 50256, 128])
    assert codec.decode(broken) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_chunks_are_shared():
    """A passage in two texts has the same chunks, whatever stands before it."""
    codec, passage = bpe.Codec(VOCABULARY), LONG[5000:45000].encode()
    codec.encode(b"Something else. " * 9 + passage)
    before = codec.encoded
    codec.encode(b"Another start\n" + passage)
    assert codec.encoded - before < 0.2 * before


def report_of(rows):
    library = Tokenizer.from_file(VOCABULARY)
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        out.append((doc, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    return sorted(out, key=repr)


def test_tokens(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, bpe.report(docs).collect()), key=repr) == report_of(rows)
    tokens = bpe.encode(edge_docs)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode(tokens).collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=repr)
    assert bpe.report(no_docs).count() == 0 == bpe.encode(no_docs).count()


def test_toxicity_is_its_plain_version(spark):
    """Every row of the query over 300 documents: features, choice, training and scores by plain loops."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    toxic = "you are a vile brute and a filthy liar"
    more = [(1000 + k, f"A quiet report number {k}. Nothing else{'! ' + toxic + f' {k}' if k % 3 == 0 else ''}.\n") for k in range(60)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    marks = labels.unionByName(spark.createDataFrame([(i, int(toxic in t)) for i, t in more], "doc_id long, toxic int").withColumn("toxic", toxicity.F.col("toxic").cast(labels.schema["toxic"].dataType)))
    want = brute.op7([tuple(r) for r in table.collect()], [tuple(r) for r in marks.collect()])
    got = toxicity.report(table, marks).collect()
    assert len(got) == len(want) >= 300 and sum(s > 0.3 for _, s, _ in want.values()) >= 20
    for r in got:
        held, score, worst = want[r.doc_id]
        assert r.held_out == held and abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.3)
        assert score == 0 or r.worst_sentence == worst
