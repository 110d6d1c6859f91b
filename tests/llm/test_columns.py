"""Whole-row functions keep columns of any name, those of their helpers above all."""

import pytest
from conftest import prose

from loomwork.llm import decontam, jaccard, linedup, toxicity

NAMES = "lines solid gone deepest twin doc same n first hits items words kept spans bytes toxicity worst key place text_hash".split()
CLASHING = [*NAMES, *(f"_{n}" for n in NAMES), *(f"__{n}" for n in NAMES), "Twin", "N_CHARS2"]


@pytest.fixture(scope="module")
def clashing(spark):
    # the names differ in case too, so each is taken once
    names = list({n.lower(): n for n in CLASHING}.values())
    rows = [(k, prose(k // 2, 60) + (" x" if k % 2 else ""), *(f"{n}{k}" for n in names)) for k in range(8)]
    rows += [(8, "a b\nc d\n" + prose(90, 55), *names), (9, "z\na b\nc d\n" + prose(90, 55), *names)]
    return spark.createDataFrame(rows, ["doc_id", "text", *names])


def model(spark):
    docs = [(k, f"good day {k} in town" if k % 2 else f"you are a vile brute {k}") for k in range(200)]
    return toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, toxic int"))


@pytest.mark.parametrize("name", ["dedup_lines", "keep_one", "decontaminate", "keep_clean", "score"])
def test_columns_stay(spark, clashing, name):
    bench = spark.createDataFrame([(1, prose(0, 12))], "item_id long, text string")
    out = {
        "dedup_lines": lambda: linedup.dedup_lines(clashing),
        "keep_one": lambda: jaccard.keep_one(clashing),
        "decontaminate": lambda: decontam.decontaminate(clashing, bench),
        "keep_clean": lambda: toxicity.keep_clean(clashing, model(spark)),
        "score": lambda: toxicity.score(clashing, model(spark)),
    }[name]()
    own = [c for c in clashing.columns if name != "score" or c.lower() not in ("toxicity", "worst")]
    assert out.columns == (clashing.columns if name != "score" else [*own, "toxicity", "worst"])
    before = {r.doc_id: r for r in clashing.collect()}
    after = out.collect()
    assert len(after) >= 5
    for r in after:
        assert all(r[c] == before[r.doc_id][c] for c in own if c != "text")
