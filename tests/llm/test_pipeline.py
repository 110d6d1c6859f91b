"""The stages one after the other over small documents, and over edge cases."""

import brute
from conftest import pairs, prose

import corpus_pipeline
from loomwork.llm import queries


def folder(spark, path, docs, labels, bench):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    item = prose(900, 30)
    rows = [(k, f"good day in town {prose(k, 60)}. it rained") for k in range(1, 41)]
    rows += [(k, f"{prose(k, 60)}. you are a vile brute") for k in range(50, 90)]
    rows += [(100, rows[0][1] + " more"), (101, prose(101, 80) + " " + item), (102, item), (103, "l one\nl two\n" + prose(103)), (104, "l one\nl two\n" + prose(104))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, int(k >= 50)) for k in [*range(1, 41), *range(50, 90)]], "doc_id long, quality int, toxic int")
    where = folder(spark, tmp_path, docs, labels, spark.createDataFrame([(1, item)], "item_id long, text string"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, where)
        if name != "packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
            seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert not [i for i in seen["toxicity"] if 50 <= i < 90] and {1, 40, 101, 102, 103} <= set(seen["toxicity"])
    assert seen["line dedup"][104] == prose(104) and seen["line dedup"][103].startswith("l one")
    assert 100 not in seen["n-gram Jaccard join"] and 1 in seen["n-gram Jaccard join"]
    assert 102 not in seen["benchmark decontamination"] and seen["benchmark decontamination"][101].strip() == prose(101, 80)
    assert {r.doc_id for r in now.collect()} == set(seen["benchmark decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, where).collect()} == set(seen["benchmark decontamination"])


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    groups = {r[0]: r[2] for r in brute.op9(pairs(docs), gram=5, least=80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for g in groups.values()} | {d for d, g in groups.items() if g == d})


def test_edges(spark, edge_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(2, 20)), (None, None)], "item_id long, text string")
    where = folder(spark, tmp_path, edge_docs, labels, bench)
    for docs in (edge_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, where)
            if name != "packing":
                now = spark.createDataFrame(now.collect(), docs.schema)
        assert (now.count() > 0) == (docs is edge_docs)


def test_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.oracle_sql()) <= names


FOLDER = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_toxicity_stage_equals_the_scores(spark):
    """Rows below the limit stay as they are; each score is computed anew, sentence by sentence, from the model's weights."""
    import numpy as np

    from loomwork.llm import toxicity

    large = "/root/testdata/sf0.1"  # a smaller table teaches nothing
    model = toxicity.fit(*(spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels")))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        clean = 1.0
        raw = (text or "").encode()
        for sentence in brute.re.split(rb"[.!?\n]", raw):
            words = toxicity.Words([sentence], toxicity.ALNUM)
            found = [int(h) for h in words.hash]
            for n in toxicity.STEMS:
                long = np.flatnonzero(words.end - words.start >= n)
                found += [int(h) for h in words.beginnings(long, n)]
            known = [weights[h] for h in found if h in weights]
            if known:
                clean *= 1 - 1 / (1 + np.exp(-(toxicity.BIAS + sum(known))))
        return 1 - clean

    kept = {r.doc_id: r.text for r in toxicity.keep_clean(docs, model).collect()}
    want = {r.doc_id: r.text for r in docs.collect() if plain(r.text) < 0.3}
    assert kept == want and len(kept) < docs.count()


def test_line_dedup_stage_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want, seen = {}, set()
    for doc, text in sorted(docs):
        every = (text or "").split("\n")
        solid = [k for k, x in enumerate(every) if x.strip()]
        gone = set()
        for n, k in enumerate(solid):
            for size in (1, 2):
                run = tuple(every[j] for j in solid[n : n + size])
                if len(run) < size or size == 1 and len(run[0].split()) < 50:
                    continue
                if run in seen:
                    gone |= set(solid[n : n + size])
                seen.add(run)
        if not gone:
            want[doc] = text
        elif len(gone) < len(solid):
            want[doc] = "\n".join(x for k, x in enumerate(every) if k not in gone)
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, table(spark, "documents"), FOLDER).collect()}
    assert got == want and any(got[d] != t for d, t in docs if d in got)


def test_decontamination_stage_equals_brute_force(spark):
    word = brute.re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows, want = set(), {}
    for r in table(spark, "benchmark").collect():
        w = word.findall((r.text or "").translate(brute.FOLD))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    for r in table(spark, "documents").collect():
        at = list(word.finditer((r.text or "").translate(brute.FOLD)))  # as long as the text
        w, hit = [m[0] for m in at], set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) > 0.5 * len(at):
            continue
        out, pos = "", 0
        for k in sorted(hit):
            if k - 1 in hit:
                pos = at[k].end()
            else:
                out += r.text[pos : at[k].start()]
                pos = at[k].end()
        want[r.doc_id] = r.text if not hit else out + r.text[pos:]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark(spark, table(spark, "documents"), FOLDER).collect()}
    assert got == want and any(len(got[d]) < len(t) for d, t in pairs(table(spark, "documents")) if d in got and t)


def test_packing_stage_holds_every_document(spark):
    docs = table(spark, "documents")
    got = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(tokens) == {r.doc_id for r in docs.collect()}
    for parts in tokens.values():
        parts.sort()
        assert [s for s, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
