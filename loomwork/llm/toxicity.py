"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A linear model over hashed words and word beginnings gives each sentence a probability; a document's is their
noisy-or, 1 - prod(1 - p). Only document labels are given, so the gradient of the noisy-or shares each
document's error among its sentences, which then locate the offence. Words are folded and stripped of what is
not a letter or digit, so decorated spellings share a weight; word beginnings cover inflected forms. Features
enter the model only if their document frequency differs between the labels by more than chance explains.

Defined results: null and empty texts have no sentences, so their score is 0. Rows without a label, or with a
null one, teach nothing; with several labels the largest counts. Without any usable label every score is 0.
Other columns (lang, source, n_chars) are never read; `score` keeps them but for its own toxicity and worst. Ids of any type.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomwork.llm.common import ALNUM, Words, groups_of, sliced, text_bytes, text_hash, utf8

#: Slots of the table that finds a feature's weight; a hit is checked against the feature's whole hash.
SLOTS = 1 << 22
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7, 8, 9)
#: Log odds of a sentence with known features before they are added; one without any has probability 0.
BIAS = -9.0
ENDS = b".!?\n"
_IS_END = np.zeros(256, bool)
_IS_END[list(ENDS)] = True


class Model(NamedTuple):
    keys: np.ndarray
    weights: np.ndarray


def bags(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """([(feature hashes, their words)], first word of each sentence, first sentence of each text and the end)."""
    words = Words(texts, ALNUM)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(_IS_END[raw])
    marks = np.union1d(np.searchsorted(words.start, ends), words.bounds)
    first = marks[marks < len(words.start)]
    features = [(words.hash, np.arange(len(words.hash)))]
    for n in STEMS:
        longer = np.flatnonzero(words.end - words.start >= n)
        features.append((words.beginnings(longer, n), longer))
    return features, first, np.searchsorted(first, words.bounds)


def known(model: Model, table: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(word, index of its feature in the model) of the features that the model has."""
    at, found = [], []
    for hashes, word in features:
        slot = table[hashes & np.uint64(SLOTS - 1)]
        hit = np.flatnonzero(slot >= 0)
        hit = hit[model.keys[slot[hit]] == hashes[hit]]
        at.append(word[hit])
        found.append(slot[hit])
    return np.concatenate(at), np.concatenate(found)


def slots(model: Model) -> np.ndarray:
    table = np.full(SLOTS, -1, np.int32)
    table[model.keys & np.uint64(SLOTS - 1)] = np.arange(len(model.keys), dtype=np.int32)
    return table


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(model: Model, table: np.ndarray, features, first: np.ndarray) -> np.ndarray:
    word, found = known(model, table, features)
    sentence = np.searchsorted(first, word, "right") - 1
    return probabilities(sentence, model.weights[found], len(first))


def probabilities(sentence: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Of n sentences, from the weights of the features that occur and the sentences they are in."""
    p = sigmoid(BIAS + np.bincount(sentence, weights, n))
    return np.where(np.bincount(sentence, minlength=n) > 0, p, 0.0)


def noisy_or(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability of each bag from its sentences'; bounds has one entry more than there are bags."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return np.abs(np.expm1(total[bounds[1:]] - total[bounds[:-1]]))


def choose(texts: list[bytes], labels: np.ndarray, least: int = 3, z: float = 4.0) -> np.ndarray:
    """Hashes of the features that toxic documents have significantly more often than others."""
    seen = np.zeros((2, SLOTS), np.float32)

    def each():
        for at, part in groups_of(texts):
            features, first, bounds = bags(part)
            start = np.append(first, len(features[0][0]))[bounds]
            for k in range(len(part)):
                yield labels[at + k], np.concatenate(
                    [h[np.searchsorted(w, start[k]) : np.searchsorted(w, start[k + 1])] for h, w in features]
                )

    for y, hashes in each():
        seen[y, np.unique(hashes & np.uint64(SLOTS - 1))] += 1
    n = np.bincount(labels, minlength=2)

    def strong(bad, good):
        odds = np.log((bad + 0.5) / (n[1] - bad + 0.5)) - np.log((good + 0.5) / (n[0] - good + 0.5))
        return (bad >= least) & (odds > z * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))

    likely = strong(seen[1], seen[0])
    counts: dict[int, list[int]] = {}
    for y, hashes in each():
        for h in np.unique(hashes[likely[hashes & np.uint64(SLOTS - 1)]]).tolist():
            counts.setdefault(h, [0, 0])[y] += 1
    return np.array(sorted(h for h, (good, bad) in counts.items() if strong(np.float64(bad), np.float64(good))), np.uint64)


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 2e-4) -> Model:
    """Weights by adaptive gradient steps on the noisy-or's log loss, clean documents counting three times."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    keys = choose(texts, labels)
    model = Model(keys, np.full(len(keys), 1.0))
    table = slots(model)
    at, found, bounds, n = [], [], [np.zeros(1, np.int64)], 0
    for _, part in groups_of(texts):
        features, first, b = bags(part)
        word, f = known(model, table, features)
        at.append(np.searchsorted(first, word, "right") - 1 + n)
        found.append(f)
        bounds.append(b[1:] + n)
        n += len(first)
    sentence, feature, bounds = np.concatenate(at), np.concatenate(found), np.concatenate(bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    target, weight = labels[doc], np.where(labels[doc] == 1, 1.0, 3.0)
    weights, seen = model.weights, np.full(len(keys), 1e-8)
    for _ in range(rounds):
        p = probabilities(sentence, weights[feature], n)
        whole = np.maximum(noisy_or(p, bounds), 1e-9)[doc]
        slope = np.where(target == 1, -(1 - whole) / whole * p, p) * weight
        grad = np.bincount(feature, slope[sentence], len(keys)) + decay * len(texts) * weights / max(1, len(keys))
        seen += grad**2
        weights = weights - rate * grad / np.sqrt(seen)
    return Model(keys, weights)


def fit(docs: DataFrame, labels: DataFrame, most: int = 9000, most_bytes: int = 1 << 26) -> Model:
    """Learns from at most `most` labelled documents, up to a third of them toxic, of `most_bytes` in all.

    Documents are drawn in the order of a hash of doc_id, then of the text, so each run draws the same ones: of each label
    as many whole texts as both bounds allow. Only rows whose crc32(doc_id as text) mod 4 is not 2 are read. Lengths and
    hashes of at most `most` rows come to the driver first, then the texts drawn.
    """
    marked = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out("label_id"))
    own = docs.select("doc_id", text_hash().alias("twin"), utf8().alias("bytes"))
    rows = []
    for kind, n in ((1, most // 3), (0, most - most // 3)):
        ids = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("label_id"), "label_id").limit(n)
        # repeated doc_ids could exceed the bound, so it holds for the joined rows too
        pool = own.join(F.broadcast(ids.select("label_id")), F.col("doc_id") == F.col("label_id"))
        size = pool.select("label_id", "twin", F.length("bytes").alias("size"), F.xxhash64("label_id").alias("place"))
        drawn, room = [], most_bytes * n // most
        for r in size.distinct().orderBy("place", "label_id", "twin").limit(n).collect():
            if r["size"] <= room:
                room -= r["size"]
                drawn.append((r["label_id"], r["twin"]))
        if drawn:
            spark = docs.sparkSession
            chosen = spark.createDataFrame(drawn, f"label_id {docs.schema['doc_id'].dataType.simpleString()}, same long")
            texts = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("label_id")) & (F.col("twin") == F.col("same")))
            # equal rows are one document
            rows += [(kind, bytes(r["bytes"])) for r in texts.dropDuplicates(["doc_id", "twin"]).select("bytes").collect()]
    rows.sort()
    return train([t for _, t in rows], np.array([y for y, _ in rows], np.int64))


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with toxicity, a double from 0 to 1, and worst, the index of the worst sentence.

    A column of docs with one of these names gives way to the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("toxicity", "worst")]
    names = [f.name for f in kept]

    def run(batches):
        model = Model(*sent.value)
        table = slots(model)
        for b in sliced(batches):
            scores, worst = [], []
            for _, part in groups_of(text_bytes(b)):
                features, first, bounds = bags(part)
                p = sentence_scores(model, table, features, first)
                scores += noisy_or(p, bounds).tolist()
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    worst.append(int(p[s:e].argmax()) if e > s else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.clip(scores, 0, 1), pa.float64()), pa.array(worst, pa.int32())],
                names=[*names, "toxicity", "worst"],
            )

    schema = StructType([*kept, StructField("toxicity", DoubleType()), StructField("worst", IntegerType())])
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of docs that score below the limit."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        model = Model(*sent.value)
        table = slots(model)
        for b in sliced(batches):
            keep = []
            for _, part in groups_of(text_bytes(b)):
                features, first, bounds = bags(part)
                keep += (noisy_or(sentence_scores(model, table, features, first), bounds) < limit).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query op7."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        F.col("worst").alias("worst_sentence"),
    )
