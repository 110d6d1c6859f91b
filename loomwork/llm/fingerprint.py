"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes. On each level, runs of equal symbols become one symbol; deterministic coin
tossing then turns symbols into a few labels, each from a symbol and its left neighbour, in which neighbours
differ; blocks begin at the local maxima of the labels, and a block's name, a hash of its symbols, is a symbol
of the next level. Where a block begins depends on a few symbols around it, so equal substrings get the same
names inside, wherever they stand. The fingerprint holds the smallest hashes of the names on level `LEVEL`,
phrases of about twenty bytes: `KEPT` of them, or one in `SHARE` if that is more, so the share of common phrases
of two texts shows in their fingerprints, and long texts keep more.

Documents are range-sorted, so the next one is the next row; each partition's last document is finished in a second step,
with the first of the partition after it. Defined results: a null or empty text has the empty fingerprint, which
is like itself (1) and unlike all others (0). The next document is by falling doc_id, null last, equal doc_ids
by a falling hash of the text; the last one's is the first. Many rows of one doc_id, or without one, are split by that
hash, and equal rows at random, which changes nothing. Ids of any type. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import _power_tables, groups_of, mix, staged, trim

LEVEL, KEPT, SHARE = 3, 64, 32
#: Rounds of coin tossing: 64-bit symbols go to under 128, 14, 8 labels.
ROUNDS = 3


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels in which neighbours differ where symbols do; first: where texts begin."""
    x = symbols
    for _ in range(ROUNDS):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = ~x[first]  # the first symbol differs from nothing in its lowest bit
        low = left ^ x
        low &= ~low + x.dtype.type(1)
        place = np.bitwise_count(low - x.dtype.type(1)).astype(np.uint8)
        bit = (x & low) != 0
        x = (place << np.uint8(1)) | bit
    return x


def parse(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of each text and their bounds; texts lie at bounds[k]:bounds[k + 1], none is empty."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[bounds[:-1]] = True
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(symbols)))
    bounds = np.searchsorted(run, bounds)
    kept = symbols[run]
    first = bounds[:-1]
    label = labels(kept, first)
    before, after = np.empty_like(label), np.empty_like(label)
    before[1:], after[:-1] = label[:-1], label[1:]
    before[first], after[bounds[1:] - 1] = 255, 255
    start = (label > before) & (label > after)
    start[first] = True
    at = np.flatnonzero(start)
    named = mix(kept.astype(np.uint64) + np.uint64(1))
    long = np.flatnonzero(length > 1)
    named[long] = mix(named[long] + length[long].astype(np.uint64))
    power, inverse = _power_tables(len(named) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(named * power[: len(named)])])
    end = np.append(at[1:], len(named))
    return mix((total[end] - total[at]) * inverse[at] + (end - at).astype(np.uint64)), np.searchsorted(at, bounds)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted 32-bit hashes of the phrases of each text, the smallest ones."""
    out = []
    for _, part in groups_of(texts):
        solid = [k for k, t in enumerate(part) if t]
        found = [np.zeros(0, np.uint32)] * len(part)
        if solid:
            symbols = np.frombuffer(b"".join(part), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(part[k]) for k in solid])])
            for _ in range(LEVEL):
                symbols, bounds = parse(symbols, bounds)
            names = (mix(symbols) >> np.uint64(32)).astype(np.uint32)
            for n, k in enumerate(solid):
                every = np.unique(names[bounds[n] : bounds[n + 1]])
                found[k] = every[: max(KEPT, len(every) // SHARE)]
        out += found
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    every = both[np.concatenate([[True], ~twice])]
    # beyond its largest kept hash, nothing is known of a text with more phrases
    limit = min([every[-1], *(x[-1] for x in (a, b) if len(x) >= KEPT)])
    return float((both[1:][twice] <= limit).sum() / (every <= limit).sum())


def packed(x: np.ndarray) -> bytes:
    """The hashes as bytes, of which hexadecimal digits are made at the end: they take half the space until then."""
    return x.astype(">u4").tobytes()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def finished(rows: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    """Columns of the result for (doc_id, text, following text)."""
    texts, following = [r[1] for r in rows], [r[2] for r in rows]
    changed = [edited(t, n).encode() for t, n in zip(texts, following, strict=True)]
    prints = fingerprints([t.encode() for t in texts] + changed + [n.encode() for n in following[-1:]])
    own, others, last = prints[: len(rows)], prints[len(rows) : 2 * len(rows)], prints[2 * len(rows) :]
    # rows that follow each other share their texts
    after = [own[k + 1] if k + 1 < len(rows) and following[k] is texts[k + 1] else None for k in range(len(rows) - 1)] + last
    after = [fingerprints([n.encode()])[0] if p is None else p for p, n in zip(after, following, strict=True)]
    return [
        pa.array([r[0] for r in rows], kind),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).digest() for t in changed], pa.binary()),
        pa.array([packed(p) for p in own], pa.binary()),
        pa.array([packed(p) for p in others], pa.binary()),
        pa.array([likeness(p, q) for p, q in zip(own, others, strict=True)], pa.float64()),
        pa.array([likeness(p, q) for p, q in zip(own, after, strict=True)], pa.float64()),
    ]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
#: Characters of texts that are finished at a time.
SLICE = 1 << 20


def report(docs: DataFrame) -> DataFrame:
    """The rows of query op6."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"same": F.xxhash64("text"), "spread": F.rand(1)})
    order = [F.col("doc_id").desc_nulls_last(), F.desc("same")]
    ranged = own.repartitionByRange(*order, "spread").sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches):
        """Finished rows, and (edge, part, doc_id, text) of each partition's first (0) and last (1) document."""
        waiting, size, part = [], 0, None
        for b in batches:
            of = b.schema.field(0).type
            for doc, text, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part is None:
                    part = k
                    yield edge(0, part, doc, text, of)
                waiting.append((doc, text))
                size += len(text)
                if size >= SLICE and len(waiting) > 1:
                    yield done(waiting, of)
                    waiting = waiting[-1:]
                    size = len(waiting[0][1])
        if waiting:
            if len(waiting) > 1:
                yield done(waiting, of)
            yield edge(1, part, *waiting[-1], of)
        trim()

    def done(rows, of):
        cols = finished([(*x, y[1]) for x, y in zip(rows[:-1], rows[1:], strict=True)], of)
        none = [pa.nulls(len(rows) - 1, t) for t in (pa.int32(), pa.int32(), pa.string())]
        return pa.RecordBatch.from_arrays([*cols, *none], names=[*COLUMNS, "edge", "part", "text"])

    def edge(which, part, doc, text, of):
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        own = [pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([doc], of), *none, *own], names=[*COLUMNS, "edge", "part", "text"])

    every = staged(ranged.mapInArrow(run, f"{schema}, edge int, part int, text string"))
    # one row for each partition: the one before it, the last for the first
    heads = every.where("edge = 0").select("part", F.col("text").alias("following"))
    parts = heads.select("part")
    before = parts.select(
        "part",
        F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior"),
    )
    tails = every.where("edge = 1").select("doc_id", "text", F.col("part").alias("prior"))
    open_rows = tails.join(heads.join(before, "part"), "prior").select("doc_id", "text", "following")

    def last(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays(finished([row], b.schema.field(0).type), names=COLUMNS)

    out = every.where("edge is null").select(*COLUMNS).union(open_rows.mapInArrow(last, schema))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
