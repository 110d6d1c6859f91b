"""Removal of repeated byte strings with a sparse suffix array.

Only suffixes at anchors are kept: of the `GRAM`-byte strings inside a window of `SPAN` bytes, the one with
the smallest hash, the leftmost on ties, is the window's anchor. The choice depends on the window's bytes
alone, so equal windows have equal anchors at equal offsets, and comparing windows with equal anchor strings
finds every repeat. Neighbouring windows share their anchor and form a block.

1. Blocks with equal bytes are grouped; all but the first are removed whole. Blocks alone under their anchor
   string are settled. Repeats inside a batch are collapsed before the shuffle. Blocks, of at most `SPAN` +
   `WIDTH` bytes, are equal here if two 64-bit hashes are, that of the anchor string and that of the block.
2. The others, at the edges of repeats, fetch their bytes. Sampled splitters range-partition them by the leading
   bytes at the anchor; equal leading bytes are never split, so no comparison crosses a boundary. Each bucket
   sorts its windows by multikey quicksort with keys of eight bytes, dropping what is alone; what is left after
   `SPAN` bytes repeats, and all but the first are removed.
3. Groups of more than `MOST` blocks outgrow a task: their windows go by two 64-bit hashes, as blocks do,
   through an aggregation that combines before its shuffle, whatever the group's size.

Order is by doc_id, a 64-bit hash of the text for equal doc_ids, then start. Defined results: a null text is
empty and loses nothing; texts shorter than `SPAN` bytes lose nothing; rows with equal doc_id and text count as
one document and get the same result; null doc_ids, however many, are the smallest and differ by their texts;
ids that are no integers go by their own order. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import CHUNK, Rolling, discard, identified, mix, release, staged

SPAN, GRAM = 100, 32
#: Grams in a window.
WIDTH = SPAN - GRAM + 1
#: Blocks of one anchor string that are compared in one task.
MOST = 50_000
#: Bits of a place in a piece of text, and bytes of a piece.
_PLACE, _PIECE = 24, 1 << 23
_DONE = np.int64(1) << np.int64(62)


def packed(start, anchor, more):
    """One integer, in order of places: start (32 bits), anchor's offset and windows less one (7 each)."""
    return (start << 14) | (anchor << 7) | more


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (at >> 14) & 0xFFFFFFFF, (at >> 7) & 127, at & 127


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, gram hash, block hash) of each block of the texts at [starts, ends)."""
    if len(buffer) < SPAN:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(buffer)
    gram = roll.every(GRAM)
    low = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while 2 * size <= WIDTH:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (WIDTH - size)], low[WIDTH - size :])
    anchor = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
    fits = np.arange(len(anchor)) + SPAN <= ends[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    last = np.minimum(last, ends[text[first]] - SPAN)
    keep = fits[first]
    first, last = first[keep], last[keep]
    x = anchor[first]
    whole = roll.spans(first, last + SPAN) ^ mix((x - first).astype(np.uint64))
    return text[first], first, last, x, gram[x], mix(whole)


def distinct(*columns: np.ndarray, last: tuple | None = None) -> np.ndarray:
    """Whether each row differs from the one before; repeated rows of a document have the same blocks."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    if last is not None and len(new):
        new[0] = tuple(c[0] for c in columns) != last
    return new


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (gram, block, doc, twin, at) of the blocks; later copies in a batch are marked done and dealt at random."""

    def run(batches):
        for b in batches:
            ids, twins, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            cols: list[tuple[np.ndarray, ...]] = []
            part: list[tuple[int, int, bytes]] = []
            size = 0

            def flush():
                ends = np.cumsum([len(p) for _, _, p in part])
                starts = ends - [len(p) for _, _, p in part]
                t, first, last, x, g, h = anchors(np.frombuffer(b"".join(p for _, _, p in part), np.uint8), starts, ends)
                row, off = np.array([r for r, _, _ in part])[t], np.array([o for _, o, _ in part])[t]
                cols.append((g.astype(np.int64), h.astype(np.int64), ids[row], twins[row], packed(first - starts[t] + off, x - first, last - first)))

            for i, text in enumerate(texts):
                for k in range(0, max(1, len(text) - SPAN + 1), _PIECE):
                    piece = text[k : k + _PIECE + SPAN - 1]
                    if len(piece) >= SPAN:
                        part.append((i, k, piece))
                        size += len(piece)
                    if size >= CHUNK:
                        flush()
                        part, size = [], 0
            if part:
                flush()
            if not cols:
                continue
            g, h, doc, twin, at = (np.concatenate(c) for c in zip(*cols, strict=True))
            order = np.lexsort((at, twin, doc, h, g))
            g, h, doc, twin, at = (c[order] for c in (g, h, doc, twin, at))
            own = distinct(doc, twin, at, h, g)
            g, h, doc, twin, at = (c[own] for c in (g, h, doc, twin, at))
            done = np.zeros(len(g), bool)
            done[1:] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
            g[done] = mix((doc[done] ^ twin[done] ^ at[done] << 1).astype(np.uint64)).astype(np.int64)
            at[done] |= _DONE
            back = np.lexsort((at, twin, doc))  # neighbouring rows of a document compress well
            yield pa.RecordBatch.from_arrays([pa.array(c[back]) for c in (g, h, doc, twin, at)], names=["gram", "block", "doc", "twin", "at"])

    return docs.mapInArrow(run, "gram long, block long, doc long, twin long, at long")


def settle(rows: DataFrame) -> DataFrame:
    """Blocks that are later copies (kind 0), and those under an anchor string that has others (kind 1)."""
    order = rows.repartition("gram").sortWithinPartitions("gram", "block", "doc", "twin", "at")
    names = ["kind", "gram", "doc", "twin", "at"]

    def taken(kind, which, g, doc, twin, at):
        return np.stack([np.full(len(g[which]), kind), g[which], doc[which], twin[which], at[which] & ~_DONE], 1)

    def run(batches):
        # the last row's strings, the only block so far under its anchor string, and whether there are more
        gram = block = None
        alone: np.ndarray | None = None
        before = None
        for b in batches:
            g, h, doc, twin, at = (c.to_numpy() for c in b.columns)
            if not len(g):
                continue
            own = distinct(g, h, doc, twin, at, last=before)
            before = (g[-1], h[-1], doc[-1], twin[-1], at[-1])
            g, h, doc, twin, at = (c[own] for c in (g, h, doc, twin, at))
            done = (at & _DONE) != 0
            out = [taken(0, done, g, doc, twin, at)]
            g, h, doc, twin, at = (c[~done] for c in (g, h, doc, twin, at))
            if len(g):
                same = np.concatenate([[g[0] == gram], g[1:] == g[:-1]])
                copy = same & np.concatenate([[h[0] == block], h[1:] == h[:-1]])
                out.append(taken(0, copy, g, doc, twin, at))
                own = np.flatnonzero(~copy)
                group = np.cumsum(~same)  # 0 continues the last batch's anchor string
                n = np.bincount(group[own], minlength=group[-1] + 1)
                if group[0] == 0 and n[0]:
                    # it has others now: the one held back counts too
                    if alone is not None:
                        out.append(alone)
                        alone = None
                    n[0] += 1
                if group[-1]:
                    alone = None
                out.append(taken(1, own[n[group[own]] > 1], g, doc, twin, at))
                if group[-1] and n[-1] == 1:
                    alone = taken(1, own[-1:], g, doc, twin, at)
                gram, block = g[-1], h[-1]
            x = np.concatenate(out)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(5)], names=names)

    return order.mapInArrow(run, "kind long, gram long, doc long, twin long, at long")


def fetched(docs: DataFrame, open_blocks: DataFrame) -> DataFrame:
    """The open blocks with their bytes and the leading bytes at the anchor."""
    lists = open_blocks.groupBy(F.col("doc").alias("d"), F.col("twin").alias("t")).agg(F.collect_list("gram").alias("grams"), F.collect_list("at").alias("ats"))
    joined = docs.join(lists, (F.col("doc") == F.col("d")) & (F.col("twin") == F.col("t"))).select("doc", "twin", "bytes", "grams", "ats")

    def run(batches):
        for b in batches:
            rows = []
            for doc, twin, text, grams, ats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                raw, at = text.as_py(), np.array(ats.as_py(), np.int64)
                start, anchor, more = unpacked(at)
                for g, a, s, x, m in zip(grams.as_py(), at.tolist(), start.tolist(), anchor.tolist(), more.tolist(), strict=True):
                    rows.append((raw[s + x : s + x + 8], g, doc, twin, a, raw[s : s + m + SPAN]))
                    if len(rows) > 50_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    def batch(rows):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lead", "gram", "doc", "twin", "at", "bytes"])

    return joined.mapInArrow(run, "lead binary, gram long, doc long, twin long, at long, bytes binary")


#: Where the keys of a window begin: eight bytes each, the last two overlap.
KEYS = np.array([*range(0, SPAN - 7, 8), SPAN - 8])


def multikey(words: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, class) of the windows that equal another one of their group, by multikey quicksort.

    words[k] are the eight bytes at k as one number. All parts are split at once: each around the key of its
    middle window into smaller, equal and greater ones; equal ones go on with the next key. Parts of one go.
    """
    order = np.argsort(group, kind="stable")
    left, part, depth = order, np.cumsum(np.diff(group[order], prepend=group[order][:1]) != 0), np.zeros(len(order), np.int64)
    done, classes, found = [], [], 0
    while True:
        first = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(np.append(first, len(part)))
        many = np.repeat(size > 1, size)
        left, part, depth = left[many], part[many], depth[many]
        last = depth == len(KEYS)
        if last.any():
            done.append(left[last])
            classes.append(found + part[last])
            found += int(part[-1]) + 1
            left, part, depth = left[~last], part[~last], depth[~last]
        if not len(left):
            break
        first = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(np.append(first, len(part)))
        key = words[start[left] + KEYS[depth]]
        pivot = np.repeat(key[first + size // 2], size)
        side = (key > pivot).astype(np.int64) - (key < pivot)
        place = np.repeat(np.arange(len(first)), size) * 3 + side + 1
        order = np.argsort(place, kind="stable")
        left, place, depth = left[order], place[order], (depth + (side == 0))[order]
        part = np.cumsum(np.diff(place, prepend=place[:1]) != 0)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *done]), np.concatenate([none, *classes])


def repeated(words: np.ndarray, start: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indexes of the windows that equal one of smaller rank in their group."""
    left, cls = multikey(words, start, group)
    if not len(left):
        return left
    least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, rank[left])
    return left[rank[left] > least[cls]]


def compared(rows: DataFrame) -> DataFrame:
    """Spans to remove (kind 0: doc, twin, start, stop), and windows of very large groups (kind 2: with two hashes)."""
    order = rows.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram", "doc", "twin", "at")
    names = ["kind", "one", "two", "doc", "twin", "start", "stop"]

    def load(held):
        t = pa.Table.from_batches(held)
        g, doc, twin, at = (t[c].to_numpy() for c in ("gram", "doc", "twin", "at"))
        parts = t["bytes"].to_pylist()
        raw = np.frombuffer(b"".join(parts) + b"\x00" * 8, np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first, anchor, more = unpacked(at)
        row = np.repeat(np.arange(len(g)), more + 1)
        k = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        return g, doc, twin, first, anchor, raw, np.cumsum(size) - size, row, k

    def spans(held):
        g, doc, twin, first, anchor, raw, offset, row, k = load(held)
        words = np.zeros(len(raw) - 7, np.uint64)
        for i in range(8):
            words = words << np.uint64(8) | raw[i : len(raw) - 7 + i]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        group = (np.cumsum(new)[row] << 7) + anchor[row] - k
        gone = np.sort(repeated(words, offset[row] + k, group, np.arange(len(g))[row]))
        if not len(gone):
            return None
        cut = np.ones(len(gone), bool)
        cut[1:] = (row[gone[1:]] != row[gone[:-1]]) | (k[gone[1:]] != k[gone[:-1]] + 1)
        s = gone[np.flatnonzero(cut)]
        e = gone[np.append(np.flatnonzero(cut)[1:], len(gone)) - 1]
        r = row[s]
        none = np.zeros(len(s), np.int64)
        cols = (none, none, none, doc[r], twin[r], first[r] + k[s], first[r] + k[e] + SPAN)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def windows(held):
        g, doc, twin, first, anchor, raw, offset, row, k = load(held)
        s = offset[row] + k
        two = Rolling(raw).spans(s, s + SPAN) ^ mix((anchor[row] - k).astype(np.uint64))
        cols = (np.full(len(row), 2), g[row], two.astype(np.int64), doc[row], twin[row], first[row] + k, first[row] + k + SPAN)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def run(batches):
        # held: whole groups, then the open one, which starts at row `since`
        held, size, since, gram, large = [], 0, 0, None, False
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in (1, 2, 3, 4)]
            own = distinct(*cols, last=before)
            before = tuple(c[-1] for c in cols)
            if not own.all():
                b = b.filter(pa.array(own))
            g = b.column(1).to_numpy()
            if not len(g):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if g[s] != gram:
                    if size >= 20_000 and (out := spans(held)):
                        yield out
                    if size >= 20_000 or large:
                        held, size = [], 0
                    gram, large, since = g[s], False, len(held)
                if large:
                    yield windows([b.slice(s, e - s)])
                    continue
                held.append(b.slice(s, e - s))
                size += e - s
                if sum(x.num_rows for x in held[since:]) > MOST:
                    for x in held[since:]:
                        yield windows([x])
                    large = True
                    if since and (out := spans(held[:since])):
                        yield out
                    held, size = [], 0
        if held and (out := spans(held)):
            yield out

    return order.mapInArrow(run, "kind long, one long, two long, doc long, twin long, start long, stop long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (doc, twin, start, stop) to remove; docs has doc, twin and bytes."""
    spark = docs.sparkSession
    settled = staged(settle(blocks(docs)))
    release(spark)
    rows = staged(fetched(docs, settled.where("kind = 1")))
    release(spark)
    found = staged(compared(rows))
    discard(rows)
    release(spark)
    whole = settled.where("kind = 0").select(
        "doc",
        "twin",
        F.expr("(at >> 14) & 4294967295L").alias("start"),
        F.expr(f"((at >> 14) & 4294967295L) + (at & 127) + {SPAN}").alias("stop"),
    )
    out = whole.union(found.where("kind = 0").select("doc", "twin", "start", "stop"))
    large = found.where("kind = 2")
    place = F.struct("doc", "twin", "start")
    first = large.groupBy("one", "two").agg(F.min(place).alias("first"))
    late = large.join(first, ["one", "two"]).where(F.col("first") < place)
    return out.union(late.select("doc", "twin", "start", "stop"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = identified(docs)
    cuts = repeated_spans(own.select("doc", "twin", "bytes"))
    lists = cuts.groupBy(F.col("doc").alias("d"), F.col("twin").alias("t")).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = own.join(lists, (F.col("doc") == F.col("d")) & (F.col("twin") == F.col("t")), "left").select("doc_id", "bytes", "starts", "stops")

    def run(batches):
        for b in batches:
            size, removed, spans, kept = [], [], [], []
            for text, starts, stops in zip(b.column(1), b.column(2), b.column(3), strict=True):
                raw, out, n, at = text.as_py(), [], 0, 0
                for s, e in sorted(zip(starts.as_py() or (), stops.as_py() or (), strict=True)):
                    if e <= at:
                        continue
                    if s > at or not n:
                        out.append(raw[at:s])
                        n += 1
                    at = max(at, e)
                out.append(raw[at:])
                kept.append(b"".join(out))
                size.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The rows of query op3."""
    return remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
