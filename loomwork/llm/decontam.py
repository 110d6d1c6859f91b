"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items are folded to words and cut into blocks of a bounded number of words; each block becomes one
automaton over words, which every Python worker builds once from a broadcast of that block, at about 400 bytes a
word. Document words stream through it and the length of the longest match that ends at each word shows the
windows that occur. A block has at most `block_words` words: parts of items are dealt by a hash of the id, the place and
the words themselves to buckets, until no bucket is larger, and buckets of known size fill the blocks. So the broadcast
has a bound whatever the benchmark's size and however often an id repeats; more blocks mean more passes over the
documents, never a larger broadcast, and no pass shuffles.

Defined results: a null or empty text has no words, no hits and no items. Null item texts and items without
words match nothing; a null item_id counts as the string "". Repeated items count once by id, and repeated rows of an
item with the same text once. Repeated documents are judged each on its own. Columns besides doc_id and text are ignored by
`find_contamination` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import ALNUM, fresh, replace_text, sliced, staged, text_bytes, utf8

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def fold(text: bytes) -> list[bytes]:
    """Lower-cased words of letters a-z, digits and characters above ASCII."""
    return text.translate(ALNUM).split()


class Automaton:
    """A suffix automaton of several word sequences, with the items at each window."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int):
        """items: (id, words, whole); `whole` items shorter than the window match as one window."""
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words, _ in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.top = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.top[s] = s if self.length[up] < window else self.top[up]
        self.at: dict[int, set[str]] = {}
        short: dict[int, set[str]] = {}
        for name, words, whole in items:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.at.setdefault(self.top[s], set()).add(name)
            if whole and 0 < len(words) < window:
                short.setdefault(s, set()).add(name)
        #: by state: the short items that end wherever it is reached
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        if short:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                own = [(self.length[s], short[s])] if s in short else []
                if chain := own + self.short.get(self.link[s], []):
                    self.short[s] = chain
        self.least = min([window, *(self.length[s] for s in short)])

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def scan(self, words: list[bytes], spans: list[list[int]], items: set[str]) -> None:
        """Adds the [start, end) word spans of the windows that occur, and their items."""
        nxt, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        root, s, n = nxt[0], 0, 0
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            if t is not None:
                s = t
                n += 1
            elif not s:
                continue
            elif w not in root:
                s = n = 0
                continue
            else:
                s = link[s]
                while w not in nxt[s]:
                    s = link[s]
                n = length[s] + 1
                s = nxt[s][w]
            if n >= least:
                size = 0
                if n >= window:
                    size = window
                    items |= self.at[self.top[s]]
                for k, ids in self.short.get(s, ()):
                    if k <= n:
                        size = max(size, k)
                        items |= ids
                if size:
                    start = i + 1 - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])


def blocks(bench: DataFrame, window: int, block_words: int) -> list[DataFrame]:
    """The items in blocks of at most block_words words; long items are cut with window - 1 words in common.

    The bound is four windows at least.
    """
    block_words = max(block_words, 4 * window)

    def cut(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for item, text in zip(ids, texts, strict=True):
                words = fold(text)
                step = block_words // 2 - window
                for k in range(0, max(1, len(words) - window + 1), step):
                    rows.append((item, k, b" ".join(words[k : k + step + window - 1]), len(words) < window))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.bool_()), strict=True)],
                names=["item", "part", "words", "whole"],
            )

    parts = (
        bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), utf8())
        .mapInArrow(cut, "item string, part long, words binary, whole boolean")
        .dropDuplicates(["item", "words", "whole"])
        .withColumn("size", F.size(F.split(F.col("words").cast("string"), " ")))
    )
    total = parts.agg(F.sum("size").alias("n")).first()["n"] or 0
    if total <= block_words:
        return [parts]
    n = 8 * -(-total // block_words)
    while True:
        bucket = F.pmod(F.xxhash64("item", "part", "words"), F.lit(n))
        # a row for each bucket, of which there are a few for each block
        sizes = sorted(((r["size"], r["bucket"]) for r in parts.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("size")).collect()), reverse=True)
        if sizes[0][0] <= block_words:
            break
        n *= 2
    filled: list[tuple[int, list[int]]] = []
    for size, k in sizes:
        if not filled or filled[-1][0] + size > block_words:
            filled.append((0, []))
        filled[-1] = (filled[-1][0] + size, [*filled[-1][1], k])
    return [parts.where(bucket.isin(own)) for _, own in filled]


#: The automaton that this Python worker built last, by the name of its block.
_built: dict[str, Automaton] = {}


def automaton(name: str, items: list[tuple[str, list[bytes], bool]], window: int) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(items, window)
    return _built[name]


def _pass(state: DataFrame, block: DataFrame, window: int, names: list[str]) -> DataFrame:
    items = [(r["item"], bytes(r["words"]).split(), r["whole"]) for r in block.select("item", "words", "whole").collect()]
    sent, name = state.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        auto = automaton(name, sent.value, window)
        for b in sliced(batches):
            h, m, n = (b.schema.get_field_index(c) for c in names)
            hits, ids, counts = b.column(h).to_pylist(), b.column(m).to_pylist(), []
            for i, text in enumerate(text_bytes(b)):
                words = fold(text)
                counts.append(len(words))
                spans: list[list[int]] = []
                found: set[str] = set()
                auto.scan(words, spans, found)
                if spans:
                    hits[i] = _union(hits[i] + [x for s in spans for x in s])
                    ids[i] = sorted(found.union(ids[i]))
            for c, values in ((h, hits), (m, ids), (n, counts)):
                b = b.set_column(c, b.schema.field(c), pa.array(values, b.schema.field(c).type))
            yield b

    return state.mapInArrow(run, state.schema)


def _union(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[0::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _matched(docs: DataFrame, bench: DataFrame, window: int, block_words: int) -> tuple[DataFrame, list[str]]:
    """docs with columns for the spans that are hit (flat), the items and the number of words; and their names."""
    names = fresh(docs, "hits", "items", "words")
    kinds = ("array<long>", "array<string>", "long")
    state = docs.withColumns({n: (F.array() if k[0] == "a" else F.lit(0)).cast(k) for n, k in zip(names, kinds, strict=True)})
    for k, block in enumerate(blocks(bench.select("item_id", "text"), window, block_words)):
        state = _pass(state if k == 0 else staged(state), block, window, names)
    return state, names


#: Words of a block of the benchmark.
BLOCK_WORDS = 200_000


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (flat word offsets), items."""
    found, (hits, items, words) = _matched(docs.select("doc_id", "text"), bench, window, block_words)
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(hits) - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 0, -1).otherwise(1) * F.col(hits)[i]
    )
    return found.select(
        "doc_id",
        F.col(words).alias("n_words"),
        F.when(F.size(hits) > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.col(hits).alias("spans"),
        F.col(items).alias("items"),
    )


def decontaminate(
    docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Removes the spans that occur in test items; drops documents of which over max_coverage is hit.

    Returns the columns of docs; documents without a hit keep their exact text.
    """
    found, (spans, *_) = _matched(docs, bench, window, block_words)
    names = docs.columns

    def cut(batches):
        for b in sliced(batches):
            hits = b.column(spans).to_pylist()
            texts, keep = b.column("text").to_pylist(), [True] * b.num_rows
            for i, flat in enumerate(hits):
                if flat:
                    raw = texts[i].encode()
                    at = [(m.start(), m.end()) for m in WORD.finditer(raw)]
                    keep[i] = sum(flat[1::2]) - sum(flat[0::2]) <= max_coverage * len(at)
                    out, pos = [], 0
                    for s, e in zip(flat[0::2], flat[1::2], strict=True):
                        out.append(raw[pos : at[s][0]])
                        pos = at[e - 1][1]
                    texts[i] = b"".join([*out, raw[pos:]]).decode("utf-8", "replace")
            yield replace_text(b.select(names), texts, keep)

    return found.mapInArrow(cut, docs.schema)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of query op1."""
    found = find_contamination(docs, bench)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
