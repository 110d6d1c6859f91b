"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents become token ids and an end id, cut into pieces of at most `size` ids. Pieces go to random groups
of about `group` pieces by a hash; each group is packed on its own, the longest piece first, into the first
bin with room, which a tournament tree over the bins' free space finds in logarithmic time. A group that
outgrows `most` pieces would be packed in several runs, so memory stays bounded; groups are counted in pieces and dealt
evenly, so none of usual `group` does.

Defined results: a null or empty text is the end id alone, one piece of length one. Repeated documents are
packed each on its own; so that many equal rows don't meet in one group, a row's place in its batch is part of the hash, and
sequence ids depend on how the input is dealt. Columns besides doc_id and text are ignored; a null doc_id stays null; ids of any type.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import staged, utf8

END = 1
SPECIAL = "<|endoftext|>"


@cache
def encoder(vocabulary: str):
    """text -> ids as `tokenizers` gives them for the JSON vocabulary.

    The rank file beside it holds the same vocabulary and is several times as fast; it is taken for texts
    without the special token, where both give the same ids (tests compare them).
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


class Tournament:
    """Free space of bins; finds the first bin with room for a piece."""

    def __init__(self, most: int, size: int):
        self.leaves = 1 << max(1, most - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, free space there before): the leftmost bin that has room, whose space shrinks."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        free = room[k]
        room[k] = free - length
        leaf = k
        k //= 2
        while k:
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
            k //= 2
        return leaf - self.leaves, free


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must fall."""
    tree = Tournament(len(lengths), size)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        bins[i], free = tree.place(n)
        offsets[i] = size - free
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, salt); salt is the row's place in its batch."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, raw in enumerate(b.column(1)):
                ids = np.array([*encode(raw.as_py().decode("utf-8", "replace")), END], "<u4")
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    row.append(i)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, row))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"],
            )

    return docs.select("doc_id", utf8()).mapInArrow(
        run, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    )


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = 2048, group: int = 8192, most: int = 1 << 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    # pieces are a few numbers each; they are counted as they are, since long texts have many
    parts = staged(pieces(docs, vocabulary, size))
    groups = max(1, round(parts.count() / group))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups))
    dealt = parts.withColumn("group", key).drop("salt").repartition("group")
    order = dealt.sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids_crc32")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(rows: list[pa.RecordBatch], k: int, at: int) -> tuple[pa.RecordBatch, int]:
        run = pa.Table.from_batches(rows).combine_chunks()
        bins, offsets = first_fit_decreasing(run["length"].to_numpy(), size)
        out = run.drop_columns(["group"])
        out = out.append_column("sequence_id", pa.array((np.int64(k) << np.int64(28)) + at + bins))
        out = out.append_column("offset", pa.array(offsets))
        return out.to_batches()[0], at + int(bins.max()) + 1

    def run(batches):
        held, k, n, at = [], None, 0, 0
        for b in batches:
            g = b.column(b.schema.get_field_index("group")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and (g[s] != k or n >= most):
                    done, at = packed(held, k, at)
                    yield done
                    held, n, at = [], 0, at if g[s] == k else 0
                k = int(g[s])
                held.append(b.slice(s, e - s))
                n += e - s
        if held:
            yield packed(held, k, at)[0]

    return order.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
