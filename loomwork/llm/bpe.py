"""Encoding and decoding with a byte-level BPE vocabulary, by chunks that documents share.

A rolling hash of the last `WINDOW` bytes cuts texts where its leading bits are zero, so equal passages have equal chunks wherever they
stand. Documents are dealt by the least hash of their lines, in ranges, and sorted by it, so that texts
with much in common stand together; a task encodes a chunk once and finds it again, by its bytes, in a memory of bounded size.

At a join of two chunks the words that the tokenizer cuts texts into may be others than those of the chunks. Words are found from left to
right and depend on nothing to their left, so two scans that have one start of a word in common have all later ones in
common. The last word of the left chunk is joined to the head of the right one and cut into words again, further and further, until a
start agrees with the right chunk's own; the words before it are encoded anew, and the right chunk's ids hold from there up to its own last word.
Without agreement the whole chunk joins what is encoded anew. Texts are cut at special tokens first, as the tokenizer does.

Defined results: a null or empty text has no ids; text that equals a special token is that token. Repeated documents
each have a row; doc_id may be null and of any type; other columns are ignored. Very long texts are taken
in chunks; their ids are held as 4 bytes each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections import OrderedDict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import CHUNK, groups_of, mix, sliced, text_bytes

#: Bytes that decide a cut, and the least, the usual and the largest distance of cuts.
WINDOW, LEAST, USUAL, LARGEST = 32, 256, 1024, 4096
#: Bytes of chunks that a task remembers.
MEMORY = 24 << 20
#: Texts above this size go through the library itself, whose time is almost linear in the longest word.
SHORT = 1 << 14
#: Heads that are compared for agreement, in bytes; then the whole chunk.
HEADS = (48, 256)
#: Bytes from the start of a word that can decide where it ends, besides the character after it: those of 'll.
AHEAD = 3
#: A visible ASCII character before white space: a word ends between them in every scan.
EDGE = re.compile(rb"[!-~][ \n]")
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def candidates(buffer: bytes) -> np.ndarray:
    """Places before which a text may be cut: the rolling hash hits, and a character starts."""
    raw = np.frombuffer(buffer, np.uint8)
    h, n = _GEAR[raw], 1
    while n < WINDOW:
        later = h.copy()
        later[n:] += h[:-n] << np.uint32(n)
        h, n = later, 2 * n
    at = np.flatnonzero(h < np.uint32((1 << 32) // USUAL)) + 1
    at = at[at < len(raw)]
    return at[(raw[at] & 0xC0) != 0x80]


def character(text: bytes, at: int) -> int:
    """The last start of a character up to a place."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunks(text: bytes, cuts: list[int]):
    """The text in parts at cuts that are LEAST apart; where there are none for LARGEST bytes, it is cut there."""
    start = 0
    for c in [*cuts, len(text)]:
        while c - start > LARGEST:
            end = character(text, start + LARGEST)
            yield text[start:end]
            start = end
        if c - start >= LEAST or c == len(text) > start:
            yield text[start:c]
            start = c


class Codec:
    """Encodes texts by chunks, which it remembers."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("special tokens that take in text around them are not supported")
        self.special = {a["content"].encode(): a["id"] for a in added}
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.bytes = [b""] * self.library.get_vocab_size()
        plain = byte_of_letter()
        for token, k in self.library.get_vocab().items():
            self.bytes[k] = token.encode() if token.encode() in self.special else bytes(plain[c] for c in token)
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.decimal = [b"%d," % k for k in range(len(self.bytes))]
        self.memory: OrderedDict[bytes, tuple] = OrderedDict()
        self.held = self.encoded = self.reused = 0

    def plain(self, text: bytes) -> np.ndarray:
        """Ids of a text without special tokens."""
        s = text.decode()
        return np.array(self.fast.encode_ordinary(s) if self.fast and len(text) <= SHORT else self.library.encode(s, add_special_tokens=False).ids, np.int32)

    def starts(self, text: bytes) -> list[int]:
        """The bytes at which the tokenizer's words start."""
        s = text.decode()
        places = [a for _, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(s)]
        if len(s) == len(text):
            return places
        out, byte, last = [], 0, 0
        for p in places:
            byte += len(s[last:p].encode())
            last = p
            out.append(byte)
        return out

    def settled(self, text: bytes) -> list[int]:
        """The starts that stay as they are whatever follows: each word before them has room for `AHEAD` bytes."""
        found = self.starts(text)
        return [q for p, q in zip([-AHEAD, *found], found, strict=False) if p + AHEAD <= len(text)]

    def last_word(self, chunk: bytes) -> int:
        """The last settled start of a word in a chunk."""
        found = 0
        for m in EDGE.finditer(chunk, max(0, len(chunk) - 192), max(0, len(chunk) - AHEAD)):
            found = m.start() + 1
        return found + self.settled(chunk[found:])[-1]

    def chunk(self, chunk: bytes) -> tuple[np.ndarray, int, int]:
        """(ids, start of the last word, ids before it), from memory where the chunk is there."""
        if (known := self.memory.get(chunk)) is not None:
            self.memory.move_to_end(chunk)
            self.reused += 1
            return known
        ids, tail = self.plain(chunk), self.last_word(chunk)
        left, n = len(chunk) - tail, len(ids)
        while left > 0:
            n -= 1
            left -= self.length[ids[n]]
        known = self.memory[chunk] = ids, tail, n
        self.encoded += 1
        self.held += len(chunk) + ids.nbytes + 256
        while self.held > MEMORY and len(self.memory) > 1:
            old, (gone, _, _) = self.memory.popitem(last=False)
            self.held -= len(old) + gone.nbytes + 256
        return known

    def agreement(self, pending: bytes, chunk: bytes, tail: int) -> tuple[int, list[bytes]] | None:
        """The first start of a word in the chunk, up to its last word, that is one after `pending` as well; the words before it."""
        for n in (*HEADS, len(chunk)):
            head = chunk[: character(chunk, min(n, len(chunk)))]
            text = pending + head
            starts = self.settled(text)
            joined = {p - len(pending) for p in starts}
            for q in self.settled(head):
                if q > tail:
                    return None
                if q in joined:
                    ends = [p for p in starts if p <= q + len(pending)]
                    return q, [text[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            if len(head) == len(chunk):
                return None
        return None

    def joined(self, parts) -> list[np.ndarray]:
        """Ids of the parts' text."""
        out, pending, tried = [], b"", 0
        for part in parts:
            ids, tail, before = self.chunk(part)
            if not pending:
                out.append(ids[:before])
                pending, tried = part[tail:], 0
                continue
            # a word that runs over several chunks is cut into words again each time that it has doubled
            if len(pending) < 2 * tried or (found := self.agreement(pending, part, tail)) is None:
                if len(pending) >= 2 * tried:
                    tried = len(pending)
                pending += part
                continue
            q, words = found
            # word by word: without what follows, white space would be cut otherwise
            out += map(self.plain, words)
            skip = int(np.searchsorted(self.length[ids[:q]].cumsum(), q)) + 1 if q else 0
            out.append(ids[skip:before])
            pending, tried = part[tail:], 0
        if pending:
            out.append(self.plain(pending))
        return out

    def encode(self, text: bytes, cuts: np.ndarray | None = None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        at = candidates(text) if cuts is None else cuts
        out, start = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            end = m.start() if m else len(text)
            if end > start:
                own = at[np.searchsorted(at, start, "right") : np.searchsorted(at, end)] - start
                out += self.joined(chunks(text[start:end], own.tolist()))
            if m:
                out.append(np.array([self.special[m.group()]], np.int32))
                start = m.end()
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; those that make no UTF-8 are decoded by the library."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)

    def every(self, texts: list[bytes]):
        """Ids of each text; the hash runs over many texts at once."""
        for _, group in groups_of(texts, CHUNK):
            at, start = candidates(b"".join(group)), 0
            for t in group:
                low, high = np.searchsorted(at, (start, start + len(t)))
                # near a start the hash has seen the text before: such cuts are left out, so cuts depend on the text alone
                own = at[low:high] - start
                yield self.encode(t, own[own >= WINDOW])
                start += len(t)


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: visible Latin-1 characters for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def codec(vocabulary: str) -> Codec:
    """One for each worker process, so that later tasks find its chunks."""
    return Codec(vocabulary)


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text), texts with the same least line hash side by side; ranges of both columns split large groups."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.array_min(F.transform(F.split(text, "\n"), lambda x: F.xxhash64(x))).alias("line"))
    rows = rows.withColumn("salt", F.xxhash64("doc_id"))
    return rows.repartitionByRange("line", "salt").sortWithinPartitions("line", "salt").select("doc_id", "text")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        c = codec(vocabulary)
        for b in sliced(batches, 256):
            ids = [pa.array(x) for x in c.every(text_bytes(b))]
            places = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            lists = pa.LargeListArray.from_arrays(places, pa.concat_arrays(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return grouped(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are none."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        c = codec(vocabulary)
        for b in sliced(batches, 256):
            texts = [c.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` and then `decode` give, in one pass."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        c = codec(vocabulary)
        for b in sliced(batches, 256):
            n, ids_sha, text_sha = [], [], []
            for ids in c.every(text_bytes(b)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join(map(c.decimal.__getitem__, ids.tolist()))[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return grouped(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
