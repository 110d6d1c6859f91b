"""Exact similarity join of documents by the Jaccard similarity of their word n-grams.

Documents with equal n-gram sets are one node. By prefix filtering, two sets that are similar enough share
one of the first tokens of each in any global order of tokens. The first of several orders brings candidates
together: its prefix tokens are shuffled as ids. The orders are hashes; n-grams that many documents have, found by
counting every batch, come last in the first order, so that they seldom lie in a prefix (`MOST_FREQUENT` bounds only how many;
no n-gram is dropped). Each node also carries its prefixes under `ORDERS` further orders, as short hashes; a pair of
nodes stays a candidate only if it shares a prefix token under every order, and the bitmaps of the sets, whose
distance bounds that of the sets, allow it. Only then are texts fetched, one for each node, and the sets compared.

Tokens with few sets give all their pairs. Larger groups first give only links to a leader and a neighbour;
when those have been verified and merged into components, only pairs of sets from different components of a
group are left. They are compared in blocks by bitmaps and orders, and verified: first only the nearest few of
each set, then, when those have been merged too, all that are left. So a large group of near copies costs about
as many verifications as it has members, and no link is lost. A group of more than `split` sets is not compared as
a whole: similar sets share a prefix token under each further order too, so it is parted by the prefix tokens of the
second order, parts that are still larger by those of the third, and parts inside one component are done. The bounds
`small`, `block`, `nearest` and `split` choose the path, never the result.

Defined results: a null text, or one without words, has no n-grams and is alone. Repeated documents and
documents with equal sets are linked. Null and repeated doc_ids, and ids of any type, are told apart by the hash of the text; a
null doc_id is the id of a component only if no member has another. Columns besides doc_id and text are ignored by
`join`, and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import SPACED, Words, discard, fresh, groups_of, mix, release, shingle_hashes, sliced, staged, text_hash, utf8
from loomwork.llm.components import components

#: Words of an n-gram, and the least similarity in percent.
GRAM, LEAST = 4, 85
#: Orders besides the first under which candidates must share a prefix token.
ORDERS = 2
#: Groups of up to so many sets give all their pairs at once.
SMALL = 6
#: Documents with an n-gram, in a slice of a batch, from which it goes to the end of the first order; most such n-grams.
FREQUENT, MOST_FREQUENT = 4, 200_000
#: Sets of a group that are compared in one task.
BLOCK = 4096
#: Fewest 64-bit words of the bitmap of a set.
BITS = 16
#: Nearest partners that a set proposes in each of its groups before all that are left are compared.
NEAREST = 3
#: Sets of a group from which it is parted by further orders: a set's rows for those are then fewer than for its blocks.
SPLIT = 16 * BLOCK
_FAR = np.uint64(1 << 63)
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(ORDERS)]


def prefix_length(n: int, least: int = LEAST) -> int:
    return n - (least * n + 99) // 100 + 1


def sets(texts: list[bytes], gram: int = GRAM):
    """The sorted distinct n-gram hashes of each text."""
    for _, part in groups_of(texts):
        words = Words(part, SPACED)
        every = shingle_hashes(words.hash, gram)
        for s, e in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if e - s < gram:
                yield shingle_hashes(words.hash[s:e], gram)
                continue
            x = np.sort(every[s : e - gram + 1])
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            yield x[new]


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = mix(x ^ np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64)
    b = mix(x + np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64)
    return int(mix(np.array([a]))[0].astype(np.int64)), int(mix(np.array([b]))[0].astype(np.int64))


def bitmap(x: np.ndarray) -> bytes:
    """Parity of the elements in each of at least 2 len(x) classes; two differ in no more bits than the sets in elements.

    The number of 64-bit words is a power of two; XOR of a bitmap's halves is the bitmap of half as many classes.
    """
    words = max(BITS, 1 << max(0, (len(x) // 32 - 1)).bit_length())
    odd = np.bincount((x >> np.uint64(20)) % np.uint64(64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


#: Prefix tokens from which their hashes are kept whole, at 32 bits; of fewer, 16 bits are kept.
WIDE = 128


def heads(x: np.ndarray, least: int) -> bytes:
    """Sorted short hashes of the prefix tokens of a set under each further order."""
    k = prefix_length(len(x), least)
    found = [np.partition(mix(x ^ seed), k - 1)[:k] for seed in SEEDS]
    # the low bits say nothing of the order
    return b"".join(np.sort(p.astype(np.uint32) if k > WIDE else p.astype(np.uint16)).tobytes() for p in found)


def orders_meet(x: bytes, n: int, y: bytes, m: int, least: int) -> bool:
    """Whether two sets of n and m tokens share a prefix token under every further order; seldom true without."""
    p, q = (np.frombuffer(h, np.uint32 if k > WIDE else np.uint16).reshape(ORDERS, k) for h, k in ((x, prefix_length(n, least)), (y, prefix_length(m, least))))
    if p.dtype != q.dtype:
        p, q = p.astype(np.uint16), q.astype(np.uint16)
    return all(len(np.intersect1d(a, b)) for a, b in zip(p, q, strict=True))


SIGNED = "who long, twin long, n long, a long, b long, bits binary, heads binary"


def signed(docs: DataFrame, gram: int, least: int) -> DataFrame:
    """A row of SIGNED and doc_id for each document, and rows (token, times) of the n-grams frequent in a slice of a batch.

    who and twin, hashes of doc_id and text, name a document; a and b are the signature of its set.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in sliced([b]):
                found = list(sets(part.column(3).to_pylist(), gram))
                names = [signature(x) for x in found]
                whole = {s: x for s, x in zip(names, found, strict=True)}
                token, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *whole.values()]), return_counts=True)
                token, times = token[times >= FREQUENT], times[times >= FREQUENT]
                rows = [
                    (len(x), *s, bitmap(x), heads(x, least) if len(x) else b"") for s, x in zip(names, found, strict=True)
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                n, m = len(rows), len(token)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                more = [pa.concat_arrays([pa.array(list(c), t), pa.nulls(m, t)]) for c, t in zip(cols, kinds, strict=True)]
                own = [pa.concat_arrays([part.column(k), pa.nulls(m, part.schema.field(k).type)]) for k in range(3)]
                last = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c.astype(np.int64))]) for c in (token, times)]
                yield pa.RecordBatch.from_arrays([*own, *more, *last], names=["doc_id", "who", "twin", "n", "a", "b", "bits", "heads", "token", "times"])

    return docs.select("doc_id", F.xxhash64("doc_id"), text_hash(), utf8()).mapInArrow(run, f"doc_id {kind}, {SIGNED}, token long, times long")


def frequent(counted: DataFrame) -> np.ndarray:
    """The n-grams that most documents of a batch have; at most MOST_FREQUENT, which only bounds the order's tail."""
    n = counted.groupBy("token").agg(F.sum("times").alias("n"))
    rows = n.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows["token"].to_numpy().astype(np.uint64))


def in_order(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of the tokens of a set in the first order: by hash, those in `last` at the end."""
    place = mix(x) >> np.uint64(1)
    if len(last):
        at = np.searchsorted(last, x)
        at[at == len(last)] = 0
        place = place | np.where(last[at] == x, _FAR, np.uint64(0))
    return place


def prefixes(docs: DataFrame, gram: int, least: int, last: np.ndarray) -> DataFrame:
    """Rows (token, n, a, b) of the prefix of each set; equal sets of a batch are taken once."""
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        late = sent.value
        for batch in sliced(batches):
            tokens, n, first, second = [], [], [], []
            for (a, b), x in {signature(x): x for x in sets(batch.column(0).to_pylist(), gram)}.items():
                if len(x):
                    k = prefix_length(len(x), least)
                    place = in_order(x, late)
                    tokens.append(np.partition(place, k - 1)[:k])
                    n.append(np.full(k, len(x)))
                    first.append(np.full(k, a))
                    second.append(np.full(k, b))
            if tokens:
                cols = [np.concatenate(tokens).astype(np.int64), *(np.concatenate(c).astype(np.int64) for c in (n, first, second))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "n", "a", "b"])

    return docs.select(utf8()).mapInArrow(run, "token long, n long, a long, b long")


PAIR = "xa long, xb long, ya long, yb long"


def first_links(rows: DataFrame, least: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Candidates of each token's group, and the members of large groups: kind, token, n, xa, xb, ya, yb."""
    order = rows.repartition("token").sortWithinPartitions("token", "n", "a", "b")

    def pairs(n, a, b, part):
        """Of a group, or a part of one, in order of size: (i, j) of its candidates, and its members if more are left."""
        keep = np.ones(len(n), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(keep)
        if len(at) < 2:
            return [], [], at if part else []
        if len(at) <= small:
            i, j = np.triu_indices(len(at), 1)
        else:
            lead = np.zeros(len(at), np.int64)
            for k in range(1, len(at)):
                lead[k] = lead[k - 1] if 100 * n[at[lead[k - 1]]] >= least * n[at[k]] else k
            j = np.arange(1, len(at))
            i, j = np.concatenate([lead[1:], j - 1]), np.concatenate([j, j])
        fits = (i != j) & (100 * n[at[i]] >= least * n[at[j]])
        return at[i[fits]], at[j[fits]], at if part or len(at) > small else []

    def group(held, part):
        t, n, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        return t, n, a, b, pairs(n, a, b, part)

    def batch(done):
        links = [np.stack([a[i], b[i], a[j], b[j]], 1) for _, _, a, b, (i, j, _) in done if len(i)]
        members = [np.stack([t[m], n[m], a[m], b[m]], 1) for t, n, a, b, (_, _, m) in done if len(m)]
        link = np.concatenate([np.zeros((0, 4), np.int64), *links])
        member = np.concatenate([np.zeros((0, 4), np.int64), *members])
        if len(link):
            link = np.unique(link, axis=0)
        none = np.zeros(len(link), np.int64)
        cols = [
            np.concatenate([none, none[:0], np.ones(len(member), np.int64)]),
            np.concatenate([none, member[:, 0]]),
            np.concatenate([none, member[:, 1]]),
            np.concatenate([link[:, 0], member[:, 2]]),
            np.concatenate([link[:, 1], member[:, 3]]),
            np.concatenate([link[:, 2], none[:0], np.zeros(len(member), np.int64)]),
            np.concatenate([link[:, 3], none[:0], np.zeros(len(member), np.int64)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "token", "n", "xa", "xb", "ya", "yb"])

    def run(batches):
        held, size, part, done, waiting = [], 0, False, [], 0
        for rb in batches:
            t, n, a, b = (c.to_numpy() for c in rb.columns)
            if not len(t):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[-1][0][0] != t[s] or size >= block * 16):
                    again = held[-1][0][0] == t[s]
                    if size > 1 or part:
                        done.append(group(held, part or again))
                        waiting += size
                    held, size, part = [], 0, again
                held.append((t[s:e], n[s:e], a[s:e], b[s:e]))
                size += e - s
            if waiting > 100_000:
                yield batch(done)
                done, waiting = [], 0
        if held and (size > 1 or part):
            done.append(group(held, part))
        if done:
            yield batch(done)

    return order.mapInArrow(run, f"kind long, token long, n long, {PAIR}")


def similar(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two sets are similar enough."""
    if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= least * (len(x) + len(y) - both)


def filtered(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs that share prefix tokens under all orders and whose bitmaps differ in no more bits than similar sets can."""
    x = nodes.select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("n").alias("xn"), F.col("bits").alias("x"), F.col("heads").alias("p"))
    y = nodes.select(F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("n").alias("yn"), F.col("bits").alias("y"), F.col("heads").alias("q"))

    def run(batches):
        for rb in batches:
            keep = []
            for n, m, x, y, p, q in zip(*(rb.column(k).to_pylist() for k in range(4, 10)), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(u) != len(v):
                    u, v = (folded(u), v) if len(u) > len(v) else (u, folded(v))
                near = (100 + least) * int(np.bitwise_count(u ^ v).sum()) <= (100 - least) * (n + m)
                keep.append(near and orders_meet(p, n, q, m, least))
            yield rb.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(x, ["xa", "xb"]).join(y, ["ya", "yb"]).where((100 * F.least("xn", "yn")) >= (least * F.greatest("xn", "yn")))
    return both.select("xa", "xb", "ya", "yb", "xn", "yn", "x", "y", "p", "q").mapInArrow(run, PAIR)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, gram: int, least: int) -> DataFrame:
    """The pairs (x, y) of signatures whose sets are similar enough, as edges (u, v).

    nodes: (a, b, who, twin), a document of each signature, by which its text is fetched.
    """
    pairs = staged(filtered(pairs, nodes, least))
    release(pairs.sparkSession)
    asked = pairs.select("xa", "xb").union(pairs.select("ya", "yb")).distinct().toDF("a", "b")
    wanted = asked.join(nodes.select("a", "b", "who", "twin"), ["a", "b"])
    # repeated rows of a document are one: a text for each signature
    own = docs.select(F.xxhash64("doc_id").alias("who"), text_hash().alias("twin"), utf8().alias("bytes")).dropDuplicates(["who", "twin"])
    texts = staged(own.join(wanted, ["who", "twin"]).select("a", "b", "bytes"))
    release(texts.sparkSession)
    one, two = texts.toDF("xa", "xb", "x"), texts.toDF("ya", "yb", "y")
    both = pairs.join(one, ["xa", "xb"]).join(two, ["ya", "yb"]).select("xa", "xb", "ya", "yb", "x", "y")

    def run(batches):
        for rb in batches:
            # neighbouring rows often share a text
            memo: dict[bytes, np.ndarray] = {}

            def of(v, memo=memo):
                if v not in memo:
                    if len(memo) > 64:
                        memo.clear()
                    memo[v] = next(sets([v], gram))
                return memo[v]

            good = [similar(of(x.as_py()), of(y.as_py()), least) for x, y in zip(rb.column(4), rb.column(5), strict=True)]
            yield rb.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    edges = both.mapInArrow(run, PAIR)
    out = staged(edges.distinct().select(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("u"), F.struct(F.col("ya").alias("a"), F.col("yb").alias("b")).alias("v")))
    discard(pairs, texts)
    return out


def parted(members: DataFrame, nodes: DataFrame, order: int, least: int) -> DataFrame:
    """Members of groups (token, n, c, a, b) in the parts of each: one for each prefix token under a further order."""
    rows = members.select("token", "n", "c", "a", "b").join(nodes.select("a", "b", "heads"), ["a", "b"]).select("token", "n", "c", "a", "b", "heads")

    def run(batches):
        for part in sliced(batches):
            found = [np.zeros(0, np.uint64)]
            for n, raw in zip(part.column(1).to_pylist(), part.column(5).to_pylist(), strict=True):
                k = prefix_length(n, least)
                own = np.frombuffer(raw, np.uint32 if k > WIDE else np.uint16).reshape(ORDERS, k)[order]
                found.append(np.unique(own.astype(np.uint16)).astype(np.uint64))
            at = np.repeat(np.arange(part.num_rows), [len(x) for x in found[1:]])
            token = mix(part.column(0).to_numpy().astype(np.uint64)[at] ^ mix(np.concatenate(found) + np.uint64(order << 16)))
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), *(part.column(k).take(pa.array(at)) for k in range(1, 5))], names=["token", "n", "c", "a", "b"])

    return rows.mapInArrow(run, "token long, n long, c long, a long, b long")


def mixed_groups(rows: DataFrame, nodes: DataFrame, least: int, split: int) -> list[DataFrame]:
    """Members of groups with several components, with the group's size; those beyond `split` in parts. All are staged."""
    out = []
    for order in range(ORDERS + 1):
        n = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"))
        known = staged(rows.join(n.where("lo <> hi").select("token", "size"), "token"))
        if out:
            discard(rows)
        out.append(known)
        if order == ORDERS or (large := known.where(F.col("size") > split)).isEmpty():
            break
        rows = staged(parted(large, nodes, order, least))
        out[-1] = known.where(F.col("size") <= split)
        out[-1]._staged_at = known._staged_at
    return out


def later_links(members: DataFrame, nodes: DataFrame, roots: DataFrame, least: int, most: int | None = None, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """Pairs of members of a group that are in different components and whose bitmaps are near enough; staged.

    With `most`, each member of a group proposes only its nearest few, which merge most of a large group.
    """
    root = roots.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.xxhash64("root.a", "root.b").alias("c"))
    placed = members.join(root, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.xxhash64("a", "b")))
    groups = mixed_groups(placed.select("token", "n", "c", "a", "b"), nodes, least, split)
    known = reduce(DataFrame.unionByName, groups)
    # members meet in blocks: a block pair for every two blocks of a group
    blocks = F.ceil(F.col("size") / block).cast("long")
    own = F.pmod(F.xxhash64("a", "b"), blocks)
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "c", "a", "b")
    dealt = dealt.join(nodes.select("a", "b", "bits"), ["a", "b"])
    order = dealt.select("token", "i", "j", "own", "n", "c", "a", "b", "bits").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "a", "b")

    def compare(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        n, c, a, b, own = (t[x].to_numpy() for x in ("n", "c", "a", "b", "own"))
        keep = np.ones(len(n), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        n, c, a, b, own = (x[keep] for x in (n, c, a, b, own))
        raw = [x for x, k in zip(t["bits"].to_pylist(), keep, strict=True) if k]
        size = np.array([len(x) // 8 for x in raw])
        # sets of similar size have bitmaps of one size, or one twice as large, which is folded
        whole = {w: np.frombuffer(b"".join(x for x in raw if len(x) == 8 * w), np.uint64).reshape(-1, w) for w in np.unique(size).tolist()}
        half = {w // 2: folded(m) for w, m in whole.items()}
        place = np.zeros(len(n), np.int64)
        for w in whole:
            place[size == w] = np.arange((size == w).sum())
        two = t["i"][0].as_py() != t["j"][0].as_py()
        for k in range(len(n) - 1):
            end = np.searchsorted(n, 100 * n[k] // least, "right")
            j = np.arange(k + 1, end)
            j = j[(c[j] != c[k]) & ((own[j] != own[k]) if two else True)]
            if not len(j):
                continue
            w = int(size[k])
            apart = np.zeros(len(j), np.int64)
            for of, among in ((w, whole), (2 * w, half)):
                at = np.flatnonzero(size[j] == of)
                if len(at):
                    apart[at] = np.bitwise_count(among[w][place[j[at]]] ^ whole[w][place[k]]).sum(1)
            fits = np.flatnonzero((100 + least) * apart <= (100 - least) * (n[j] + n[k]))
            if most and len(fits) > most:
                fits = fits[np.argpartition(apart[fits], most - 1)[:most]]
            j = j[fits]
            if len(j):
                yield np.stack([np.full(len(j), a[k]), np.full(len(j), b[k]), a[j], b[j]], 1)

    def run(batches):
        def found(held):
            x = np.concatenate([np.zeros((0, 4), np.int64), *compare(held)])
            return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], names=["xa", "xb", "ya", "yb"])

        held, key = [], None
        for rb in batches:
            t, i, j = (rb.column(k).to_numpy() for k in range(3))
            if not len(t):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(t)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (t[s], i[s], j[s]) != key:
                    yield found(held)
                    held = []
                key = (t[s], i[s], j[s])
                held.append(rb.slice(s, e - s))
        if held:
            yield found(held)

    out = staged(order.mapInArrow(run, PAIR).distinct())
    discard(*groups)
    return out


def classes(docs: DataFrame, gram: int = GRAM, least: int = LEAST, small: int = SMALL, block: int = BLOCK, nearest: int = NEAREST, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, twin, n, a, b of each document; a, b, ra, rb: the component's root of each signature)."""
    docs = docs.select("doc_id", "text")
    rows = staged(signed(docs, gram, least))
    last = frequent(rows.where("token is not null"))
    own = rows.where("n is not null")
    nodes = staged(
        own.where("n > 0")
        .groupBy("a", "b")
        .agg(F.min(F.struct("who", "twin")).alias("of"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("heads").alias("heads"))
        .select("a", "b", "of.who", "of.twin", "n", "bits", "heads")
    )
    linked = staged(first_links(prefixes(docs, gram, least, last), least, small, block))
    release(docs.sparkSession)
    found = verified(linked.where("kind = 0").select("xa", "xb", "ya", "yb").distinct(), nodes, docs, gram, least)
    roots = components(found)
    discard(found)
    members = linked.where("kind = 1").select("token", "n", F.col("xa").alias("a"), F.col("xb").alias("b")).distinct()
    for most in (nearest, None):
        more = later_links(members, nodes, roots, least, most, block, split)
        release(docs.sparkSession)
        if more.isEmpty():
            break
        # the components so far are stars already, which saves rounds
        found = verified(more, nodes, docs, gram, least)
        roots = components(found.union(roots.toDF("u", "v")))
        discard(more, found)
    discard(linked)
    root = roots.select("node.a", "node.b", F.col("root.a").alias("ra"), F.col("root.b").alias("rb"))
    placed = nodes.select("a", "b").join(root, ["a", "b"], "left")
    return own.select("doc_id", "twin", "n", "a", "b"), placed.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))


def join(docs: DataFrame, gram: int = GRAM, least: int = LEAST, **bounds: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    own, placed = classes(docs, gram, least, **bounds)
    smallest = own.where("n > 0").join(placed, ["a", "b"]).groupBy("ra", "rb").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, ["ra", "rb"]).select("a", "b", "component_id")
    return own.join(named, ["a", "b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """The rows of docs without those of a component but its smallest by doc_id (null last), then text hash.

    Documents without n-grams all stay.
    """
    own, placed = classes(docs, gram, least)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin")
    member = own.where("n > 0").join(placed, ["a", "b"]).select("doc_id", "twin", "ra", "rb", place.alias("place"))
    best = member.groupBy("ra", "rb").agg(F.min("place").alias("best"), F.count("*").alias("size")).where("size > 1")
    # rows to drop; equal rows of the kept document are told apart below
    twin, doc, same, n, first = fresh(docs, "twin", "doc", "same", "n", "first")
    drop = staged(
        member.join(best, ["ra", "rb"])
        .groupBy(F.col("doc_id").alias(doc), F.col("twin").alias(same))
        .agg(F.count("*").alias(n), F.bool_or(F.col("place") == F.col("best")).alias(first))
        .where(f"not {first} or {n} > 1")
    )
    equal = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(twin) == F.col(same))
    marked = docs.withColumn(twin, text_hash())
    kept = marked.join(drop, equal, "left_anti").select(docs.columns)
    again = drop.where(first)
    if again.isEmpty():
        return kept
    once = marked.join(again, equal, "left_semi").dropDuplicates(["doc_id", twin])
    return kept.unionByName(once.select(docs.columns))
