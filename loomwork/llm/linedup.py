"""Removal of repeated runs of lines, by a suffix array over sequences of line ids.

A document is the sequence of its lines that are not blank. The suffixes of all documents are ranked by
distributed prefix doubling: ranks by the first k lines, paired with the ranks k lines on, give the ranks by
the first 2k lines. After the first round, a round doubles three times at once, pairing the ranks at k, 2k and
so on up to 7k lines on, which saves two of three sorts. A rank counts the suffixes with smaller prefixes,
found by sorting the distinct tuples in range partitions and adding up their sizes. Suffixes that share their
rank at depth k form a longest-common-prefix interval of at least k lines; those alone in their interval have
their final place and leave, so each round handles only what still repeats. The deepest interval of a suffix in
which an earlier one stands says how many lines repeat there, and where they stand first. Where intervals of a document
overlap or touch and lead to the same lines of one earlier place, they make up one maximal repeated run (`runs`);
a run inside another one is none of its own.

The lines of maximal runs of `least` lines or more are removed: they also start earlier, in a smaller doc_id
or before in the same document; the first copy of a run stays. `dedup_lines` also removes later copies of a
line of `ALONE` words or more; the rows of the query, which its SQL defines, count runs only. Only DataFrame functions are used.

Defined results: a null or empty text has no lines. Blank lines are never removed and don't part a run. Rows
with equal doc_id and text count as one document and get the same result; a null doc_id comes first, and equal
doc_ids with different texts are ordered by a hash; ids can be of any type. Other columns, whatever their names, pass through `dedup_lines` unchanged but for
n_chars, which follows the text; documents left without a line are dropped there, unless they had none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import fresh, staged, text_hash

#: Shortest run that is removed, in lines.
LEAST = 2
#: Words from which a repeated line of its own is removed as well, by `dedup_lines`.
ALONE = 50
#: How many times as deep each round after the first compares.
WIDER = 8


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def filled(lines: Column) -> Column:
    """Indexes of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())


def occurrences(docs: DataFrame, alone: int | None = None) -> DataFrame:
    """doc, twin (a hash of the text), pos, and two hashes of the line, for the lines that are not blank.

    With `alone`, also whether the line has as many words.
    """
    lines = lines_of(F.col("text"))
    solid = F.filter(lines, lambda x: x.rlike(r"\S"))
    # each row carries two small hashes of its line; together they stand for the line's content
    def long(x):
        # lines too short for the words are not split
        return [] if alone is None else [F.when(F.length(x) >= 2 * alone - 1, F.regexp_count(x, F.lit(r"\S+")) >= alone).otherwise(False).alias("long")]

    ids = F.transform(solid, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), *long(x)))
    own = docs.select(F.col("doc_id").alias("doc"), text_hash().alias("twin"), ids.alias("ids")).dropDuplicates(["doc", "twin"])
    return own.select("doc", "twin", F.posexplode("ids").alias("pos", "id")).select("doc", "twin", "pos", "id.*")


def place() -> Column:
    return F.struct("doc", "twin", "pos")


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys that more than one suffix has, with their rank, first suffix and number of suffixes.

    Keys are counted before the shuffle, so a frequent one is a row for each task. Range partitions hold
    them in order; each partition's ranks start at the number of suffixes in those before it.
    """
    tuples = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1")
    dealt = staged(tuples.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    # one row for each partition of the cluster's setting
    starts = dealt.groupBy("part").agg(F.sum("n").alias("n")).withColumn(
        "start", F.sum("n").over(Window.orderBy("part")) - F.col("n")
    )
    within = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(starts.select("part", "start")), "part").select(
        *key, "first", "n", (F.col("start") + F.sum("n").over(within) - F.col("n")).alias("rank")
    )


def repeats(docs: DataFrame, least: int = LEAST, alone: int | None = None) -> DataFrame:
    """Suffixes that share `least` lines or more with an earlier one: doc, twin, pos, depth, first, copies.

    A suffix has a row for each depth reached (least, and that times the powers of WIDER) at which it repeats, with
    the first suffix of its interval there and the interval's size. With `alone`, a repeated line of as many
    words has a row of depth 0. The first round joins the ranks of the first `least` lines one by one, as they are few.
    """
    rows, key, depth, found = occurrences(docs, alone), ["a", "b"], 1, None
    said = ["doc", "twin", "pos", "first", "copies"]
    while True:
        classes = ranked(rows.dropna(subset=key), key)
        named = rows.drop("first", "copies").join(classes, key).select(
            "doc", "twin", "pos", F.col("rank").alias("k0"), "first", F.col("n").alias("copies"), *(["long"] if alone and depth == 1 else [])
        )
        if depth >= least:
            times, step = WIDER, depth
        else:
            times, step = least, 1
        key = [f"k{i}" for i in range(times)]
        order = Window.partitionBy("doc", "twin").orderBy("pos")
        rows = staged(named.withColumns({f"k{i}": F.max("k0").over(order.rangeBetween(i * step, i * step)) for i in range(1, times)}))
        again = rows.where(F.col("first") < place())
        if alone and depth == 1:
            found = again.where("long").select(*said, F.lit(0).alias("depth"))
        if depth >= least:
            own = again.select(*said, F.lit(depth).alias("depth"))
            found = own if found is None else found.unionByName(own)
        if rows.where(F.col(key[-1]).isNotNull()).isEmpty():
            return found if found is not None else rows.select(*said, F.lit(depth).alias("depth")).limit(0)
        depth *= times


def runs(found: DataFrame) -> DataFrame:
    """Maximal repeated runs from the rows of `repeats`: doc, twin, start, stop, first (the place of the first copy), copies, depth.

    All windows divide by document, so the rows are shuffled once.
    """
    own = found.where("depth > 0").repartition("doc", "twin")
    deepest = F.row_number().over(Window.partitionBy("doc", "twin", "pos").orderBy(F.desc("depth")))
    own = own.withColumn("nth", deepest).where("nth = 1").select(
        "doc", "twin", "pos", "depth", "copies", "first", (F.col("pos") + F.col("depth")).alias("stop"), (F.col("pos") - F.col("first.pos")).alias("apart")
    )
    lane = Window.partitionBy("doc", "twin", "first.doc", "first.twin", "apart").orderBy("pos")
    before = F.max("stop").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.when(before >= F.col("pos"), 0).otherwise(1)).withColumn("run", F.sum("new").over(lane))
    whole = own.groupBy("doc", "twin", F.col("first.doc").alias("of"), F.col("first.twin").alias("of_twin"), "apart", "run").agg(
        F.min("pos").alias("start"), F.max("stop").alias("stop"), F.min_by("copies", "pos").alias("copies"), F.max("depth").alias("depth")
    )
    reached = F.max("stop").over(Window.partitionBy("doc", "twin").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1))
    first = F.struct(F.col("of").alias("doc"), F.col("of_twin").alias("twin"), (F.col("start") - F.col("apart")).alias("pos"))
    return (
        whole.withColumn("reached", reached)
        .where("reached is null or reached < stop")
        .select("doc", "twin", "start", "stop", first.alias("first"), "copies", "depth")
    )


def removals(docs: DataFrame, least: int = LEAST, alone: int | None = None) -> DataFrame:
    """doc, twin, gone (positions of the lines to remove), deepest."""
    found = repeats(docs, least, alone)
    cuts = runs(found).select("doc", "twin", F.sequence("start", F.col("stop") - 1).alias("lines"), "depth")
    if alone is not None:
        cuts = cuts.unionByName(found.where("depth = 0").select("doc", "twin", F.array("pos").alias("lines"), "depth"))
    return (
        cuts.groupBy("doc", "twin")
        .agg(F.collect_list("lines").alias("lines"), F.max("depth").alias("deepest"))
        .select("doc", "twin", F.array_distinct(F.flatten("lines")).alias("gone"), "deepest")
    )


class _Marked:
    """docs with helper columns: lines, solid (places of those not blank), and gone and deepest, null where nothing goes.

    The arrays are made before the join, so that no expression on the rows after it computes them again.
    """

    def __init__(self, docs: DataFrame, least: int, alone: int | None = None):
        twin, self.lines, self.solid, doc, same, self.gone, self.deepest = fresh(docs, "twin", "lines", "solid", "doc", "same", "gone", "deepest")
        cuts = removals(docs, least, alone).toDF(doc, same, self.gone, self.deepest)
        lines = lines_of(F.col("text"))
        self.rows = docs.withColumns({twin: text_hash(), self.lines: lines, self.solid: filled(lines)}).join(
            cuts, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(twin) == F.col(same)), "left"
        )

    def kept(self) -> Column:
        """The text without the lines that go, whose positions count lines that are not blank."""
        index = F.transform(self.gone, lambda p: F.col(self.solid)[p])
        left = F.array_except(F.sequence(F.lit(0), F.size(self.lines) - 1), index)
        return F.array_join(F.transform(left, lambda i: F.col(self.lines)[i]), "\n")


def dedup_lines(docs: DataFrame, least: int = LEAST, alone: int | None = ALONE) -> DataFrame:
    """The columns of docs, with later copies of repeated runs and of long lines removed from the texts."""
    m = _Marked(docs, least, alone)
    cut = F.col(m.gone).isNotNull()
    (kept,) = fresh(m.rows, "kept")
    out = m.rows.where(~cut | (F.size(m.gone) < F.size(m.solid))).withColumn(kept, F.when(cut, m.kept()).otherwise(F.col("text")))
    changed = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(cut, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The rows of query op2: doc_id, n_lines, n_removed, n_runs, deepest, kept_sha256.

    deepest is the largest depth of the ranking, 2, 16, 128 and so on lines, at which a removed run repeats.
    """
    m = _Marked(docs.select("doc_id", "text"), LEAST)
    gone = F.coalesce(m.gone, F.array().cast("array<int>"))
    begun = F.array_except(gone, F.transform(gone, lambda p: p + 1))
    return m.rows.select(
        "doc_id",
        F.size(m.solid).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(begun).cast("long").alias("n_runs"),
        F.coalesce(m.deepest, F.lit(0)).cast("long").alias("deepest"),
        F.sha2(F.when(F.col(m.gone).isNotNull(), m.kept()).otherwise(F.array_join(m.lines, "\n")), 256).alias("kept_sha256"),
    )


#: The same rows by comparing all runs of each depth outright.
ORACLE = r"""
with l as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as every,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) as ls
  from documents),
d as (select doc_id, ls, len(ls) as n, unnest([2, 16, 128, 1024, 8192]) as depth from l),
w as (select doc_id, depth, n, unnest(range(1, n - depth + 2)) as pos, ls from d where n >= depth),
k as (select doc_id, depth, pos, md5(array_to_string(list_slice(ls, pos, pos + depth - 1), chr(10))) as key from w),
r as (select *, row_number() over (partition by depth, key order by doc_id, pos) as nth from k),
m as (select doc_id, depth, pos from r where nth > 1),
g as (select distinct doc_id, unnest([pos, pos + 1]) as pos from m where depth = 2),
s as (select doc_id, count(*) as n_removed, list(pos) as gone from g group by 1),
u as (select doc_id, count(*) as n_runs from g where not exists (select 1 from g x where x.doc_id = g.doc_id and x.pos = g.pos - 1) group by 1),
x as (select doc_id, max(depth) as deepest from m group by 1),
p as (select doc_id, every, list_filter(range(1, len(every) + 1), lambda i: regexp_matches(every[i], '\S')) as solid from l),
t as (select p.doc_id, array_to_string(list_transform(list_filter(range(1, len(every) + 1),
    lambda i: not list_contains(list_transform(coalesce(gone, []), lambda q: solid[q]), i)), lambda i: every[i]), chr(10)) as kept
  from p left join s using (doc_id))
select l.doc_id, len(ls)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs,
  coalesce(deepest, 0)::bigint as deepest, sha256(kept) as kept_sha256
from l left join s using (doc_id) left join u using (doc_id) left join x using (doc_id) join t using (doc_id)
"""
