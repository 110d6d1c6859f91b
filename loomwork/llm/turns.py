"""Repair of conversations: the cheapest edits that make roles alternate and remove faulty turns.

A conversation's rows are taken by turn. Each is kept, given another role, or deleted, and empty turns may be
inserted, so that the roles' initials read `(s?(ua)+)?`. A Viterbi pass over rows keeps the cheapest edits for each of
the four states: nothing yet, after s, after u, after a. The edits of all survivors are one tree of backpointers whose nodes count
their references: a node without any goes, a node with one is joined to what follows, and once all survivors
share an ancestor, the edits up to it are final and leave the tree. Among equal costs the edits whose initials come
first in ASCII win; the whole unresolved suffixes of both decide, and since different survivors leave a node by
different letters, the first letters below their last common ancestor do. A survivor goes when another one is so much cheaper that no
continuation can make up for it.

Steps: equal rows are counted before the shuffle and written once; the first of a text in a conversation is a minimum over the digests of rows; the Viterbi
pass streams rows without their texts; a second pass streams the texts, with the edits of a conversation ahead of its rows, and
applies them. Memory holds a letter for each row of the longest conversation, which is its row in the result
anyway, and one row. A hash over one conversation's whole text is made in sequence, so one task reads the
rows of one conversation, however long, in both passes.

Defined results: null role and text are one space. Rows of equal turn are ordered by role, then by the sha256 of role and
text; null turns come first. turn is an integer. A null conv_id is a conversation of its own; ids of any
type. Repeated rows are duplicates. Roles other than those that begin with s, u or a can't be kept. Gaps saturate at a long. An empty table makes an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import staged

#: White space, and what ends a sentence.
SPACE, END = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. What may follow in each: initial -> next state.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: ROOM[p][q]: what continuing from p costs more than from q, at most. From 3, an s that 0 would keep is deleted; from the others, turns are inserted.
ROOM = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
LONG = (1 << 63) - 1
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = [x.split()[0] for x in SUMMARY.split(", ")]


class Node:
    """Edits below a parent node; `held` where a survivor ends here. References: children and survivor."""

    __slots__ = ("parent", "label", "children", "held")

    def __init__(self, parent: Node | None, label: bytes):
        self.parent, self.label, self.children, self.held = parent, bytearray(label), [], False
        if parent:
            parent.children.append(self)


class Survivors:
    """The cheapest edits of a growing conversation for each state."""

    def __init__(self):
        self.edits = bytearray()
        self.root = Node(None, b"")
        self.now: list[tuple[int, Node] | None] = [None] * 4
        self._take([(0, self.root, b""), None, None, None])

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        """One more row."""
        new: list[tuple[int, Node, bytes] | None] = [None] * 4
        for state, own in enumerate(self.now):
            if own is None:
                continue
            cost, node = own
            self._offer(new, state, (cost + DELETE, node, b"D"))
            if must_go:
                continue
            cost += TRUNCATED * truncated
            for letter, after in AFTER[state].items():
                if letter == initial:
                    self._offer(new, after, (cost + KEEP, node, b"K"))
                elif letter != "s":
                    self._offer(new, after, (cost + REROLE, node, b"R"))
        self._take(new)

    def finish(self) -> tuple[int, bytes]:
        """(cost, edits) of the whole conversation."""
        best = None
        for state in ENDS:
            if self.now[state]:
                cost, node = self.now[state]
                one: list = [best]
                self._offer(one, 0, (cost, node, b""))
                best = one[0]
        cost, node, _ = best
        tail = []
        while node is not self.root:
            tail.append(node.label)
            node = node.parent
        return cost, bytes(self.edits + b"".join(reversed(tail)))

    def _offer(self, new: list, state: int, one: tuple[int, Node, bytes]) -> bool:
        if (old := new[state]) is None or one[0] < old[0] or one[0] == old[0] and self._first(one, old):
            new[state] = one
            return True
        return False

    def _first(self, one: tuple, other: tuple) -> bool:
        """Whether the edits of one come before those of the other, of equal cost."""
        (_, a, x), (_, b, y) = one, other
        if a is b:
            return x < y
        above = []
        while a is not None:
            above.append(a)
            a = a.parent
        last = y
        while (k := next((i for i, n in enumerate(above) if n is b), None)) is None:
            last, b = b.label, b.parent
        return bytes(above[k - 1].label if k else x) < bytes(last)

    def _take(self, new: list) -> None:
        """Inserts turns, drops survivors that can't win, and makes the rest the new survivors."""
        grown = True
        while grown:
            grown = False
            for state in range(4):
                if new[state]:
                    cost, node, letters = new[state]
                    for letter, after in AFTER[state].items():
                        if letter != "s":
                            grown |= self._offer(new, after, (cost + INSERT, node, letters + b"I"))
        costs = [x[0] if x else None for x in new]
        lost = [q for q in range(4) if new[q] and any(costs[p] is not None and costs[q] > costs[p] + ROOM[p][q] for p in range(4))]
        for q in lost:
            new[q] = None
        before = [x[1] for x in self.now if x]
        for node in before:
            node.held = False
        made: dict[tuple[int, bytes], Node] = {}
        for state in sorted((q for q in range(4) if new[q]), key=lambda q: len(new[q][2])):
            cost, node, letters = new[state]
            at = node
            for k in range(1, len(letters) + 1):
                # K and KI of one node share the K
                if (next_ := made.get((id(node), letters[:k]))) is None:
                    next_ = made[id(node), letters[:k]] = Node(at, letters[k - 1 : k])
                at = next_
            at.held = True
            self.now[state] = (cost, at)
        for q in range(4):
            if not new[q]:
                self.now[q] = None
        for node in before:
            self._drop(node)
        for node in made.values():
            self._join(node)
        while len(self.root.children) == 1 and not self.root.held:
            (child,) = self.root.children
            self.edits += child.label
            child.parent, child.label = None, bytearray()
            self.root = child

    def _drop(self, node: Node) -> None:
        while node.parent and not node.held and not node.children:
            node.parent.children = [c for c in node.parent.children if c is not node]
            node = node.parent
        self._join(node)

    def _join(self, node: Node) -> None:
        """A node with one child and no survivor takes in the child's edits."""
        if node.parent and not node.held and len(node.children) == 1:
            (child,) = node.children
            node.label += child.label
            node.children, node.held = child.children, child.held
            for c in node.children:
                c.parent = node
            for state, own in enumerate(self.now):
                if own and own[1] is child:
                    self.now[state] = (own[0], node)
            # so that nobody follows the child
            child.parent, child.children, child.held = node, [], False


def plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with every twentieth or so dropped, emptied, cut, repeated or given to the user."""
    key = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    role, text = plain("role"), plain("text")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(key == 4, "user").otherwise(role).alias("role"),
        F.when(key == 1, "").when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        key.alias("key"),
    ).where("key <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("key")).drop("key")


def counted(rows: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn, role, text), with their number n, digest and faults."""
    equal = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return equal.select(
        *("conv_id", "turn", "role", "text", "n"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("digest"),
        (last == "").alias("blank"),
        ((last != "") & ~last.isin(*END)).alias("truncated"),
    )


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, "turn", "role", "digest")


def same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def audit(rows: DataFrame, ids: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of `rows` and of `ids`."""
    small = (counted(rows) if told is None else told).drop("text")
    # where each text of a conversation comes first; a null turn is before all
    null_first = F.bool_or(F.col("turn").isNull())
    firsts = small.groupBy("conv_id", "role", "digest").agg(null_first.alias("null"), F.min("turn").alias("turn"))
    firsts = firsts.select("conv_id", F.when(~F.col("null"), F.col("turn")).alias("turn"), "role", F.lit(None).cast("long").alias("n"), "digest", F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("truncated"))
    both = small.select(*firsts.columns).union(firsts)
    if ids is not None:
        marks = ids.select("conv_id").distinct()
        both = both.union(marks.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in firsts.dtypes[1:])))
    # a mark of a conversation has no role, and a mark of a first row has no n: nulls come before the rows
    stream = in_order(both).sortWithinPartitions("conv_id", "turn", "role", "digest", "n")

    def run(batches):
        c, out = None, []
        for b in batches:
            for conv, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c is None or not same(c.conv, conv):
                    if c:
                        out.append(c.summary())
                    c = Conversation(conv)
                c.add(*row)
            if len(out) >= 1000:
                yield _rows(out, b.schema.field(0).type)
                out = []
        if c:
            out.append(c.summary())
        if out:
            yield _rows(out, b.schema.field(0).type)

    return stream.mapInArrow(run, f"conv_id {_id_type(rows)}, {SUMMARY}")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *COUNTS])


class Conversation:
    """Counts and survivors of one conversation, whose rows come in order."""

    def __init__(self, conv):
        self.conv, self.survivors = conv, Survivors()
        self.first, self.before = None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn: int | None, role: str | None, n: int | None, digest: str | None, blank: bool | None, truncated: bool | None) -> None:
        if role is None:
            return
        if n is None:
            self.first = digest, turn
            return
        again = n - (self.first == (digest, turn))
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        self.illegal += n - 1 + (self.before is not None and self.before + initial not in ("su", "ua", "au"))
        self.before = initial
        if blank:
            self.blank += n
            again = n
        else:
            self.duplicate += again
            if again < n:
                self.truncated += truncated
                self.survivors.add(initial, False, truncated)
        for _ in range(again):
            self.survivors.add(initial, True, False)

    def summary(self) -> tuple:
        cost, edits = self.survivors.finish()
        gaps = 0 if self.most is None else min(self.most - self.least + 1 - self.turns, LONG)
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits.decode()


def applied(batches: Iterator[pa.RecordBatch]):
    """(conv, role, text, edit) of each row of the repaired conversations, and (conv, None, None, summary) after the last of each."""
    summary = letters = None
    at = place = 0
    last = ""

    def inserted(at: int, last: str):
        while at < len(letters) and letters[at] == "I":
            last = "a" if last == "u" else "u"
            yield at + 1, last, ("user" if last == "u" else "assistant"), ""
            at += 1

    for b in batches:
        columns = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names)}
        for k, conv in enumerate(columns["conv_id"]):
            if columns["kind"][k] == 0:
                if summary:
                    for at, last, role, text in inserted(at, last):
                        yield summary[0], role, text, "I"
                    yield summary[0], None, None, summary
                summary, at, last = (conv, *(columns[c][k] for c in COUNTS)), 0, ""
                letters = summary[-1]
                continue
            for _ in range(columns["n"][k]):
                for at, last, role, text in inserted(at, last):
                    yield conv, role, text, "I"
                edit, at = letters[at], at + 1
                if edit == "D":
                    continue
                role = columns["role"][k]
                last = role[:1] if edit == "K" else "a" if last == "u" else "u"
                yield conv, role if edit == "K" else "user" if last == "u" else "assistant", columns["text"][k], edit
    if summary:
        for at, last, role, text in inserted(at, last):
            yield summary[0], role, text, "I"
        yield summary[0], None, None, summary


def _streamed(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Each conversation's summary, then its rows in order."""
    told = staged(counted(rows))
    found = audit(rows, ids, told).withColumn("kind", F.lit(0))
    texts = told.select("conv_id", "turn", "role", "text", "n", "digest", F.lit(1).alias("kind"))
    return in_order(found.unionByName(texts, allowMissingColumns=True), "kind")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations, row by row."""

    def run(batches):
        out, place = [], 0
        kind = None

        def kinds():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def made():
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

        for conv, role, text, edit in applied(kinds()):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text, edit))
            place += 1
            if len(out) >= 1000:
                yield made()
                out = []
        if out:
            yield made()

    return _streamed(rows, None).mapInArrow(run, f"conv_id {_id_type(rows)}, place long, role string, text string, edit string")


def report(conversations: DataFrame) -> DataFrame:
    """What `repair` makes of the damaged rows, as digests, for every conversation of the table."""

    def run(batches):
        out, digest, any_row = [], hashlib.sha256(), False
        kind = None

        def kinds():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def made():
            rows = pa.RecordBatch.from_arrays([pa.array([x[-1] for x in out], pa.string())], names=["repaired_sha256"])
            first = _rows([x[:-1] for x in out], kind)
            return pa.RecordBatch.from_arrays([*first.columns, *rows.columns], names=[*first.schema.names, "repaired_sha256"])

        for _, role, text, edit in applied(kinds()):
            if role is not None:
                digest.update(f"{chr(10) * any_row}{role}:{text}".encode())
                any_row = True
                continue
            out.append((*edit, digest.hexdigest()))
            digest, any_row = hashlib.sha256(), False
            if len(out) >= 1000:
                yield made()
                out = []
        if out:
            yield made()

    stream = _streamed(damage(conversations), conversations)
    return stream.mapInArrow(run, f"conv_id {_id_type(conversations)}, {SUMMARY}, repaired_sha256 string")
