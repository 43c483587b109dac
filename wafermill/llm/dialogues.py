"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures.

A row's signature is one letter: its role's initial and whether it must go or is truncated. What a
repair costs from some row on depends only on the letters from there to the end and on the state of
the grammar, so letters are read from the end: all conversations' signatures, sorted backwards,
form an automaton in which equal endings are one node. Each node holds, once for each grammar
state, its cost to go and the first edit of the best audit; the rest of the audit is its child's.

Long conversations are cut into stretches of rows. What a stretch costs for every state before and
after it is a table of sixteen numbers; the tables, chained from the end, give the costs to
go behind each stretch, with which it is solved like the end of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import discard, stored

#: Rows of a stretch: positions in the sorted table with the same upper bits.
STRETCH_BITS = 9

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after an inserted or rerolled row; the state itself says which role that is.
GIVEN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GONE = "x"
FAR = 1 << 40

#: Costs to go and edits at the end of a conversation: it may end at the start or after an answer.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))
NO_ROWS = hashlib.sha256(b"").hexdigest()
SPACE = " \t\n\v\f\r"


class Node:
    """An ending of signatures: its first letter, the ending after it, costs and first edits by state."""

    __slots__ = ("letter", "after", "costs", "edits")

    def __init__(self, letter: str, after: "Node | None", costs, edits):
        self.letter, self.after, self.costs, self.edits = letter, after, costs, edits


def before(letter: str, after: Node) -> Node:
    """The node of ``letter`` followed by ``after``. Edits at one place differ in their letter and
    lead on in one way each, so the least letter among the cheapest starts the least audit."""
    role, late = letter.lower(), TRUNCATED if letter.isupper() else 0
    best = []
    for state in STATES:
        options = [(DELETE + after.costs[state], "D")]
        if letter != GONE:
            options.append((REROLE + late + after.costs[GIVEN[state]], "R"))
            if (state, role) in KEPT:
                options.append((late + after.costs[KEPT[state, role]], "K"))
        best.append(min(options))
    for _ in STATES:
        best = [min(best[state], (INSERT + best[GIVEN[state]][0], "I")) for state in STATES]
    return Node(letter, after, tuple(c for c, _ in best), tuple(e for _, e in best))


def walk(node: Node, state: int) -> tuple[str, int]:
    """The audit from ``state`` on and the state behind it."""
    audit = []
    while edit := node.edits[state]:
        audit.append(edit)
        if edit in "IR":
            state = GIVEN[state]
        elif edit == "K":
            state = KEPT[state, node.letter.lower()]
        if edit != "I":
            node = node.after
    return "".join(audit), state


class Endings:
    """The automaton over rows that come sorted by (costs behind, reversed signature): an ending that
    the row before had too is not built again."""

    def __init__(self):
        self.back, self.behind, self.nodes = "", None, []

    def node(self, back: str, behind: tuple) -> Node:
        """The node of a signature. No costs behind it: the conversation ends there."""
        if behind != self.behind:
            self.back, self.behind, self.nodes = "", behind, [Node("", None, *((behind, ("",) * 4) if behind else END))]
        same = 0
        while same < min(len(self.back), len(back)) and self.back[same] == back[same]:
            same += 1
        del self.nodes[same + 1 :]
        for letter in back[same:]:
            self.nodes.append(before(letter, self.nodes[-1]))
        self.back = back
        return self.nodes[-1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every (signature, costs behind): costs, own costs, audits and last states by first state."""
    known = Endings()
    for batch in batches:
        costs, own, audits, exits = [], [], [], []
        for back, behind in zip(batch.column("back").to_pylist(), batch.column("behind").to_pylist()):
            node = known.node(back, tuple(behind))
            walked = [walk(node, s) for s in STATES] if max(behind, default=0) < FAR else [("", s) for s in STATES]
            costs.append(list(node.costs))
            own.append([c - (behind[e] if behind else 0) for c, (_, e) in zip(node.costs, walked)])
            audits.append([a for a, _ in walked])
            exits.append([e for _, e in walked])
        numbers = pa.list_(pa.int64())
        results = [pa.array(costs, numbers), pa.array(own, numbers), pa.array(audits, pa.list_(pa.string())), pa.array(exits, numbers)]
        yield pa.RecordBatch.from_arrays([batch.column("back"), batch.column("behind"), *results], names=["back", "behind", "costs", "own", "audits", "exits"])


def _solutions(asked: DataFrame) -> DataFrame:
    """Solve each distinct (``back``, ``behind``): sorted backwards, so that endings are shared."""
    ranged = asked.distinct().repartitionByRange("behind", "back").sortWithinPartitions("behind", "back")
    types = "back string, behind array<bigint>, costs array<bigint>, own array<bigint>, audits array<string>, exits array<bigint>"
    return ranged.mapInArrow(_solve, types)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go behind each stretch; stretches come from the last to the first."""
    who, costs = None, None
    for batch in batches:
        out = []
        for row_who, tables in zip(batch.column("who").to_pylist(), batch.column("tables").to_pylist()):
            if row_who != who:
                who, costs = row_who, None
            out.append([] if costs is None else costs)
            ends = END[0] if costs is None else costs
            found = [min(tables[t][s] + ends[t] for t in STATES) for s in STATES]
            costs = [c - min(found) for c in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("who"), batch.column("stretch"), batch.column("back"), pa.array(out, pa.list_(pa.int64()))],
            names=["who", "stretch", "back", "behind"],
        )


RESULT = (
    "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


class _Conversation:
    """Counts, audit and digest of one conversation whose stretches arrive in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, START, 0, []
        self.counts = dict.fromkeys("bdt", 0)
        self.first = self.last = None
        self.turns, self.illegal, self.initial = 0, 0, None
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, rows: list[dict], own, audits, exits) -> None:
        for row in rows:
            turn, initial = row["turn"], row["role"][:1]
            if turn is not None:
                self.turns += turn != self.last
                self.first = turn if self.first is None else self.first
                self.last = turn
            if row["fault"]:
                self.counts[row["fault"]] += 1
            if self.initial is not None:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
        at, state = 0, self.state
        for edit in audits[state]:
            if edit in "IR":
                state = GIVEN[state]
                self._line(ROLES[state], rows[at]["text"] if edit == "R" else "")
            elif edit == "K":
                state = KEPT[state, rows[at]["role"][:1]]
                self._line(rows[at]["role"], rows[at]["text"])
            at += edit != "I"
        self.cost += own[self.state]
        self.audit.append(audits[self.state])
        self.state = exits[self.state]

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _finish(schema: pa.Schema):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, held = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held is None or row["who"] != who:
                    done += [held.row()] if held else []
                    who, held = row["who"], _Conversation(row["conv"])
                if row["rows"]:
                    held.add(row["rows"], row["own"], row["audits"], row["exits"])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held.row(), schema)], schema=schema)

    return finish


def repair_conversations(turns: DataFrame, lost: str | None = None, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """Find the faults of every conversation and its cheapest repair.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. A null
    role or text is one space. Rows with a null ``conv_id`` are one conversation. Rows stand by
    turn (nulls first), equal turns by role and text in code-point order. ``lost`` names a boolean
    column: rows where it is true are no rows of the conversation, they only say that it exists.

    The first fault of a row counts: blank (only white space), duplicate (role and text of an earlier
    row), truncated (the last character that is no white space is not one of ``.!?``). Edits: K keeps
    a row, R gives it another role (3), D deletes it (4, a must for blank and duplicate rows), I
    inserts an empty row (3); a truncated row that stays costs 3 more. The repair makes role
    initials ``(s?(ua)+)?`` at the least cost; of equal ones its audit is the first in ASCII
    order. An empty role has no initial that fits.

    Returns one row for each conversation: ``conv_id``, ``gaps`` (missing turns), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours with other initials than su, ua, au), ``cost``, ``audit`` and
    ``repaired_sha256`` (of ``role:text`` rows joined by line feeds). A conversation without rows
    has zeros, an empty audit and the digest of nothing. An empty table gives an empty result.

    No conversation is sorted or searched by one task: rows are range-sorted and cut into stretches,
    whatever the conversation, and duplicates are found by pre-aggregated minima. Only the last
    pass reads a conversation in order, because a digest of its text is sequential; it streams and
    holds one stretch at a time.
    """
    who = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    none = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)
    rows = turns.select(
        F.col("conv_id").alias("conv"), who.alias("who"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), none.alias("none"),
    )
    real = rows.where("NOT none").drop("none")
    order = ["who", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = real.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("stretch", F.shiftright("pos", stretch_bits)), "dialogue-rows")

    space = F.lit(SPACE)
    end = F.substring(F.rtrim("text", space), -1, 1)
    listed = placed.withColumn("fault", F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise(""))
    entry = F.struct("pos", "turn", "role", "text", "fault")
    grouped = listed.groupBy("who", "stretch").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(entry)).alias("rows"))
    seen = placed.groupBy("who", "role", "text").agg(F.min(F.struct("pos", "stretch")).alias("at")).select("who", "at.*")
    seen = seen.groupBy("who", "stretch").agg(F.collect_list("pos").alias("firsts"))

    def marked(row):
        new = F.array_contains("firsts", row["pos"])
        fault = F.when((row["fault"] == "b") | new, row["fault"]).otherwise("d")
        return F.struct(row["turn"].alias("turn"), row["role"].alias("role"), row["text"].alias("text"), fault.alias("fault"))

    def letter(row):
        initial = F.substring(row["role"], 1, 1)
        known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
        return F.when(row["fault"].isin("b", "d"), GONE).when(row["fault"] == "t", F.upper(known)).otherwise(known)

    stretches = (
        grouped.join(seen, ["who", "stretch"], "left")
        .withColumn("firsts", F.coalesce("firsts", F.array().cast("array<bigint>")))
        .select("who", "conv", "stretch", F.transform("rows", marked).alias("rows"))
        .withColumn("back", F.reverse(F.array_join(F.transform("rows", letter), "")))
    )
    stretches = stored(stretches, "dialogue-stretches")
    discard(placed)

    parts = stretches.select("who", "stretch", "back")
    cut = parts.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("who")
    several = stored(parts.join(cut, "who", "left_semi"), "dialogue-several")
    gates = [F.array(*[F.lit(0 if s == t else FAR).cast("bigint") for s in STATES]) for t in STATES]
    asked = several.select("back", F.explode(F.array(*gates)).alias("behind"))
    far = _solutions(asked).withColumn("t", F.array_position("behind", F.lit(0).cast("bigint")))
    tables = far.groupBy("back").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "costs"))), lambda x: x["costs"]).alias("tables"))
    chained = (
        several.join(stored(tables, "dialogue-tables"), "back")
        .repartition("who")
        .sortWithinPartitions("who", F.col("stretch").desc())
        .mapInArrow(_chain, "who string, stretch bigint, back string, behind array<bigint>")
    )
    chained = stored(chained.select("who", "stretch", "behind"), "dialogue-costs")

    ended = stretches.join(chained, ["who", "stretch"], "left").withColumn("behind", F.coalesce("behind", F.array().cast("array<bigint>")))
    solved = stored(_solutions(ended.select("back", "behind")).drop("costs"), "dialogue-repairs")
    whole = ended.join(solved, ["back", "behind"]).select("who", "stretch", "conv", "rows", "own", "audits", "exits")
    every = rows.groupBy("who").agg(F.first("conv").alias("conv")).withColumn("stretch", F.lit(-1).cast("bigint"))
    type_ = turns.schema["conv_id"].dataType.simpleString()
    result = RESULT.format(type_)
    arrow = _arrow(turns.sparkSession, result)
    return (
        whole.unionByName(every, allowMissingColumns=True)
        .repartition("who")
        .sortWithinPartitions("who", "stretch")
        .mapInArrow(_finish(arrow), result)
    )


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def damaged(turns: DataFrame) -> DataFrame:
    """Damage rows by the digest of their conversation and turn, for tests of repairs.

    crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties its text, 2
    takes ``.!?`` out of it, 3 repeats the row, 4 sets its role to user. Dropped rows stay, marked in
    ``lost``, so that a conversation without rows is still known.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        turns.select("conv_id", "turn", "role", text.alias("text"), kind.alias("_kind"))
        .withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("lost", F.col("_kind") == 0)
        .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text", "lost")
    )
