"""Repair of conversation structure by a dynamic program with checkpoints.

A conversation is a list of turns; its roles should read system (or not), then pairs of user
and assistant. Each turn can be kept, get another role or be deleted, and turns can be
inserted. The cheapest edits come from a backward pass over state costs: what it takes to
finish from each of four states before each turn. Only the cost vectors at checkpoints,
every square root of the turns, are stored; a forward walk recomputes one block of them at
a time and emits, turn by turn, the ASCII-least edit that is tight, so that memory grows
with the square root of a segment.

Turns are range-partitioned by conversation and turn, so a conversation of any size is
spread over tasks, and cut into segments of bounded size. Most conversations lie inside one
task and are finished there. Of the others each segment first gives its cost matrix (states
before by states after); running these backwards gives each segment the cost vector at its
end, the outer checkpoints. Then a conversation's segments stream through one walk in
order: an audit and a digest of the whole text are sequential by definition, and the walk
holds one segment at a time.

Defined results: a null role or text is one space, a null conversation is a conversation of
its own, null turns come first; turns of one number are ordered by role, then text; equal
rows each count; a conversation without turns has zeros, an empty audit and the digest of
nothing; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import SPACE, SPACES, importable, written

#: Turns and characters of a segment: what a walk holds at a time.
SEGMENT_TURNS = 16_384
SEGMENT_CHARS = 4_000_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_NEVER = 1 << 60

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_NEXT_ROLE = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
_DONE = (0, 3)
#: What is left to pay after the last turn.
END = (0, 2 * INSERT, INSERT, 0)
#: A turn's code: forced out, or the role's initial (3: another) plus 4 if it is truncated.
_FORCED = 8

Costs = tuple[int, int, int, int]


def costs_before(code: int, after: Costs) -> Costs:
    """The costs to finish from each state before a turn, given those after it."""
    a, b, c, d = after
    if code == _FORCED:
        w, x, y, z = a + DELETE, b + DELETE, c + DELETE, d + DELETE
    else:
        extra = TRUNCATED if code >= 4 else 0
        kind, to_user, to_assistant = code & 3, c + REROLE + extra, d + REROLE + extra
        w, x = min(a + DELETE, to_user), min(b + DELETE, to_user)
        y, z = min(c + DELETE, to_assistant), min(d + DELETE, to_user)
        if kind == 0:
            w = min(w, b + extra)
        elif kind == 1:
            w, x, z = min(w, c + extra), min(x, c + extra), min(z, c + extra)
        elif kind == 2:
            y = min(y, d + extra)
    # Insertions before the turn: user and assistant states lead to each other.
    y, z = min(y, z + INSERT), min(z, y + INSERT)
    return min(w, y + INSERT), min(x, y + INSERT), y, z


def matrix(codes: list[int]) -> list[int]:
    """Costs from each state before the turns to each state after them, row by row."""
    columns = []
    for end in range(4):
        costs = tuple(0 if s == end else _NEVER for s in range(4))
        for code in reversed(codes):
            costs = costs_before(code, costs)
        columns.append(costs)
    return [columns[end][start] for start in range(4) for end in range(4)]


def through(segment: list[int], after: Costs) -> Costs:
    """The costs before a segment, from its matrix and the costs after it."""
    return tuple(min(segment[4 * s + e] + after[e] for e in range(4)) for s in range(4))


def tight_edits(codes: list[int], state: int, end: Costs) -> Iterator[tuple[int, str, int]]:
    """``(turn, edit, new state)`` of the ASCII-least cheapest edits; an insert names the turn after it."""
    n = len(codes)
    step = isqrt(n) + 1
    kept, costs = {}, end
    for i in range(n - 1, -1, -1):
        costs = costs_before(codes[i], costs)
        if i % step == 0:
            kept[i] = costs
    for begin in range(0, n, step):
        stop = min(n, begin + step)
        block = [kept.get(stop, end)]
        for i in range(stop - 1, begin - 1, -1):
            block.append(costs_before(codes[i], block[-1]))
        for i in range(begin, stop):
            here, after, code = block[stop - i], block[stop - i - 1], codes[i]
            while after[state] + DELETE != here[state] and here[_NEXT[state]] + INSERT == here[state]:
                state = _NEXT[state]
                yield i, "I", state
            extra = TRUNCATED if 4 <= code < _FORCED else 0
            to = None if code == _FORCED else _KEPT.get((state, code & 3))
            if after[state] + DELETE == here[state]:
                yield i, "D", state
            elif to is not None and after[to] + extra == here[state]:
                state = to
                yield i, "K", state
            else:
                state = _NEXT[state]
                yield i, "R", state


class Turn:
    """A turn and its equal copies right behind it; ``later``: an equal turn came before."""

    __slots__ = ("turn", "role", "text", "fault", "later", "copies")

    def __init__(self, turn, role, text, fault, later, copies) -> None:
        self.turn, self.role, self.text = turn, role, text
        self.fault, self.later, self.copies = fault, later, copies

    def values(self) -> dict:
        return {name: getattr(self, name) for name in self.__slots__}

    @property
    def code(self) -> int:
        if self.fault == "B" or self.later:
            return _FORCED
        initial = self.role[:1]
        kind = "sua".index(initial) if initial in ("s", "u", "a") else 3
        return kind + (4 if self.fault == "T" else 0)


class Walk:
    """Counts, edits and the repaired text of one conversation, segment by segment."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.state, self.before, self.any = 0, None, False
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _count(self, t: Turn) -> None:
        if t.turn is not None and t.turn != self.last:
            self.first = t.turn if self.first is None else self.first
            self.last, self.turns = t.turn, self.turns + 1
        initial = t.role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.illegal += t.copies - 1
        if t.fault == "B":
            self.blank += t.copies
        else:
            self.duplicate += t.copies - (not t.later)
            self.truncated += t.fault == "T" and not t.later

    def feed(self, turns: list[Turn], end: Costs) -> None:
        """Walk over the next segment; ``end`` are the costs after it."""
        for t in turns:
            self._count(t)
        for i, edit, state in tight_edits([t.code for t in turns], self.state, end):
            t = turns[i]
            self.audit.append(edit)
            self.state = state
            if edit == "I":
                self.cost += INSERT
                self._say(_NEXT_ROLE[2 if state == 3 else 0], "")
                continue
            if edit == "D":
                self.cost += DELETE
            else:
                self.cost += TRUNCATED if t.fault == "T" else 0
                self.cost += REROLE if edit == "R" else 0
                self._say(t.role if edit == "K" else ("assistant" if state == 3 else "user"), t.text)
            # Copies are duplicates: deleting them at once is always among the cheapest edits.
            self.audit.append("D" * (t.copies - 1))
            self.cost += DELETE * (t.copies - 1)

    def finish(self) -> dict:
        while self.state not in _DONE:
            self._say(_NEXT_ROLE[self.state], "")
            self.state = _NEXT[self.state]
            self.audit.append("I")
            self.cost += INSERT
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_FACTS = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string, repaired_sha256 string")
_TURN = "turn bigint, role string, text string, fault string, later boolean, copies bigint"


def turns_of(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copies)``: the rows as they are, nulls as one space."""
    return talks.select(
        talks[conv].alias("conv"), talks[turn].cast("bigint").alias("turn"),
        F.coalesce(talks[role].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(talks[text].cast("string"), F.lit(" ")).alias("text"),
        F.lit(1).cast("bigint").alias("copies"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of their place, to test repairs on.

    A dropped turn stays as a row without copies, so its conversation is not forgotten.
    """
    place = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return turns.withColumn("kind", kind).select(
        "conv", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~gone, text).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, F.col("copies") * 2).otherwise(F.col("copies"))
        .cast("bigint").alias("copies"))


def _fault(text: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACES))
    return F.when(~text.rlike(SPACE.replace("[", "[^", 1)), "B").when(
        ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "T").otherwise("")


def faults(turns: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, fault, later, copies)``, one row per different turn.

    Equal rows are summed up before they are shuffled. Whether an equal role and text came
    earlier is settled on digests; texts are shuffled once, by conversation, turn and digest.
    """
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"),
                             F.col("text")), 256)
    rows = turns.withColumn("same", digest)
    place = ["conv", "same", "turn"]
    whole = rows.groupBy(*place).agg(F.first("role").alias("role"), F.first("text").alias("text"),
                                     F.sum("copies").alias("copies"))
    firsts = rows.where("copies > 0").groupBy("conv", "same").agg(
        F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unset"),
        F.max("turn").alias("last"))
    # Few texts come twice at different places; only these are looked up.
    firsts = firsts.where(F.col("unset") & F.col("last").isNotNull() | (F.col("first") < F.col("last")))
    again = firsts.select(*[F.col(c).alias(f"of_{c}") for c in ("conv", "same", "first", "unset")])
    seen = rows.select(*place).where(F.col("turn").isNotNull()).distinct().join(
        again, F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("same") == F.col("of_same")))
    later = seen.where(F.col("of_unset") | (F.col("turn") > F.col("of_first"))).select(
        *[F.col(c).alias(f"of_{c}") for c in place])
    joined = whole.join(later, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in place], "left")
    return joined.select("conv", "turn", "role", "text", _fault(F.col("text")).alias("fault"),
                         F.col("of_same").isNotNull().alias("later"), "copies")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[dict], schema: pa.Schema, held: int = 64) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == held:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _segments(rows: Iterator[tuple], turns: int, chars: int) -> Iterator[tuple]:
    """``(conv, its turns, first of the conversation here, last)`` of sorted rows."""
    conv, held, size, first = None, [], 0, True
    started = False
    for c, turn, role, text, fault, later, copies in rows:
        if started and (c != conv or len(held) >= turns or size >= chars):
            yield conv, held, first, c != conv
            held, size, first = [], 0, c != conv
        started, conv = True, c
        if copies:
            held.append(Turn(turn, role, text, fault, later, copies))
            size += len(text)
    if started:
        yield conv, held, first, True


def repaired(turns: DataFrame, segment_turns: int = SEGMENT_TURNS,
             segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation: what was wrong, the cheapest edits and the repaired text's digest.

    ``turns`` as :func:`turns_of` or :func:`damaged` give them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(turns.sparkSession)
    kind = turns.schema["conv"].dataType.simpleString()
    marked = faults(turns)
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")]
    laid = marked.repartitionByRange(*order, F.left("text", F.lit(32)).asc_nulls_first()
                                     ).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    cut_schema = (f"conv {kind}, {_FACTS}, part int, place int, matrix array<bigint>, "
                  f"turns array<struct<{_TURN}>>, whole boolean")
    empty = turns.sparkSession.createDataFrame([], cut_schema)
    arrow = to_arrow_schema(empty.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            place, held = 0, None
            for segment in _segments(_rows(batches), segment_turns, segment_chars):
                if held is not None:
                    yield told(place, *held, outer=place == 0)
                    place += 1
                held = segment
            if held is not None:
                yield told(place, *held, outer=True)

        def told(place, conv, own, first, last, outer) -> dict:
            # Only a conversation that begins and ends inside this task is known to be whole.
            if first and last and not outer:
                walk = Walk()
                walk.feed(own, END)
                return {"conv": conv, "whole": True, **walk.finish()}
            return {"conv": conv, "whole": False, "part": part, "place": place,
                    "matrix": matrix([t.code for t in own]), "turns": [t.values() for t in own]}

        return _batches(out(), arrow)

    pieces = written(laid.mapInArrow(cut, cut_schema), "conversations", "whole")
    facts = ["conv", *[x.split()[0] for x in _FACTS.split(", ")]]
    done = pieces.where("whole").select(*facts)
    cuts = pieces.where("NOT whole")

    ends_schema = "part int, place int, end array<bigint>"
    ends_arrow = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("end", pa.list_(pa.int64()))])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            conv, costs, started = None, END, False
            for c, part, place, segment in _rows(batches):
                if not started or c != conv:
                    conv, costs, started = c, END, True
                yield {"part": part, "place": place, "end": list(costs)}
                costs = through(segment, costs)

        return _batches(out(), ends_arrow, 1024)

    ends = cuts.select("conv", "part", "place", "matrix").repartition("conv").sortWithinPartitions(
        F.col("conv"), F.col("part").desc(), F.col("place").desc()).mapInArrow(backwards, ends_schema)

    walk_schema = f"conv {kind}, {_FACTS}"
    walk_arrow = to_arrow_schema(empty.select(*facts).schema)

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            conv, walk = None, None
            for c, own, end in _rows(batches):
                if walk is None or c != conv:
                    if walk is not None:
                        yield {"conv": conv, **walk.finish()}
                    conv, walk = c, Walk()
                walk.feed([Turn(**t) for t in own], tuple(end))
            if walk is not None:
                yield {"conv": conv, **walk.finish()}

        return _batches(out(), walk_arrow)

    rest = cuts.join(ends, ["part", "place"]).repartition("conv").sortWithinPartitions(
        "conv", "part", "place").select("conv", "turns", "end").mapInArrow(forwards, walk_schema)
    return done.unionByName(rest)


def op13(spark, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(damaged(turns_of(talks))).withColumnRenamed("conv", "conv_id")
