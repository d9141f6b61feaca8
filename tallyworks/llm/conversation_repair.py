"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``.

The search is Dijkstra's over a lattice that is never built: a node is (rows consumed, grammar
state), its edges are the edits, its key is (cost, audit), where the audit is the string of edit
initials so far, and the first accepting end node popped is the answer. Keys grow along every edge
and an audit determines its node, so equal costs are settled by the smaller audit.

A conversation's rows come in order, piece by piece. One of up to ``SEGMENT`` rows is searched at
once. A longer one is cut: each segment is searched from every grammar state to every grammar
state, and what is carried from one to the next is, per state, the least (cost, audit) and a
running SHA-256; audits drop the part on which all states agree. So the memory of a task doesn't grow
with a conversation's texts.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant
row) 3. A row with a blank or repeated text must be deleted, a truncated row costs 3 more unless
deleted.

Defined results: a null conv_id, role, text or turn is one space where it is read as text; rows of
a null conv_id are one conversation; a null turn comes first and counts for no gap; rows of one
turn come in the order of role and text; a role is kept only for its initial letter, so an empty
one never is; a conversation without rows has zeros, an empty audit and the hash of nothing; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_group_streams

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT = 256
START, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: state and initial to state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (START, ASSISTANT)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies``: 0 of dropped rows, 2 of repeated ones."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("copy").asc()]


def faults(rows: DataFrame) -> DataFrame:
    """A row for each copy: copy (0: only to keep the conversation's id), initial, and the first fault, if any.

    Repeats are found by a window over conversation, role and text, so not even one very long conversation meets in a task.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    each = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("copy") > 0).orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(seen, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return each.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))


def cheapest(rows: list[tuple[str, str | None]], entry: int = START, goals: tuple[int, ...] = ACCEPTING, first: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the goal states reached after all ``rows`` (initial, fault): of the first one popped, or of each."""
    heap, settled, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(rows) and state in goals:
            found[state] = cost, audit
            if first or len(found) == len(goals):
                break
        made = ASSISTANT if state == USER else USER
        heappush(heap, (cost + INSERT, audit + "I", i, made))
        if i < len(rows):
            initial, fault = rows[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                heappush(heap, (cost + REROLE + more, audit + "R", i + 1, made))
                if (state, initial) in NEXT:
                    heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, initial]))
    return found


def apply_edits(audit: str, rows: list[tuple[str, str, str]], state: int = START) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the repaired rows, and the grammar state after them, of rows (role, text, initial)."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text, initial = next(at) if edit != "I" else ("", "", "")
        if edit == "K":
            state = NEXT[state, initial]
            out.append((role, text))
        elif edit != "D":
            state = ASSISTANT if state == USER else USER
            out.append(("assistant" if state == ASSISTANT else "user", text))
    return out, state


class Fold:
    """The repair of one conversation, fed with its rows segment by segment."""

    def __init__(self) -> None:
        self.agreed: list[str] = []  # the part of the audit that all states share
        self.states = {START: (0, "", hashlib.sha256(), False)}  # cost, rest of the audit, hash, anything hashed

    def feed(self, rows: list[tuple[str, str, str, str | None]], last: bool) -> None:
        """Rows are (role, text, initial, fault)."""
        lattice, texts = [r[2:] for r in rows], [r[:3] for r in rows]
        best: dict = {}
        for entry, (cost, audit, *_) in self.states.items():
            for state, (more, edits) in cheapest(lattice, entry, ACCEPTING if last else tuple(range(4)), last).items():
                key = cost + more, audit + edits
                if state not in best or key < best[state][0]:
                    best[state] = key, entry, edits
        if last:
            best = dict([min(best.items(), key=lambda x: x[1][0])])
        after = {}
        for state, ((cost, audit), entry, edits) in best.items():
            digest, begun = self.states[entry][2].copy(), self.states[entry][3]
            for role, text in apply_edits(edits, texts, entry)[0]:
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode(errors="replace"))
                begun = True
            after[state] = cost, audit, digest, begun
        same = os.path.commonprefix([a for _, a, *_ in after.values()])
        self.agreed.append(same)
        self.states = {q: (c, a[len(same) :], d, b) for q, (c, a, d, b) in after.items()}

    def result(self) -> tuple[int, str, str]:
        (cost, audit, digest, _) = next(iter(self.states.values()))
        return cost, "".join(self.agreed) + audit, digest.hexdigest()


def _segments(pieces: Iterator[pa.Table], size: int) -> Iterator[tuple[list[tuple], bool]]:
    """The live rows in lists of ``size``, each with whether it is the last."""
    held: list[tuple] = []
    for piece in pieces:
        for row in zip(*(piece.column(c).to_pylist() for c in ("role", "text", "initial", "fault", "turn", "copy")), strict=True):
            if row[-1]:
                if len(held) == size:
                    yield held, False
                    held = []
                held.append(row)
    yield held, True


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, and the cost, the audit and the hash of its repair."""
    marked = faults(rows)
    kind = marked.schema["conv_id"].dataType.simpleString()
    size = SEGMENT

    def run(key: tuple, pieces: Iterator[pa.Table]) -> Iterator[pa.Table]:
        fold, tally, turns, low, high, before = Fold(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, 0, None, None, None
        for held, last in _segments(pieces, size):
            for _, _, initial, fault, turn, _ in held:
                if fault:
                    tally[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    tally["illegal"] += 1
                before = initial
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
            fold.feed([r[:4] for r in held], last)
        cost, audit, digest = fold.result()
        gaps = 0 if low is None else high - low + 1 - turns
        row = {"conv_id": key[0], "gaps": gaps, **tally, "cost": cost, "audit": audit, "repaired_sha256": digest}
        yield pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema([marked_field("conv_id", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ddl = f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return map_group_streams(marked, ["conv_id"], run, ddl, _order())


def marked_field(name: str, kind: str) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"{name} {kind}")).field(0)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit, role, text. Audits are taken apart and joined with the numbered rows."""
    audits = digests(rows).select("conv_id", "audit")
    edits = audits.select("conv_id", F.posexplode(F.split("audit", "(?!^)")).alias("step", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    stays = (F.col("edit") != "D").cast("int")
    edits = edits.withColumns({"row": F.sum((F.col("edit") != "I").cast("int")).over(upto), "place": F.sum(stays).over(upto) - 1}).where("edit <> 'D'")
    live = faults(rows).where("copy > 0")
    numbered = live.withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())))
    numbered = numbered.select(F.col("conv_id").alias("own"), F.col("row").alias("own_row"), F.col("role").alias("own_role"), "text", "initial")
    both = edits.join(numbered, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("row") == F.col("own_row")) & (F.col("edit") != "I"), "left")
    # an s can only stand at the start, so the rows after it alternate from there
    led = F.coalesce(F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & (F.col("initial") == "s"), 1)).over(Window.partitionBy("conv_id")), F.lit(0))
    turn = F.when((F.col("place") - F.col("led")) % 2 == 0, "user").otherwise("assistant")
    role = F.when(F.col("edit") == "K", F.col("own_role")).otherwise(turn)
    return both.withColumn("led", led).select("conv_id", F.col("place").cast("int").alias("place"), "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
