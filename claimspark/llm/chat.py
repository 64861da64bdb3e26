"""Chat formatting by minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns in alternation, ending with the assistant. A
dynamic programme over the automaton of legal turns chooses for every turn whether it keeps its role, is relabelled,
merges with the turn before it, or is preceded by an empty turn.

Conversations are dealt to tasks by ranges, so a long one is cut. Turns act on the automaton's four states as small matrices
over (min, +), so each piece of a cut conversation is first folded into one matrix: these give the least costs at every cut.
With them a piece tells from which state each of its last states comes, which chained from the end gives the states at the
cuts. So every piece is repaired by itself just as the whole would be, ties included, and nothing depends on the cuts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import shared_dir

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 1, 2, 3
#: More than any chat costs, and so little that sums of two don't overflow.
INF = 1 << 61
#: Empty turns that lead legally from one state to a turn of a role (to: state - 1), or None.
BETWEEN: dict[tuple[int, int], tuple[str, ...] | None] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): ("user",),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): ("user",),
    (USER, SYSTEM): None, (USER, USER): ("assistant",), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): ("user",),
}
#: Empty turns after the last one.
CLOSING = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def choices(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of every way to take a turn."""
    out = []
    for (a, b), path in BETWEEN.items():
        change = 0 if role == ROLES[b - 1] else RELABEL
        if path is not None:
            out.append((a, b, change + INSERT * len(path), False))
        if a == b:
            out.append((a, b, change + MERGE, True))
    return out


def matrix(role: str | None) -> np.ndarray:
    m = np.full((4, 4), INF, np.int64)
    for a, b, cost, _ in choices(role):
        m[a, b] = min(m[a, b], cost)
    return m


#: Roles as numbers: their places in ROLES, and one more for all others.
OTHER = len(ROLES)
CODE = {role: k for k, role in enumerate(ROLES)}
MATRICES = np.stack([matrix(role) for role in (*ROLES, None)])
#: Of each role, the ways into each state.
WAYS = [[[(a, cost, merged) for a, to, cost, merged in choices(role) if to == b] for b in range(4)] for role in (*ROLES, None)]
END = [INSERT * len(CLOSING[s]) for s in range(4)]
BEGIN = [0, INF, INF, INF]


def known(role: object) -> str | None:
    return role if role in ROLES else None


def fold(codes: list[int]) -> np.ndarray:
    """The matrix of a run of turns: neighbours are multiplied, all at once, until one is left."""
    now = MATRICES[codes]
    while len(now) > 1:
        odd = now[len(now) // 2 * 2 :]
        pairs = now[: len(now) // 2 * 2]
        now = np.concatenate([np.minimum((pairs[0::2, :, :, None] + pairs[1::2, None, :, :]).min(2), INF), odd])
    return now[0]


def after(best: list[int], m: np.ndarray) -> list[int]:
    """The least costs of the states behind a run of turns."""
    return np.minimum((np.array(best)[:, None] + m).min(0), INF).tolist()


def forward(codes: list[int], best: list[int]) -> tuple[list[int], list[list[tuple[int, bool]]]]:
    """The least costs behind the turns, and for each turn and state where it comes from; of equal costs the first in the order of states wins, and an empty turn before merging."""
    back = []
    for code in codes:
        now, come = [INF] * 4, [(-1, False)] * 4
        for b, ways in enumerate(WAYS[code]):
            for a, cost, merged in ways:
                if best[a] + cost < now[b]:
                    now[b], come[b] = best[a] + cost, (a, merged)
        best = now
        back.append(come)
    return best, back


def origins(codes: list[int], best: list[int]) -> list[int]:
    """The state before the turns from which the best way to each state behind them comes."""
    _, back = forward(codes, best)
    at = list(range(4))
    for come in reversed(back):
        at = [come[s][0] if s >= 0 else -1 for s in at]
    return at


def repair(codes: list[int], best: list[int] = BEGIN, end: int | None = None) -> tuple[list[tuple[str, bool, tuple[str, ...]]], int]:
    """For each turn (role, merged, empty turns before it) at least cost, and the last state.

    ``best`` are the costs of the states before the turns. ``end`` fixes the last state; otherwise the legal close is part of the
    cost.
    """
    cost, back = forward(codes, best)
    last = state = min(range(4), key=lambda s: cost[s] + END[s]) if end is None else end
    out = []
    for come in reversed(back):
        a, merged = come[state]
        out.append((ROLES[state - 1], merged, () if merged else BETWEEN[a, state]))
        state = a
    return out[::-1], last


def frame(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}"


CLOSE = "<|im_end|>\n"


#: Rows that a task gives out at once.
ROWS = 2048


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[list]]]:
    """(conv_id, its rows in a batch, as one list for each further column) of each run of a conversation in a partition."""
    for batch in batches:
        ids, *columns = (c.to_pylist() for c in batch.columns)
        edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for x, y in zip(edges, edges[1:], strict=False):
            if x < y:
                yield ids[x], [c[x:y] for c in columns]


def _whole(runs: Iterable[tuple[object, list[list]]]) -> Iterator[tuple[object, list[list]]]:
    """The same with the runs of a conversation joined."""
    held: tuple[object, list[list]] | None = None
    for conv, columns in runs:
        if held and held[0] == conv:
            for have, more in zip(held[1], columns, strict=True):
                have += more
            continue
        if held:
            yield held
        held = (conv, columns)
    if held:
        yield held


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role_in, role, action, rendered) of each row of ``turns`` (conv_id, turn, role, text).

    Rows of a conversation in the order of place, from 0 on; their ``rendered`` joined are its chat. action is keep, relabel,
    merge, or relabel+merge, with +insert if empty turns come before it. Turns go by turn (nulls first), then role and
    text; equal rows are kept. A null conv_id is one conversation; a role other than system, user and assistant, or null,
    is relabelled; a null text is empty. conv_id and turn may be of any type that orders. Further columns are ignored; an
    empty table gives an empty one. The row that ends a conversation also closes it. A task holds a conversation's rows in
    its range of the table, which is a share of the table.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Pieces are partitions: written once, so that all passes see the same cuts even if an executor is lost between them.
    dealt = _checkpointed(turns.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order))
    task = F.spark_partition_id().alias("task")
    pieces = dealt.select(task, "conv_id").groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    many = F.min("task") < F.max("task")
    # A cut conversation fills the end of one task and the beginning of the next: fewer than there are tasks.
    cut = {r["conv_id"]: sorted(map(tuple, r["pieces"])) for r in pieces.groupBy("conv_id").agg(many.alias("cut"), F.collect_list(F.struct("task", "n")).alias("pieces")).where("cut").collect()}
    states, places = _states(dealt, cut), {}
    for conv, parts in cut.items():
        first = 0
        for at, size in parts:
            places[at, conv] = first
            first += size
    last = {(parts[-1][0], conv) for conv, parts in cut.items()}
    shared = spark.sparkContext.broadcast((states, places, last))
    schema = T.StructType([dealt.schema["conv_id"], T.StructField("place", T.LongType()), dealt.schema["turn"], *T.StructType.fromDDL("role_in string, role string, action string, rendered string").fields])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (states, places, last) = TaskContext.get().partitionId(), shared.value
        out: list[list] = [[] for _ in schema.names]
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema.names)
            for c in out:
                c.clear()
            return made

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = [batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, *[pa.string()] * 4]
                yield batch

        for conv, (turn, roles, texts) in _whole(_runs(typed())):
            best, end = states.get((at, conv), (BEGIN, None))
            first, whole = places.get((at, conv), 0), (at, conv) not in places or (at, conv) in last
            steps, state = repair([CODE.get(r, OTHER) for r in roles], best, end)
            open_turn = first > 0
            for k, (was, (role, merged, before), text) in enumerate(zip(roles, steps, texts, strict=True)):
                text = text or ""
                if merged:
                    rendered = f"\n{text}"
                else:
                    rendered = (CLOSE if open_turn else "") + "".join(frame(r, "") + CLOSE for r in before) + frame(role, text)
                open_turn = True
                if whole and k == len(steps) - 1:
                    rendered += CLOSE + "".join(frame(r, "") + CLOSE for r in CLOSING[state])
                action = "+".join([*["relabel"] * (was != role), *["merge"] * merged]) or "keep"
                row = (conv, first + k, turn[k], was, role, action + "+insert" * bool(before), rendered)
                for c, x in zip(out, row, strict=True):
                    c.append(x)
                if len(out[0]) >= ROWS:
                    yield flush()
        if out[0]:
            yield flush()

    return dealt.mapInArrow(write, schema)


def _states(dealt: DataFrame, cut: dict) -> dict[tuple[int, object], tuple[list[int], int]]:
    """(costs before it, last state) of each piece of the conversations in ``cut``, by task and conv_id."""
    if not cut:
        return {}
    field = dealt.schema["conv_id"]
    named = F.col("conv_id").isin([c for c in cut if c is not None]) | (F.col("conv_id").isNull() if None in cut else F.lit(False))
    rows = dealt.where(F.coalesce(named, F.col("conv_id").isNull() & F.lit(None in cut))).select("conv_id", "role")
    spark = dealt.sparkSession

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, total, kind = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, (roles,) in _runs([batch]):
                m = fold([CODE.get(r, OTHER) for r in roles])
                if total is not None and conv == now:
                    total = np.minimum((total[:, :, None] + m[None]).min(1), INF)
                    continue
                if total is not None:
                    yield _row(at, now, total.ravel().tolist(), kind)
                now, total = conv, m
        if total is not None:
            yield _row(at, now, total.ravel().tolist(), kind)

    def _row(at: int, conv: object, numbers: list[int], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([conv], kind), pa.array([numbers], pa.list_(pa.int64()))], ["task", "conv_id", "numbers"])

    schema = T.StructType([T.StructField("task", T.IntegerType()), field, T.StructField("numbers", T.ArrayType(T.LongType()))])
    found = {(r["task"], r["conv_id"]): np.array(r["numbers"]).reshape(4, 4) for r in rows.mapInArrow(folded, schema).collect()}
    before, closing = {}, {}
    for conv, parts in cut.items():
        best = BEGIN
        for at, _ in parts:
            before[at, conv] = best
            best = after(best, found[at, conv])
        closing[conv] = min(range(4), key=lambda s: best[s] + END[s])
    shared = spark.sparkContext.broadcast(before)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kind = TaskContext.get().partitionId(), None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for conv, (roles,) in _whole(_runs(typed())):
            yield _row(at, conv, origins([CODE.get(r, OTHER) for r in roles], shared.value[at, conv]), kind)

    came = {(r["task"], r["conv_id"]): r["numbers"] for r in rows.mapInArrow(traced, schema).collect()}
    out = {}
    for conv, parts in cut.items():
        state = closing[conv]
        for at, _ in reversed(parts):
            out[at, conv] = (before[at, conv], state)
            state = came[at, conv][state]
    return out


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its partitions and their order as they are."""
    context = df.sparkSession.sparkContext
    before = context.getCheckpointDir()
    if before is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()
