"""Chat formatting by minimum-cost role repair.

A conversation is legal when its turns follow an automaton: a system turn may come first,
then user and assistant take turns, the user first.  A dynamic program over the automaton
finds the cheapest repair: each source turn keeps its role or is relabelled, joins the turn
before it (when both have the same role) or opens a new one, and empty turns are inserted
where the automaton needs one.  The state is the role of the last turn put out, so what a
run of turns can cost is a small min-plus matrix (state before to state after), and these
matrices can be multiplied in any grouping.

Conversations are cut into chunks of ``CHUNK`` turn numbers.  Chunks of one conversation
are worked on in different tasks: first each gives its matrix, then the matrices of the
conversations with several chunks fix the states at their borders, then each chunk is
repaired between its border states.  No task holds a whole long conversation.

The result has a row for each source turn; the ``rendered`` strings of a conversation, put
together in order of (chunk, place), are its formatted text.

Cases: turns are ordered by turn number (null first), then role and text, so repeated rows
and equal numbers have a fixed order; a null text is empty; an unknown or null role is
relabelled at a lower cost; a null conv_id is a conversation of its own; of repairs with
equal cost the one whose states come first in ``ROLES`` order is taken, from the end back;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import table

CHUNK = 1024
ROLES = ("system", "user", "assistant")  # state 0 is the beginning, then these
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # the automaton
FINAL = (0, 2, 3)  # states in which a conversation may end
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
INF = 1 << 40
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns to insert between a state and the next turn's role."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for start in NEXT:
        level = [(s, ()) for s in NEXT[start]]
        while level:
            later = []
            for state, between in level:
                if (start, state) not in found:
                    found[start, state] = between
                    later += [(s, (*between, state)) for s in NEXT[state]]
            level = later
    return found


PATHS = _paths()


def step_costs(role: str | None) -> np.ndarray:
    """Cost of one source turn from each state to each state."""
    out = np.full((4, 4), INF, np.int64)
    known = role in ROLES
    for to in (1, 2, 3):
        label = 0 if known and ROLES[to - 1] == role else RELABEL if known else RELABEL_UNKNOWN
        for state in range(4):
            if state == to:
                out[state, to] = label + MERGE
            if (state, to) in PATHS:
                out[state, to] = min(out[state, to], label + INSERT * len(PATHS[state, to]))
    return out


STEPS = {role: step_costs(role) for role in (*ROLES, None)}


def _step(role: str | None) -> np.ndarray:
    return STEPS[role if role in ROLES else None]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def matrix(roles: list[str | None]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
    for role in roles:
        out = times(out, _step(role))
    return out


def best_states(roles: list[str | None], start: int, ends: tuple[int, ...]) -> list[int]:
    """The state after each turn on the cheapest way from ``start`` to one of ``ends``."""
    costs = [np.where(np.arange(4) == start, 0, INF)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + _step(role)).min(axis=0), INF))
    state = min(ends, key=lambda s: (costs[-1][s], s))
    out = []
    for at in range(len(roles), 0, -1):
        out.append(state)
        ways = costs[at - 1] + _step(roles[at - 1])[:, state]
        state = int(ways.argmin())
    return out[::-1]


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """States at the end of each chunk of a conversation, on a cheapest way."""
    costs = [np.array([0, INF, INF, INF], np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), INF))
    state = min(FINAL, key=lambda s: (costs[-1][s], s))
    out = []
    for at in range(len(matrices), 0, -1):
        out.append(state)
        state = int((costs[at - 1] + matrices[at - 1][:, state]).argmin())
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (conv_id, chunk) at a time, from batches that are sorted by them."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and (row["conv_id"], row["chunk"]) != (own[-1]["conv_id"], own[-1]["chunk"]):
                yield own
                own = []
            own.append(row)
    if own:
        yield own


CELLS = [f"c{a}{b}" for a in range(4) for b in range(4)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _runs(batches):
        flat = matrix([r["role"] for r in own]).ravel().tolist()
        yield pa.record_batch(
            [pa.array([own[0]["conv_id"]], pa.int64()), pa.array([own[0]["chunk"]], pa.int64())]
            + [pa.array([c], pa.int64()) for c in flat],
            ["conv_id", "chunk", *CELLS],
        )


def _borders(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("chunk")
    ends = border_states([np.array(row, np.int64).reshape(4, 4) for row in frame[CELLS].itertuples(index=False)])
    return pd.DataFrame(
        {"conv_id": frame["conv_id"], "chunk": frame["chunk"], "enter": [0, *ends[:-1]], "leave": ends, "last": [False] * (len(ends) - 1) + [True]}
    )


REPAIRED = (
    "conv_id long, chunk long, place int, turn long, role string, new_role string, merged boolean, "
    "n_inserted int, cost int, rendered string"
)


def repaired(own: list[dict]) -> list[tuple]:
    """The rows of one chunk, repaired and rendered."""
    first = own[0]
    enter, leave = first["enter"] or 0, first["leave"]
    states = best_states([r["role"] for r in own], enter, FINAL if leave is None else (leave,))
    out, state = [], enter
    for place, (row, to) in enumerate(zip(own, states)):
        cost = int(_step(row["role"])[state, to])
        label = int(_step(row["role"])[0 if to != 3 else 2, to])  # what the role itself costs
        merged = state == to and cost == label + MERGE
        between = () if merged else PATHS[state, to]
        text = row["text"] or ""
        if merged:
            piece = "\n" + text
        else:
            empty = "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in between)
            piece = (CLOSE if state else "") + empty + OPEN.format(ROLES[to - 1]) + text
        if place == len(own) - 1 and first["last"] is not False:
            piece += CLOSE
        out.append((row["conv_id"], row["chunk"], place, row["turn"], row["role"], ROLES[to - 1], merged, len(between), cost, piece))
        state = to
    return out


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for own in _runs(batches):
        rows += repaired(own)
        if len(rows) >= 8192:
            yield out()
            rows = []
    if rows:
        yield out()


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each source turn: its new role, how it is put out and what that costs."""
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
        F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))).cast("long").alias("chunk"),
    )
    order = ["conv_id", "chunk", "turn", "role", "text"]
    several = (
        turns.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select(F.col("conv_id").alias("long_id"))
    )
    long_turns = turns.select("conv_id", "chunk", "turn", "role", F.xxhash64("text").alias("text"))
    # the second pass sees the text itself; turns that differ only in text have one role
    long_turns = long_turns.join(several, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    matrices = (
        long_turns.repartition("conv_id", "chunk").sortWithinPartitions(*order).select("conv_id", "chunk", "role")
        .mapInArrow(_matrices, "conv_id long, chunk long, " + ", ".join(f"{c} long" for c in CELLS))
    )
    borders = matrices.groupBy("conv_id").applyInPandas(_borders, "conv_id long, chunk long, enter int, leave int, last boolean")
    borders = borders.select(F.col("conv_id").alias("b_id"), F.col("chunk").alias("b_chunk"), "enter", "leave", "last")
    at_border = F.col("conv_id").eqNullSafe(F.col("b_id")) & (F.col("chunk") == F.col("b_chunk"))
    return (
        turns.join(borders, at_border, "left").repartition("conv_id", "chunk").sortWithinPartitions(*order)
        .select("conv_id", "chunk", "turn", "role", "text", "enter", "leave", "last").mapInArrow(_repairs, REPAIRED)
    )


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations, repaired at least cost and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
