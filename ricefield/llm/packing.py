"""Best-fit packing of documents into fixed-length token sequences, residuals merged in a tree.

Each input partition turns its texts into ids, cuts only documents longer than a sequence,
and packs its pieces by best fit, longest first.  Nearly full bins are done.  The other
bins become items of the next rounds: ``fan_in`` neighbouring partitions meet in one task,
their underfull bins are packed by best fit again, and so on up the tree.

Two bins of one task always hold more than a sequence together (best fit would have put
them in one), so a task has at most one bin that is half empty, and all later rounds can
make at most as many merges as there are partitions.  So each task passes on at most that
many of its emptiest bins, which loses no merge and bounds every task of every round.

Cases: a null or empty text is its end id alone; ties in length are taken in order of
document and piece; repeated rows are packed each for itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import released, sized, table, written
from ricefield.llm.token_ids import token_ids

LENGTH, END_ID, FAN_IN = 4096, 1, 8
BATCH = 4_000_000  # bytes of text encoded at once
SLACK = 41  # a bin that lacks at most this many tokens (1 %) is nearly full
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, each into the fullest bin that it fits.

    Open bins are kept by the room left in them, and a bit set of the rooms in use finds
    the least room that is enough."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, which, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = which, capacity - room
        left = room - need
        if left:
            by_room[left].append(which)
            rooms |= 1 << left
    return bins, offsets


def pack_partition(path: str, length: int, end_id: int):
    """The local round: texts to pieces to bins, for one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, own = token_ids(path), []
        for batch in released(sized(batches, "text", BATCH)):
            ids, ends = codes.encode(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for k, doc in enumerate(docs):
                text = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(text), length)):
                    part = text[at : at + length]
                    own.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
        if not own:
            return
        frame = pd.DataFrame(own, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype="object")
        frame = frame.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})
        frame = frame.sort_values(["doc_id", "piece"], kind="stable")
        bins, frame["offset"] = best_fit(frame["length"].to_numpy(), length)
        task = TaskContext.get().partitionId()
        frame.insert(5, "part", np.int32(task))
        frame.insert(6, "bin", bins + (task << 32))
        frame["fill"] = np.bincount(bins, frame["length"]).astype(np.int64)[bins]
        schema = pa.schema([(c, pa.int32() if c in ("piece", "part") else pa.int64()) for c in frame.columns])
        yield from pa.Table.from_pandas(frame, schema, preserve_index=False).to_batches(65536)

    return run


def merge_round(length: int):
    """Underfull bins of one task as items: ``bin`` is the bin of the first round, ``root``
    the one it is part of now, ``shift`` its place there, ``fill`` what the root holds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        roots = frame[["root", "fill"]].drop_duplicates("root").sort_values(["fill", "root"], ascending=[False, True])
        bins, offsets = best_fit(roots["fill"].to_numpy(), length)
        roots = roots.assign(which=bins, at=offsets)
        roots["to"] = roots["root"].where(roots["at"] == 0).groupby(roots["which"]).transform("max").astype("int64")
        roots["sum"] = roots.groupby("which")["fill"].transform("sum")
        roots = roots.set_index("root")
        frame = frame.assign(shift=frame["shift"] + frame["root"].map(roots["at"]), fill=frame["root"].map(roots["sum"]))
        return frame.assign(root=frame["root"].map(roots["to"]))

    return run


STATE = "part int, bin long, root long, shift long, fill long"


def _emptiest(state: DataFrame, most: int, nearly: int) -> DataFrame:
    """``go``: whether the row's root goes on to the next round."""
    rank = F.expr("dense_rank() over (partition by part order by fill, root)")
    return state.withColumn("go", (F.col("fill") < nearly) & (rank <= most))


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, fan_in: int = FAN_IN, slack: int = SLACK
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    local = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack_partition(path, length, end_id), PIECES)
    pieces = written(local, "packed")
    nearly = length - slack
    state = pieces.where((F.col("offset") == 0) & (F.col("fill") < nearly)).select(
        "part", "bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill"
    )
    last, n = pieces.agg(F.max("part"), F.countDistinct("part")).first()
    state, done, span = _emptiest(state, n or 0, nearly).where("go").drop("go"), [], 1
    while n and span <= last:
        span *= fan_in
        state = state.withColumn("part", F.expr(f"cast(part div {fan_in} as int)"))
        state = written(_emptiest(state.groupBy("part").applyInPandas(merge_round(length), STATE), n, nearly), "packing-round")
        done.append(state.where("not go"))
        state = state.where("go").drop("go")
    moved = reduce(DataFrame.unionByName, [d.drop("go") for d in done], state).select("bin", "root", "shift")
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into as few sequences of 4096 tokens as hierarchical best fit gives."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
