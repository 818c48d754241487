"""Sharding by fixed virtual slots.

Every record is hashed into one of ``slots`` virtual slots; that never changes.  A
versioned map says which shard each slot belongs to.  Version 0 deals the slots out in
turn.  Rebalancing aggregates bytes per slot and edits the map: slots move from shards
above the mean to shards below it until no move or swap evens them out any further, and
the edited map is stored as the next version.  Only the slots named in the edit move.

Law of the result: ``bytes`` (the shards' sizes are near equal).

Cases: a null text has no bytes and still one unit of size; the hash covers ``doc_id`` and
the text, so rows that share an id (or have none) spread over slots; wholly equal rows
share a slot and each gets its own place; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ricefield.llm.common import shared_folder, table, written

SLOTS, SHARDS, PARTS = 8192, 8, 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and ``part`` (a slot's rows are placed in
    ``PARTS`` separate parts, so that no task has to sort a whole slot)."""
    key = F.xxhash64("doc_id", "text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftright(key, 32), F.lit(PARTS)).cast("int").alias("part"),
    )


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def edited(shard_of: list[int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The slots to move, and their new shards, so that the shards' sizes come near each
    other.  ``sizes`` has at most as many entries as there are slots."""
    import bisect

    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        bisect.insort(held[shard], (sizes.get(slot, 0), slot))
    total = [sum(size for size, _ in own) for own in held]
    moved: dict[int, int] = {}
    for _ in range(4 * len(shard_of)):
        heavy = max(range(shards), key=lambda s: (total[s], -s))
        light = min(range(shards), key=lambda s: (total[s], s))
        gap = total[heavy] - total[light]
        best = (gap, None, None)  # what remains between the two after a move or a swap
        back = [(0, None), *held[light]]
        for item in held[heavy]:
            # the slot given back is the one that brings the difference nearest to half the gap
            at = bisect.bisect_left(back, (item[0] - gap / 2, -1), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
            for other in back[max(0, at - 1) : at + 1]:
                left = abs(gap - 2 * (item[0] - other[0]))
                if item[0] > other[0] and left < best[0]:
                    best = (left, item, other)
        if best[1] is None:
            break
        _, (size, slot), (other_size, other_slot) = best
        held[heavy].remove((size, slot))
        bisect.insort(held[light], (size, slot))
        moved[slot] = light
        if other_slot is not None:
            held[light].remove((other_size, other_slot))
            bisect.insort(held[heavy], (other_size, other_slot))
            moved[other_slot] = heavy
        total[heavy] -= size - other_size
        total[light] += size - other_size
    return {slot: shard for slot, shard in moved.items() if shard_of[slot] != shard}


def store_version(spark: SparkSession, folder: str, version: int, shard_of: list[int], moves: dict[int, int]) -> None:
    """One row per slot; ``moved`` marks the edit against the version before."""
    rows = [(slot, moves.get(slot, shard), slot in moves) for slot, shard in enumerate(shard_of)]
    frame = spark.createDataFrame(rows, "virtual_slot int, shard int, moved boolean")
    frame.coalesce(1).write.parquet(f"{folder}/version={version}")


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The map as of ``version`` (default: the last)."""
    maps = spark.read.schema("virtual_slot int, shard int, moved boolean, version int").parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def rebalance(rows: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> int:
    """Aggregate bytes per slot of ``records`` rows, edit the last stored map (or the
    first one, stored as version 0) and store the next version; returns its number."""
    spark = rows.sparkSession
    # one row per slot at most: its number is a parameter, whatever the input
    sizes = {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    try:
        last = sorted(load_version(spark, folder).collect())
        version, shard_of = last[0]["version"], [r["shard"] for r in last]
    except Exception as e:  # no map yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        version, shard_of = 0, first_map(slots, shards)
        store_version(spark, folder, 0, shard_of, {})
    store_version(spark, folder, version + 1, shard_of, edited(shard_of, sizes, shards))
    return version + 1


def assign(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Shard of each row, and ``slot``: its place in the shard, gapless from 0."""
    shard_map = shard_map.select("virtual_slot", "shard", "version")
    parts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most slots * PARTS rows, and one window partition for each shard
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.join(shard_map, "virtual_slot").select(
        "virtual_slot", "part", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("at", F.row_number().over(within) - 1)
    return placed.join(firsts, ["virtual_slot", "part"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Hash, aggregate, rebalance, assign.  ``folder`` keeps the versions of the map."""
    rows = written(records(docs, slots), "shard-records")
    folder = folder or shared_folder(docs.sparkSession, "shard-map")
    version = rebalance(rows, folder, shards, slots)
    return assign(rows, load_version(docs.sparkSession, folder, version))


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, sizes near equal."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
