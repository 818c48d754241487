"""Connected components of links between ids, as Spark jobs.

Large-star and small-star steps in turn: each id's larger neighbours are linked to the
smallest id around it, then each id's smaller neighbours are.  After a few rounds every id
is linked to the smallest id of its component and nothing changes any more.  The links of
each round are written to the shared folder, so no lineage grows and lost executors cost
one round at most.

Before the rounds each task joins its own links, at most ``LOCAL`` at a time, and passes on
one link for each id.  When all links are no more than that, nothing is left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricefield.llm.common import written


LOCAL = 400_000


def _joined(a: list[int], b: list[int]) -> pa.RecordBatch:
    """Each id of the links (a, b) with the smallest one that they reach, if that is another."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            above[max(x, y)] = min(x, y)
    ids = list(above)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["a", "b"])


def _contract(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if len(a) + part.num_rows > most:
                    yield _joined(a, b)
                    a, b = [], []
                a += part.column("a").to_pylist()
                b += part.column("b").to_pylist()
        yield _joined(a, b)

    return run


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (a, b) with a > b, distinct."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        moved = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every id that has a link, other than the roots themselves."""
    low, high = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    links = written(pairs.select(high.alias("a"), low.alias("b")).where("a > b").distinct(), "links")
    tasks = -(-links.count() // LOCAL)
    if tasks:
        links = written(links.coalesce(tasks).mapInArrow(_contract(LOCAL), "a long, b long"), "links")
    # one task had all links at once, or there are rounds to go
    state = _state(links) if tasks > 1 else (0,)
    while state[0]:
        links = written(_star(_star(links, True), False), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
