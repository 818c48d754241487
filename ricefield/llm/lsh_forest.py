"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct word shingles (as 64-bit hashes).  Documents with equal
sets form one class, of which the smallest doc_id goes on.  The signature has one minimum
for each of ``TREES * LEAST`` hash functions.  Tree t is the list of all signatures sorted
from value ``t * LEAST`` on, round the end to the beginning, so each tree begins with other
values.  Sorting is a range partitioning of (tree, signature), which splits crowded
regions over tasks.

Neighbours in a tree that share at least ``LEAST`` leading values are candidates, and the
depth adapts to the region: two documents whose longest common prefix has d values are
compared when at most ``CROWD`` documents share these d values; in a more crowded region
they go as deep as it takes to be in one that is not.  Besides, every document meets its
next ``STEPS`` neighbours in every tree, whatever the crowd.

Candidates are confirmed on the full sets in rounds.  The first takes for each document its
best candidates (by agreement of signatures); the links confirmed join documents into
components.  The next round confirms the candidates that still lie between components.
Candidates whose signatures agree in fewer than ``AGREE`` of all values are not confirmed
(of pairs with a similarity of 0.8, one in a hundred million: binomial, 1.0e-8).

What the trees leave out is made good exactly (``crowd_pairs``): the rows of crowded regions,
and those of regions that touch the border of a range partition, go through a prefix join on
their rarest shingles, which loses no pair between components.  Shingles that only one
component has cannot link two and come first in the order, so a crowd that shares much
but is not alike meets on few shingles or none.

Two documents with a similarity of 0.8 share no leading values in a tree with probability
1 - 0.8 ** LEAST, and in all trees with (1 - 0.8 ** 4) ** 24, three in a million.

Cases: a null or empty text has an empty set and no links; a text with fewer words than a
shingle is one shingle of all its words; equal sets are one class, whatever their ids; rows
of one doc_id with different texts are looked at each by itself, and ``near_duplicates``,
whose components are of ids, links them, while ``keep_one``, whose groups are of texts,
does not; rows without doc_id are kept, with no component; an empty table gives an empty
result; other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ricefield.llm.common import only_last_kept, released, sized, table, words_of, written
from ricefield.llm.components import components
from ricefield.llm.quality import mixed
from ricefield.llm.repeated_spans import maybe_among

TREES, LEAST, CROWD, STEPS, AGREE = 24, 4, 16, 2, 0.55
K = TREES * LEAST
BATCH = 1_000_000  # bytes of text worked on at once
PREFIX = 24  # values of a tree's order that are compared; a prefix of equal ones goes by id


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets."""
    import xxhash

    flat, ends = words_of(texts, lower=True)
    n_docs, n = len(ends) - 1, len(flat)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    values = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    word = values[coded.indices.to_numpy()] if n else np.zeros(0, np.uint64)
    sizes = np.diff(ends)
    with np.errstate(over="ignore"):
        m = max(0, n - width + 1)
        shingle = np.full(m, np.uint64(width))
        for k in range(width):
            shingle = mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + word[k : m + k])
    owner = np.repeat(np.arange(n_docs), sizes)
    inside = np.flatnonzero(owner[:m] == owner[width - 1 :]) if m else np.zeros(0, np.int64)
    hashes, owners = [shingle[inside]], [owner[inside]]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):  # all words of a short text are one shingle
        one = []
        with np.errstate(over="ignore"):
            for d in short.tolist():
                value = np.full(1, np.uint64(sizes[d]))
                for w in word[ends[d] : ends[d + 1]]:
                    value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + w)
                one.append(value)
        hashes += one
        owners.append(short)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    hashes, counts = hashes[order], np.bincount(owners, minlength=n_docs)
    parts, sizes, at = [], np.zeros(n_docs, np.int64), 0
    for d, c in enumerate(counts.tolist()):
        if c:
            own = np.sort(hashes[at : at + c])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts.append(own)
            sizes[d], at = len(own), at + c
    return np.concatenate(parts) if parts else hashes[:0], np.concatenate([[0], np.cumsum(sizes)])


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    state = mixed(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (state[:K] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (state[K:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, K) minima; a document with an empty set has the largest value."""
    out = np.full((len(ends) - 1, K), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
        starts = ends[:-1][full]
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(*_multipliers())):
                out[full, k] = np.minimum.reduceat((low ^ b) * a, starts)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in released(sized(batches, "text", BATCH)):
            sets, ends = shingle_sets(batch.column("text"), width)
            rows = signatures(sets, ends).astype(">u4").tobytes()
            digests = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([rows[i * 4 * K : (i + 1) * 4 * K] for i in range(batch.num_rows)], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "signature"],
            )

    return run


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tree: the leading values of its order."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, 4 * K)
            values = np.concatenate([values, values[:, : 4 * PREFIX]], axis=1)
            ids, n = part.column("node"), part.num_rows
            for tree in range(TREES):
                lead = np.ascontiguousarray(values[:, 4 * LEAST * tree : 4 * (LEAST * tree + PREFIX)]).tobytes()
                lead = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * PREFIX), n, [None, pa.py_buffer(lead)])
                yield pa.record_batch([pa.array(np.full(n, tree, np.int32)), lead.cast(pa.binary()), ids], ["tree", "lead", "node"])


def region_pairs(shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows in sorted order; ``shared[i]``: leading values that rows i
    and i + 1 have in common (0 between trees)."""
    left, right = [], []
    sizes = {}  # rows that share at least d values with the row: region sizes by depth
    for d in range(LEAST, PREFIX + 1):
        begins = np.concatenate([[True], shared < d])
        region = np.cumsum(begins) - 1
        sizes[d] = np.bincount(region)[region]
    size = np.zeros((PREFIX + 1, n), np.int64)
    for d, s in sizes.items():
        size[d] = s
    common = None
    for step in range(1, CROWD):
        if n <= step:
            break
        common = shared.copy() if step == 1 else np.minimum(common[:-1], shared[step - 1 :])
        at = np.flatnonzero(common >= LEAST)
        if not len(at):
            break
        if step > STEPS:
            at = at[size[common[at], at] <= CROWD]
        left.append(at)
        right.append(at + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among the sorted rows of a partition, and (node, node) for each row whose
    region is crowded or may go on in another partition.  Rows are worked on in runs that
    end where two neighbours share fewer than ``LEAST`` values, or at a bounded length."""
    trees, leads, nodes = np.zeros(0, np.int32), np.zeros((0, PREFIX), np.uint32), np.zeros(0, np.int64)
    first = True

    def out(t: np.ndarray, v: np.ndarray, ids: np.ndarray, last: bool) -> pa.RecordBatch:
        equal = (v[1:] == v[:-1]) & (t[1:] == t[:-1])[:, None]
        shared = np.logical_and.accumulate(equal, axis=1).sum(axis=1) if len(v) > 1 else np.zeros(0, np.int64)
        a, b = region_pairs(shared, len(v))
        region = np.cumsum(np.concatenate([[True], shared < LEAST])) - 1
        open_ = (np.bincount(region)[region] > CROWD) | first & (region == 0) | last & (region == region[-1])
        alone = ids[open_]
        return pa.record_batch(
            [pa.array(np.concatenate([np.minimum(ids[a], ids[b]), alone])), pa.array(np.concatenate([np.maximum(ids[a], ids[b]), alone]))],
            ["a", "b"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        raw = b"".join(batch.column("lead").to_pylist())
        trees = np.concatenate([trees, batch.column("tree").to_numpy()])
        leads = np.concatenate([leads, np.frombuffer(raw, ">u4").reshape(-1, PREFIX).astype(np.uint32)])
        nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
        apart = np.flatnonzero((leads[1:, :LEAST] != leads[:-1, :LEAST]).any(axis=1) | (trees[1:] != trees[:-1])) + 1
        if len(apart):
            cut = int(apart[-1])
            yield out(trees[:cut], leads[:cut], nodes[:cut], False)
            trees, leads, nodes, first = trees[cut:], leads[cut:], nodes[cut:], False
        elif len(nodes) > 200_000:  # one region fills the partition; the next part begins CROWD rows back
            yield out(trees, leads, nodes, False)
            trees, leads, nodes, first = trees[-CROWD:], leads[-CROWD:], nodes[-CROWD:], False
    if len(nodes):
        yield out(trees, leads, nodes, True)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in ("sa", "sb"))
        agree = (a == b).sum(axis=1)
        keep = pa.array(agree >= AGREE * K)
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(agree.astype(np.int32))], ["a", "b", "agree"]).filter(keep)


def neighbours(classes: DataFrame) -> DataFrame:
    """(a, b): pairs a < b from all trees, and a = b for the rows that ``crowd_pairs`` has to see."""
    orders = classes.select("node", "signature").mapInArrow(_orders, "tree int, lead binary, node long")
    sorted_ = orders.repartitionByRange("tree", "lead", "node").sortWithinPartitions("tree", "lead", "node")
    return sorted_.mapInArrow(_neighbours, "a long, b long").distinct()


def candidates(near: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agree): pairs whose signatures agree well enough."""
    one, two = (classes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    return near.where("a < b").join(one, "a").join(two, "b").mapInArrow(_agreement, "a long, b long, agree int")


def _set_column(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(sized(batches, "text", BATCH)):
            sets, ends = shingle_sets(batch.column("text"), width)
            own = [sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([batch.column("node"), pa.array(own, pa.large_binary()).cast(pa.binary())], ["node", "shingles"])

    return run


def _confirm(similar: int):
    """Pairs of sets with 100 * intersection >= similar * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keep = []
            for x, y in zip(frame["xa"], frame["xb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < similar * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similar * (len(both) - common))
            yield frame.loc[keep, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"x{x}")) for x in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInPandas(_confirm(similar), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set."""
    for batch in sized(batches, "shingles", 4_000_000):
        n = np.array([len(x) // 8 for x in batch.column("shingles").to_pylist()], np.int64)
        shingle = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
        node, comp = (np.repeat(batch.column(c).to_numpy(), n) for c in ("node", "comp"))
        yield pa.record_batch([pa.array(x) for x in (node, comp, np.repeat(n, n), shingle)], ["node", "comp", "size", "shingle"])


def crowd_pairs(crowd: DataFrame, similar: int) -> DataFrame:
    """(a, b): every pair of sets (node, comp, shingles) of different components that can have
    100 * intersection >= similar * union, and others.

    With the shingles of all sets in one order, two such sets x, y (x not larger) have their
    first common shingle at place i of x and j of y with
    min(|x| - i, |y| - j) >= similar * (|x| + |y|) / (100 + similar).  So x need only be listed
    under its first ninth of shingles and y looked up by its first fifth (at 80).  Sets meet by
    shingle and band of sizes; a shingle that one component has alone is not looked up."""
    tokens = crowd.mapInArrow(_tokens, "node long, comp long, size long, shingle long")
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    common = common.where("low <> high").select("shingle", "df")
    own = Window.partitionBy("node")
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1
    band = F.floor(F.log(F.col("size").cast("double")) / (math.log(100 / similar) + 1e-9))
    placed = tokens.join(common, "shingle").withColumn("place", place).withColumn("band", band)
    placed = written(placed.where(100 * (F.col("size") - F.col("place")) >= similar * F.col("size")).drop("df"), "forest-crowd")
    listed = placed.where((100 + similar) * (F.col("size") - F.col("place")) >= 2 * similar * F.col("size"))
    x = listed.select("shingle", "band", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "size", "place")])
    bands = F.explode(F.array("band", F.col("band") - 1)).alias("band")
    y = placed.select("shingle", bands, *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "size", "place")])
    met = x.join(y, ["shingle", "band"]).where(
        f"""x_comp <> y_comp and (x_size < y_size or x_size = y_size and x_node < y_node) and 100 * x_size >= {similar} * y_size
        and {100 + similar} * least(x_size - x_place, y_size - y_place) >= {similar} * (x_size + y_size)"""
    )
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


BEST = 2


def text_key():
    return F.unhex(F.md5("text"))


def _with_component(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``, the smallest node that links reach."""
    root = components(links).select(F.col("id").alias("node"), "root")
    return nodes.join(root, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def linked(docs: DataFrame, width: int, similar: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of every row; the classes of equal sets (digest, node, first: the smallest
    doc_id of the class and its text's key); and links (a, b) between nodes, enough to join
    all that are alike."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", text_key())
    sketch = written(
        texts.mapInArrow(_sketch(width), "doc_id long, text_key binary, n_shingles long, digest binary, signature binary"), "forest-sketch"
    )
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "forest-classes")
    near = written(neighbours(classes), "forest-near")
    pairs = written(candidates(near, classes), "forest-pairs")
    crowded = near.where("a = b").select(F.col("a").alias("node"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct()
    wanted = written(classes.join(wanted, "node", "left_semi").select("node", "first.doc_id", "first.text_key"), "forest-wanted")
    kept = maybe_among(texts.where("doc_id is not null"), wanted, "doc_id").join(wanted, ["doc_id", "text_key"])
    sets = written(kept.dropDuplicates(["doc_id", "text_key"]).select("node", "text").mapInArrow(_set_column(width), "node long, shingles binary"), "forest-sets")
    # first round: each document's best candidates
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "agree")
    best = ends.groupBy(F.col("p.a").alias("a")).agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "p.b")), False), 1, BEST).alias("top"))
    best = best.select("a", F.explode("top").alias("t")).select(F.least("a", "t.b").alias("a"), F.greatest("a", "t.b").alias("b")).distinct()
    best = written(best, "forest-best")
    links = written(confirmed(best, sets, similar), "forest-links")
    root = components(links)
    # next round: what still lies between components
    one, two = (root.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    links = links.unionByName(written(confirmed(rest, sets, similar), "forest-links"))
    # last round: what the trees left out
    crowd = _with_component(sets.join(crowded, "node", "left_semi"), links)
    missed = crowd_pairs(crowd, similar).join(pairs, ["a", "b"], "left_anti")
    return sketch, classes, links.unionByName(written(confirmed(missed, sets, similar), "forest-links"))


def near_duplicates(docs: DataFrame, width: int = 5, similar: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row."""
    sketch, classes, links = linked(docs, width, similar)
    rows = sketch.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "digest")
    rows = written(rows.join(classes.select("digest", "node"), "digest").drop("digest"), "forest-rows")
    # rows of one id are one document
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    same_id = rows.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    nodes = written(_with_component(classes.select("node", "first.doc_id"), links.unionByName(same_id)), "forest-nodes")
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(nodes.select("node", "comp").join(least, "comp"), "node").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, width: int = 5, similar: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group of like texts (smallest doc_id; of
    repeated rows one), all columns as they are; rows without doc_id or words are in no group."""
    with only_last_kept(docs.sparkSession):
        sketch, classes, links = linked(docs, width, similar)
        nodes = written(_with_component(classes.select("node", "digest", "first"), links), "forest-nodes")
        stands = nodes.groupBy("comp").agg(F.min("first").alias("stands"))
        rows = sketch.where("n_shingles > 0 and doc_id is not null").select("digest", F.struct("doc_id", "text_key").alias("row")).distinct()
        gone = rows.join(nodes.select("digest", "comp").join(stands, "comp"), "digest").where("row <> stands")
        gone = written(gone.select(F.col("row.doc_id").alias("_rf_llm_gone"), F.col("row.text_key").alias("_rf_llm_text")), "forest-gone")
    left = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_rf_llm_gone")) & (text_key() == F.col("_rf_llm_text")), "left_anti")
    left = written(left, "forest-left")  # read three times below: the texts are dealt out once at most
    # repeated rows are few: only their ids are told apart by text
    again = left.where("doc_id is not null").groupBy(F.col("doc_id").alias("_rf_llm_again")).count().where("count > 1").select("_rf_llm_again")
    again = written(again, "forest-again")  # their size is known before the joins are planned
    repeated = F.col("doc_id") == F.col("_rf_llm_again")
    once = left.join(again, repeated, "left_anti")
    return once.unionByName(left.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word shingles and a similarity of 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
