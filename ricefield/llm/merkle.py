"""Merkle manifest of a dataset with stored hash midstates.

Each row is a leaf; leaves of one source ascend by doc_id and every 16 consecutive nodes
become their parent, level by level; the sources' roots, ordered by source, become the
dataset's root in the same way.  A child's digest as hex text is exactly one block of
SHA-256, so the state of a parent's hash before each child slot is eight words.  A parent
keeps these states (a copy before every slot) and its children's digests: to fold a changed
child into it, the state of the child's slot is picked up and takes in the new digest and
the siblings right of it only.  Nothing left of the change is hashed again, and the states
are plain data, so a later job can fold into a stored manifest.

Distribution: leaves are hashed where they are read, only digests are shuffled.  Positions
come from a range partitioning on (source, doc_id), which splits a hot source; nodes are
worked on in blocks of consecutive positions (256 leaves, later 4096 nodes), a block in one
task, and each pass shrinks the nodes by that factor.  A document's way to the root is the
levels of its block and the stored path of that block.  To the driver go the number of
levels and the root.

Cases: a null column is ``-`` in the leaf; rows without doc_id come first in their source
and are never tampered with; rows of one doc_id follow each other by leaf, and equal rows
are a leaf each; a null source is a source, the first; a lone leaf is its source's root and,
if it is the only source, the root, with the hash of nothing as proof; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm import sha256
from ricefield.llm.common import ragged_take, same, table, written
from ricefield.operators.ranking import sequence_number

ARITY, DIGITS = 16, 4  # children of a node, and the bits of a slot
FIRST_LEVELS, LEVELS = 2, 3  # levels of one pass: over leaves, over nodes above
BATCH = 16_384  # rows worked on at once (and the rest of their block)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "source string, level int, idx long, m int, digest string, states binary, children string"
FOLDED = "doc_id long, source string, leaf string, proof_sha256 string, folded_root string"


def leaf_of(docs: DataFrame, **changed: Column) -> Column:
    """H of the fields, each ``-`` or its byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        text = changed.get(name, docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = BATCH) -> Iterator[pa.Table]:
    """The rows in tables of at least ``least`` rows that end where the sorted keys change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        change = _changes(rows, keys)
        cut = int(np.flatnonzero(change)[-1])
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before (true for the first)."""
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        column = rows.column(key).combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return change


def _blocks(column) -> np.ndarray:
    """Digests in hex as blocks (n, 16)."""
    return sha256.words_of_text("".join(column.to_pylist()).encode())


def _grow(levels: int, base: int):
    """Parents of complete blocks of nodes, ``levels`` levels above level ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["source", "block"]):
            source = rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
            tree, idx = source.indices.to_numpy(zero_copy_only=False), rows.column("idx").to_numpy()
            n, words = rows.column("n").to_numpy(), _blocks(rows.column("digest"))
            for level in range(1, levels + 1):
                grows = n > 1
                tree, idx, n, words = tree[grows], idx[grows], n[grows], words[grows]
                if not len(idx):
                    break
                parent = idx >> DIGITS
                first = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (tree[1:] != tree[:-1])]))
                m = np.diff(np.append(first, len(idx)))
                state = sha256.fresh(len(first))
                kept = np.zeros((len(first), ARITY, 8), dtype=np.uint32)
                for slot in range(int(m.max())):
                    kept[:, slot] = state  # the copy that a later fold resumes
                    has = np.flatnonzero(m > slot)
                    state[has] = sha256.absorb(state[has], words[first[has] + slot])
                out = sha256.hex_words(sha256.finish(state, m))
                text, up = sha256.text_of_words(words).decode(), sha256.text_of_words(out).decode()
                yield pa.RecordBatch.from_arrays(
                    [
                        source.dictionary.take(pa.array(tree[first])).cast(pa.string()),
                        pa.array(np.full(len(first), base + level, dtype=np.int32)),
                        pa.array(parent[first]),
                        pa.array(m.astype(np.int32)),
                        pa.array([up[64 * i : 64 * i + 64] for i in range(len(first))], pa.string()),
                        pa.array([kept[i, : m[i]].astype(">u4").tobytes() for i in range(len(first))], pa.binary()),
                        pa.array([text[64 * a : 64 * (a + k)] for a, k in zip(first.tolist(), m.tolist())], pa.string()),
                    ],
                    names=["source", "level", "idx", "m", "digest", "states", "children"],
                )
                tree, idx, n, words = tree[first], parent[first], -(-n[first] // ARITY), out

    return run


def grow(nodes: DataFrame, name: str) -> DataFrame:
    """All parents above ``nodes`` (source, idx from 0, n nodes of the source, digest)."""
    spark = nodes.sparkSession
    parts, base = [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels = LEVELS if base else FIRST_LEVELS
        width = ARITY**levels
        blocks = nodes.where(F.col("n") > 1).withColumn("block", F.expr(f"idx div {width}"))
        dealt = blocks.repartition("source", "block").sortWithinPartitions("source", "block", "idx")
        parents = written(dealt.mapInArrow(_grow(levels, base), NODES), name)
        parts.append(parents)
        base += levels
        sizes = nodes.where(F.col("n") > 1).groupBy("source").agg(F.max("n").alias("n"))
        sizes = sizes.select(F.col("source").alias("of"), F.expr(f"(n + {width - 1}) div {width}").alias("n"))
        top = parents.where(F.col("level") == base)
        nodes = top.join(sizes, top["source"].eqNullSafe(sizes["of"])).select("source", "idx", "n", "digest")
        most = -(-most // width)
    if not parts:
        return spark.createDataFrame([], NODES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Manifest:
    """``leaves``: doc_id, source, idx, n, leaf (and what the caller kept); ``nodes`` and
    ``top_nodes``: the parents within sources and above their roots; ``subroots``: source,
    idx, n, digest; ``root``: the dataset's digest, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    top_nodes: DataFrame
    root: str | None


def build(docs: DataFrame, **kept: Column) -> Manifest:
    """The manifest of ``docs``; ``kept`` are more columns of the leaves."""
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of(docs).alias("leaf"),
        *[c.alias(k) for k, c in kept.items()], F.monotonically_increasing_id().alias("_rf_scan"),
    )
    # equal rows are told apart by where they were read, so that they can be split as well
    placed = sequence_number(leaves, ["doc_id", "leaf", "_rf_scan"], ["source"], name="idx", start=0).drop("_rf_scan")
    placed = written(placed, "merkle-leaves")
    sizes = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "of")
    leaves = placed.join(sizes, placed["source"].eqNullSafe(sizes["of"])).drop("of")
    nodes = grow(leaves.select("source", "idx", "n", F.col("leaf").alias("digest")), "merkle-nodes")
    # a source's root is its highest parent, or its lone leaf
    tops = nodes.groupBy("source").agg(F.max_by("digest", "level").alias("digest"))
    lone = leaves.where(F.col("n") == 1).select("source", F.col("leaf").alias("digest"))
    subroots = sequence_number(tops.unionByName(lone), ["source"], name="idx", start=0)
    n_sources = subroots.count()
    subroots = written(subroots.withColumn("n", F.lit(n_sources).cast("long")), "merkle-subroots")
    top_nodes = grow(subroots.select(F.lit(None).cast("string").alias("source"), "idx", "n", "digest"), "merkle-top")
    last = top_nodes.orderBy(F.col("level").desc()).select("digest").head() if n_sources > 1 else subroots.select("digest").head()
    return Manifest(leaves, nodes, subroots, top_nodes, last[0] if last else None)


def _steps(rows: DataFrame, nodes: DataFrame, level: int, shift: int, by_source: bool) -> DataFrame:
    """``rows`` with one more step in ``path``: what a parent at ``level`` needs to fold in
    the child on the way (its place is ``at`` >> shift - DIGITS)."""
    up = nodes.where(F.col("level") == level).select(
        F.col("source").alias("_rf_of"), F.col("idx").alias("_rf_up"), F.col("m").alias("_rf_m"), "states", "children"
    )
    on = F.shiftright("at", shift) == F.col("_rf_up")
    if by_source:
        on &= same("source", "_rf_of")
    slot = (F.shiftright("at", shift - DIGITS) % ARITY).cast("int")
    step = F.struct(
        F.col("_rf_m").alias("m"),
        F.expr("substring(states, _rf_slot * 32 + 1, 32)").alias("state"),
        F.expr("substring(children, 1, _rf_slot * 64)").alias("left"),
        F.expr("substring(children, _rf_slot * 64 + 65, 1024)").alias("right"),
    )
    joined = rows.withColumn("_rf_slot", slot).join(up, on, "left")
    more = F.when(F.col("_rf_up").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step)))
    return joined.select(*[c for c in rows.columns if c != "path"], more.alias("path"))


NO_PATH = "array<struct<m:int,state:binary,left:string,right:string>>"


def paths(manifest: Manifest) -> DataFrame:
    """(source, block, path, subroot): the steps from each block of leaves up to the root."""
    nodes, top = manifest.nodes, manifest.top_nodes
    highest, top_highest = (d.agg(F.max("level")).first()[0] or 0 for d in (nodes, top))
    ways = manifest.subroots.select("source", F.col("idx").alias("at"), F.col("digest").alias("subroot"), F.array().cast(NO_PATH).alias("path"))
    for level in range(1, top_highest + 1):
        ways = _steps(ways, top, level, DIGITS * level, by_source=False)
    ways = written(ways.select(F.col("source").alias("of"), "subroot", F.col("path").alias("above")), "merkle-ways")
    width = ARITY**FIRST_LEVELS
    blocks = manifest.leaves.where(F.col("idx") % width == 0).select(
        "source", F.expr(f"idx div {width}").alias("at"), F.array().cast(NO_PATH).alias("path")
    )
    for level in range(FIRST_LEVELS + 1, highest + 1):
        blocks = _steps(blocks, nodes, level, DIGITS * (level - FIRST_LEVELS), by_source=True)
    return blocks.join(ways, same("source", "of")).select(
        "source", F.col("at").alias("block"), F.concat("path", "above").alias("path"), "subroot"
    )


def resume(states: np.ndarray, new: np.ndarray, pool: np.ndarray, starts: np.ndarray, rights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Parents' digests as blocks: the kept states before the changed slots take in the new
    child and then its right siblings, ``rights`` blocks of ``pool`` from ``starts``."""
    states = sha256.absorb(states, new)
    for step in range(int(rights.max(initial=0))):
        has = np.flatnonzero(rights > step)
        states[has] = sha256.absorb(states[has], pool[starts[has] + step])
    return sha256.hex_words(sha256.finish(states, m))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each as its path, its parents and its leaves: folded roots and proofs."""
    for rows in whole_groups(batches, ["source", "block"]):
        group = np.cumsum(_changes(rows, ["source", "block"])) - 1
        kind = rows.column("kind").to_numpy()
        path_rows, node_rows, leaf_rows = (np.flatnonzero(kind == k) for k in (0, 1, 2))
        if not len(leaf_rows):
            continue
        leaves = rows.take(pa.array(leaf_rows))
        own, idx = group[leaf_rows], leaves.column("idx").to_numpy()
        now = _blocks(leaves.column("new_leaf"))
        # parents of the block by (group, level, idx); their children in one pool of blocks
        nodes = rows.take(pa.array(node_rows))
        children = nodes.column("children").to_pylist()
        states = nodes.column("states").to_pylist()
        m_of = nodes.column("m").to_numpy()
        where = {k: i for i, k in enumerate(zip(group[node_rows].tolist(), nodes.column("level").to_pylist(), nodes.column("idx").to_pylist()))}
        pool = sha256.words_of_text("".join(children).encode())
        begins = np.cumsum(m_of) - m_of
        kept = np.frombuffer(b"".join(states), dtype=">u4").astype(np.uint32).reshape(-1, 8)  # one for each child
        siblings: list[list[str]] = [[] for _ in range(len(idx))]
        for level in range(1, FIRST_LEVELS + 1):
            at, slots = idx >> (DIGITS * level), (idx >> (DIGITS * (level - 1))) & (ARITY - 1)
            found = np.array([where.get(k, -1) for k in zip(own.tolist(), [level] * len(idx), at.tolist())], dtype=np.int64)
            has = np.flatnonzero(found >= 0)
            if not len(has):
                break
            f, s = found[has], slots[has]
            now[has] = resume(kept[begins[f] + s], now[has], pool, begins[f] + s + 1, m_of[f] - s - 1, m_of[f])
            for lane, node, slot in zip(has.tolist(), f.tolist(), s.tolist()):
                text = children[node]
                siblings[lane].append(text[: 64 * slot] + text[64 * slot + 64 :])
        # the steps above the block are the same for all its leaves
        ways = dict(zip(group[path_rows].tolist(), rows.take(pa.array(path_rows)).column("path").to_pylist()))
        steps = [ways[g] for g in range(group[-1] + 1)]
        for k in range(max(map(len, steps))):
            owners = [g for g, way in enumerate(steps) if len(way) > k]
            right = [steps[g][k]["right"] for g in owners]
            pool = sha256.words_of_text("".join(right).encode())
            rights, start, m = (np.zeros(len(steps), dtype=np.int64) for _ in range(3))
            rights[owners] = [len(r) // 64 for r in right]
            start[owners] = np.cumsum(rights[owners]) - rights[owners]
            m[owners] = [steps[g][k]["m"] for g in owners]
            state = np.zeros((len(steps), 8), dtype=np.uint32)
            state[owners] = np.frombuffer(b"".join(steps[g][k]["state"] for g in owners), dtype=">u4").reshape(-1, 8)
            has = np.flatnonzero(m[own] > 0)
            g = own[has]
            now[has] = resume(state[g], now[has], pool, start[g], rights[g], m[g])
        above = ["".join(s["left"] + s["right"] for s in way) for way in steps]
        proofs = [hashlib.sha256(("".join(mine) + above[g]).encode()).hexdigest() for mine, g in zip(siblings, own.tolist())]
        text = sha256.text_of_words(now).decode()
        yield pa.RecordBatch.from_arrays(
            [
                leaves.column("doc_id").combine_chunks(), leaves.column("source").combine_chunks(), leaves.column("leaf").combine_chunks(),
                pa.array(proofs, pa.string()), pa.array([text[64 * i : 64 * i + 64] for i in range(len(idx))], pa.string()),
            ],
            names=["doc_id", "source", "leaf", "proof_sha256", "folded_root"],
        )


def fold(manifest: Manifest, new_leaf: str) -> DataFrame:
    """Per leaf: its proof, and the root after its digest alone becomes ``new_leaf`` (a
    column of the leaves), from the stored states and right siblings."""
    width = ARITY**FIRST_LEVELS
    block = F.expr(f"idx div {width}").cast("long").alias("block")
    leaves = manifest.leaves.select("source", block, F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", "doc_id", "leaf", F.col(new_leaf).alias("new_leaf"))
    low = manifest.nodes.where(F.col("level") <= FIRST_LEVELS)
    low = low.select(
        "source", F.expr(f"shiftright(idx, {DIGITS} * ({FIRST_LEVELS} - level))").cast("long").alias("block"),
        F.lit(1).alias("kind"), "level", "idx", "m", "states", "children",
    )
    ways = written(paths(manifest), "merkle-paths")
    up = ways.select("source", "block", F.lit(0).alias("kind"), F.lit(0).alias("level"), "path")
    rows = leaves.unionByName(low, allowMissingColumns=True).unionByName(up, allowMissingColumns=True)
    dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", "kind", "level", "idx")
    folded = dealt.mapInArrow(_fold, FOLDED)
    subroots = manifest.subroots.select(F.col("source").alias("of"), F.col("digest").alias("subroot"))
    return folded.join(subroots, same("source", "of")).drop("of").withColumn("root", F.lit(manifest.root).cast("string"))


def op13_merkle_midstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves; a fifth is folded back with its text lower-cased."""
    docs = table(spark, sf_dir, "documents")
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    manifest = build(docs, new_leaf=F.when(chosen, leaf_of(docs, text=low)).otherwise(leaf_of(docs)))
    out = fold(manifest, "new_leaf")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM documents
), hashed AS (
  SELECT doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    text, low,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes),
      lambda c, d: list_reduce(list_prepend(xor(c, d), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
        lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, CAST(3988292384 AS BIGINT)) ELSE e >> 1 END)),
      CAST(4294967295 AS BIGINT)) % 5 = 0 AS chosen
  FROM docs
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN chosen THEN sha256(head || coalesce(strlen(low) || ':' || low, '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS new_leaf
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), tree AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM tree WHERE n > 1 GROUP BY source, level, idx // 16, n
), subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM top WHERE n > 1 GROUP BY level, idx // 16, n
), runs AS (
  SELECT false AS above, source, level, idx // 16 AS run, string_agg(digest, '' ORDER BY idx) AS children
  FROM tree WHERE n > 1 GROUP BY source, level, idx // 16
  UNION ALL
  SELECT true, NULL, level, idx // 16, string_agg(digest, '' ORDER BY idx) FROM top WHERE n > 1 GROUP BY level, idx // 16
), walk AS (
  SELECT row_number() OVER () AS row_no, p.doc_id, p.source, p.leaf, s.digest AS subroot, s.idx AS top_idx, s.n AS top_n,
    p.n = 1 AS above, 0 AS level, CASE WHEN p.n = 1 THEN s.idx ELSE p.idx END AS idx,
    CASE WHEN p.n = 1 THEN s.n ELSE p.n END AS n, p.new_leaf AS folded, '' AS siblings
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT row_no, doc_id, w.source, leaf, subroot, top_idx, top_n, w.above OR n <= 16,
    CASE WHEN NOT w.above AND n <= 16 THEN 0 ELSE w.level + 1 END,
    CASE WHEN NOT w.above AND n <= 16 THEN top_idx ELSE idx // 16 END,
    CASE WHEN NOT w.above AND n <= 16 THEN top_n ELSE (n + 15) // 16 END,
    sha256(substring(children, 1, 64 * (idx % 16)) || folded || substring(children, 64 * (idx % 16) + 65)),
    siblings || substring(children, 1, 64 * (idx % 16)) || substring(children, 64 * (idx % 16) + 65)
  FROM walk w JOIN runs r ON r.above = w.above AND (w.above OR r.source IS NOT DISTINCT FROM w.source)
    AND r.level = w.level AND r.run = w.idx // 16
  WHERE n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk, (SELECT digest AS root FROM top WHERE n = 1)
WHERE above AND n = 1
"""
