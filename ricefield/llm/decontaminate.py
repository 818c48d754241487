"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``11110111`` picks some of the token positions of a window and ignores the
others, so a window still matches when ignored tokens were substituted.  All windows of the
benchmark are hashed under each mask of ``MASKS``; a bit set of fixed size (``BITS``),
filled from these hashes, goes to every task.  Each document's windows are hashed the same
way, and the windows whose bits are set become hits.  Hits of a document that lie within an
item's reach of each other form one region, which carries its tokens.  The hits' hashes
are joined to the benchmark's hashes; that gives pairs of region and item and the diagonals
(document position less item position) on which they match.  Around the hits the tokens are
compared along each diagonal, mismatches allowed: the best segment counts a match as 1 and
a mismatch as -2 (-4 where that is not alike enough), and the parts beside it are searched
for further segments.  A document is contaminated by an item when such segments cover at least
``COVER`` of the item's tokens or ``LONG`` tokens.

Items shorter than the longest mask are also searched for whole: under the mask of all their
tokens and, where one substitution leaves a share of ``SIMILAR``, those with each position
left out.  Such an item is held when ``SIMILAR`` of its tokens are equal in place.

A bit set in which many bits are set lets more windows through to the join, and changes no
result.  Tokens are words in lower case without characters other than letters and digits.

Cases: a null or empty text has no tokens and no hits; an item of one token is held by every
text with that token, an item of none by no text; rows that share a doc_id, or have none, are told apart
by their text; repeated rows give one result; an empty table on either side gives an empty
result; other columns are ignored by ``overlaps`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import released, sized, table, words_of, written
from ricefield.llm.quality import mixed

# Masks: windows of 8 to 12 tokens, 7 or 8 of them compared.
MASKS = ("11110111", "1110100111", "1101011011", "111010010111")
LONGEST = max(map(len, MASKS))
BATCH = 4_000_000  # bytes of text worked on at once
BITS = 26  # the bit set has 2 ** BITS bits, 8 MB
COVER, LONG, SIMILAR = 0.6, 50, 0.8


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token, flat, and the offsets of each text's tokens."""
    import xxhash

    flat, ends = words_of(texts)
    coded = flat.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]", "")
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in bare.to_pylist()], np.uint64)
    empty = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    which = coded.indices.to_numpy()
    if not len(which):
        return np.zeros(0, np.uint64), ends
    keep = ~empty[which]
    return hashes[which[keep]], np.concatenate([[0], np.cumsum(keep)])[ends]


def window_hashes(tokens: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, hashes) of the windows that lie within one text."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)))
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out = (out ^ tokens[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return inside, mixed(out[inside])


def whole_masks(n: int) -> list[str]:
    """The masks under which an item of ``n`` tokens is searched for whole."""
    left_out = range(n) if n - 1 >= SIMILAR * n else ()
    return ["1" * n, *("1" * k + "0" + "1" * (n - k - 1) for k in left_out)]


def _owners(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(sized(batches, "text", BATCH)):
        tokens, ends = token_hashes(batch.column("text"))
        owner, items = _owners(ends), batch.column("item_id").to_numpy(zero_copy_only=False)
        for mask in MASKS:
            at, hashes = window_hashes(tokens, owner, mask)
            yield pa.record_batch(
                [pa.array(hashes.view(np.int64)), pa.array(items[owner[at]], pa.int64()), pa.array(at - ends[owner[at]], pa.int64())],
                ["hash", "item_id", "item_at"],
            )
        sizes = np.diff(ends)
        for n in np.unique(sizes[(sizes > 0) & (sizes < LONGEST)]).tolist():
            for mask in whole_masks(n):
                at, hashes = window_hashes(tokens, owner, mask)
                whole = sizes[owner[at]] == n
                at, hashes = at[whole], hashes[whole]
                yield pa.record_batch(
                    [pa.array(hashes.view(np.int64)), pa.array(items[owner[at]], pa.int64()), pa.array(np.zeros(len(at), np.int64))],
                    ["hash", "item_id", "item_at"],
                )


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(sized(batches, "text", BATCH)):
        tokens, ends = token_hashes(batch.column("text"))
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(tokens.view(np.int64)))
        yield pa.record_batch([batch.column("item_id"), lists.cast(pa.list_(pa.int64()))], ["item_id", "item_tokens"])


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def bit_set(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds, as bytes; at most ``2 ** (BITS - 6)`` rows come to the driver."""
    top, low = F.shiftrightunsigned("hash", 64 - BITS), F.col("hash").bitwiseAND((1 << BITS) - 1)
    bits = seeds.select(F.explode(F.array(top, low)).alias("bit")).select(
        F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one")
    )
    rows = bits.groupBy("word").agg(F.bit_or("one").alias("value")).toPandas()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64)
    return words.view(np.uint8)


def _has(bits: np.ndarray, probe: np.ndarray) -> np.ndarray:
    return (bits[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1


REGION = "region long, doc_id long, text_hash long, start long, tokens array<long>, hits array<struct<hash:long,at:long>>"


def _regions(bits, reach: int, masks: list[str]):
    """Hits of each document, gathered into regions that carry their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, made = bits.value, TaskContext.get().partitionId() << 33, 0
        for batch in released(sized(batches, "text", BATCH)):
            tokens, ends = token_hashes(batch.column("text"))
            owner = _owners(ends)
            found = []
            for mask in masks:
                at, hashes = window_hashes(tokens, owner, mask)
                first, second = _probes(hashes)
                hit = np.flatnonzero(_has(own, first))
                hit = hit[_has(own, second[hit])]
                found.append((at[hit], hashes[hit]))
            at, hashes = (np.concatenate(x) for x in zip(*found))
            if not len(at):
                continue
            order = np.lexsort((hashes, at))
            at, hashes = at[order], hashes[order]
            cut = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(owner[at]) > 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
            docs, text_hash = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            rows = []
            for b, e in zip(begin.tolist(), end.tolist()):
                k = owner[at[b]]
                low, high = max(ends[k], at[b] - reach), min(ends[k + 1], at[e - 1] + reach)
                hits = [{"hash": h, "at": a} for h, a in zip(hashes[b:e].view(np.int64).tolist(), (at[b:e] - ends[k]).tolist())]
                rows.append((task + made, docs[k], text_hash[k], int(low - ends[k]), tokens[low:high].view(np.int64), hits))
                made += 1
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["region", "doc_id", "text_hash", "start", "tokens", "hits"]
            )

    return run


def best_segment(equal: np.ndarray, off: int = 2) -> tuple[int, int]:
    """The run of positions with most points: 1 for an equal token, -``off`` for another."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -off))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


def segments(equal: np.ndarray) -> list[tuple[int, int]]:
    """All segments that are long and alike enough, the best one first, then in what is left
    on both sides of it."""
    out, parts = [], [(0, len(equal))]
    while parts:
        low, high = parts.pop()
        part = equal[low:high]
        if part.sum() < 6:
            continue
        begin, end = best_segment(part)
        if part[begin:end].sum() < SIMILAR * (end - begin):
            begin, end = best_segment(part, 4)  # a positive sum has four equal tokens of five
        if part[begin:end].sum() >= 6:
            out.append((low + begin, low + end))
        parts += [(low, low + begin), (low + end, high)]
    return out


def covered(tokens: np.ndarray, start: int, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int]:
    """(item tokens covered, first document token, tokens, equal tokens) over the segments
    on these diagonals that are long and alike enough."""
    hit = np.zeros(len(item), bool)
    first, last = 1 << 62, 0
    for diagonal in diagonals:
        low, high = max(0, start - diagonal), min(len(item), start + len(tokens) - diagonal)
        if high <= low:
            continue
        equal = item[low:high] == tokens[low + diagonal - start : high + diagonal - start]
        whole = len(equal) == len(item) < LONGEST and equal.sum() >= SIMILAR * len(item)
        for begin, end in [(0, len(item))] if whole else segments(equal):
            hit[low + begin : low + end] |= equal[begin:end]
            first, last = min(first, low + begin + diagonal), max(last, low + end + diagonal)
    n = int(hit.sum())
    return n, first if n else 0, last - first if n else 0, n


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            item = np.asarray(r.item_tokens, np.int64)
            n, first, length, equal = covered(np.asarray(r.tokens, np.int64), r.start, item, sorted(r.diagonals))
            if n >= min(LONG, COVER * len(item)):
                rows.append((r.doc_id, r.text_hash, r.item_id, first, length, equal, len(item)))
        names = ["doc_id", "text_hash", "item_id", "doc_start", "n_tokens", "n_equal", "item_tokens"]
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


OVERLAP = "doc_id long, text_hash long, item_id long, doc_start long, n_tokens long, n_equal long, item_tokens long"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: the place of the best
    region (in the document's tokens), its length and the number of equal tokens."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    # two items of one id are two items: the id stands for the pair of id and text
    items = items.distinct()
    seeds = written(items.mapInArrow(_item_seeds, "hash long, item_id long, item_at long"), "item-seeds")
    tokens = written(items.mapInArrow(_item_tokens, "item_id long, item_tokens array<long>"), "item-tokens")
    reach = (tokens.agg(F.max(F.size("item_tokens"))).first()[0] or 0) + LONGEST
    # at most one row for each length below that of the longest mask
    short = tokens.select(F.size("item_tokens").alias("n")).where((F.col("n") > 0) & (F.col("n") < LONGEST)).distinct()
    masks = [*MASKS, *(mask for r in sorted(short.collect()) for mask in whole_masks(r.n))]
    bits = spark.sparkContext.broadcast(bit_set(seeds))
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    regions = written(read.mapInArrow(_regions(bits, reach, masks), REGION), "regions")
    hits = regions.select("region", F.explode("hits").alias("hit")).select("region", "hit.hash", "hit.at")
    pairs = hits.join(seeds, "hash").select("region", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = pairs.groupBy("region", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))
    # one region and item: at most as many diagonals as the region has hits
    found = (
        pairs.join(regions.drop("hits"), "region").join(tokens, "item_id")
        .select("doc_id", "text_hash", "start", "tokens", "item_id", "item_tokens", "diagonals").mapInPandas(_verify, OVERLAP)
    )
    best = F.max_by(F.struct("doc_start", "n_tokens", "n_equal", "item_tokens"), F.struct("n_equal", -F.col("doc_start")))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    bad = written(overlaps(docs, benchmark).select(F.col("doc_id").alias("_rf_llm_id"), F.col("text_hash").alias("_rf_llm_hash")).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_rf_llm_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_rf_llm_hash"))
    return docs.join(bad, same, "left_anti")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the overlap."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")
