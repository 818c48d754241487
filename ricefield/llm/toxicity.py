"""Toxic passages: maximum-scoring segments over word log-odds, calibrated by extreme values.

A word (a run of letters, marks and digits, lower-cased) has as score the log of its odds in
toxic against clean training documents, both under a Dirichlet prior (``PRIOR`` for each
word seen), less ``Z`` of its standard errors and ``COST``; a word counts once a document.
A passage is a maximal scoring segment of a document: one linear scan over the running sums
finds all of them (the best one, the best ones left and right of it, and so on).

What a passage's score S means depends on the text's length n: among clean texts the best
one exceeds S with probability 1 - exp(-K n exp(-lambda S)).  lambda and K are fitted to the
best passages of clean documents (greatest likelihood; without any passage: at most 0).  A
document's evidence is -ln p of its best passage, or of several significant ones together by
the sum of their normalised scores; a logistic curve over it gives the score from 0 to 1.

Words are hashed to ``BUCKETS`` slots, so the table of scores has a fixed size; counts come
from all training documents.  The calibration uses documents that the word scores in use
have not seen: the training rows are ``FOLDS`` folds, each scored by the others' words.  It
is fitted to counts over bins (of best score and length, and of evidence), so all training
rows take part and the driver gets bounded tables only.

Cases: null and empty texts have no words, no passage and no evidence; labels without a
document, null labels and null ids are not used, and of several labels of an id one toxic is
enough; rows of one doc_id are scored each by its text; without training rows the curve
rests on its two added rows alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import table, written

BUCKETS = 1 << 20
PRIOR, Z, COST = 0.5, 1.0, 0.25
SIGNIFICANT = 0.05  # greatest p-value of a passage that is reported
FOLDS = 4
BINS, BIN = 400, 0.05  # of ln(1 + evidence)
SCORE_BINS, SCORE_BIN, LENGTH_BIN = 4000, 0.05, 0.25  # of best scores, and of ln n
BROADCAST_ROWS = 1_000_000  # labels are sent to every task up to this number, else both sides are shuffled

PASSAGES = "row long, n_words int, evidence double, first array<int>, length array<int>, value array<double>, p array<double>"


def words(text: str) -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def slots(found: Column) -> Column:
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, stop, score), in one pass over the runs of
    positive scores.  ``back`` links a candidate to the last one before it that starts from
    a lower running sum, so every candidate is stepped over once."""
    up = np.flatnonzero(np.diff(np.concatenate([[0], (scores > 0).view(np.int8), [0]])))
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    begins, ends = up[0::2], up[1::2]
    held: list[tuple[int, int, float, float, int]] = []
    for first, stop, low, high in zip(begins.tolist(), ends.tolist(), sums[begins].tolist(), sums[ends].tolist()):
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((first, stop, low, high, j))
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(first, stop, high - low) for first, stop, low, high, _ in held]


def evidence_of(normal: list[float]) -> float:
    """-ln p of normalised scores (lambda S - ln K n), greatest first: of the best alone, or
    of the best r together, whichever tells more; each further one costs ln 2."""
    if not normal:
        return 0.0
    p = -np.expm1(-exp(min(-normal[0], 700.0)))
    best = -log(p) if normal[0] < 30 else normal[0]
    total = normal[0]
    for r, value in enumerate(normal[1:], 2):
        if value <= 0:
            break
        total += value
        best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r) - (r - 1) * log(2))
    return best


@dataclass
class Scores:
    """Score of each word slot (in two bytes: every task gets the table), and the
    extreme-value parameters."""

    weights: np.ndarray
    lam: float = 1.0
    k: float = 1.0

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.weights[words].astype(np.float32)


def word_scores(clean: np.ndarray, toxic: np.ndarray) -> Scores:
    """From documents counts of each slot."""
    seen = np.count_nonzero(clean + toxic)
    if not seen:
        return Scores(np.full(BUCKETS, -COST, dtype=np.float16))
    a, b = toxic.astype(np.float32) + np.float32(PRIOR), clean.astype(np.float32) + np.float32(PRIOR)
    odds = np.log(a) - np.log(b) + np.float32(log((clean.sum() + PRIOR * seen) / (toxic.sum() + PRIOR * seen)))
    odds -= np.float32(Z) * np.sqrt(1 / a + 1 / b) + np.float32(COST)
    return Scores(odds.astype(np.float16))


def fit_extremes(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """lambda and K from the number of clean documents by (bin of best score, bin of ln n);
    bin 0 of the score: no passage."""
    if not any(b for b, _ in counts):
        return 1.0, 1.0
    rows = np.array([(b, c, k) for (b, c), k in counts.items()], dtype=np.float64)
    best, n, k = (rows[:, 0] - 0.5) * SCORE_BIN, np.exp(rows[:, 1] * LENGTH_BIN), rows[:, 2]
    some = rows[:, 0] > 0
    none = float(k[~some] @ n[~some])
    best, n, k = best[some], n[some], k[some]

    def slope(lam: float) -> tuple[float, float]:
        tail = k * n * np.exp(-lam * best)
        scale = k.sum() / (tail.sum() + none)
        return k.sum() / lam - k @ best + scale * (tail @ best), scale

    low, high = 1e-3, 50.0
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if slope(middle)[0] > 0 else (low, middle)
    return low, slope(low)[1]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _best(by_fold: list[Scores]):
    """Score of the best passage of each row, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = _lists(batch.column("words"))
            fold = batch.column("fold").to_numpy()
            best = np.zeros(batch.num_rows)
            for k in range(batch.num_rows):
                scores = by_fold[fold[k]].of(ids[ends[k] : ends[k + 1]])
                best[k] = max((v for _, _, v in segments(scores)), default=0.0)
            yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(best), pa.array(np.diff(ends))], names=["fold", "best", "n"])

    return run


def _passages(by_fold: list[Scores]):
    """Evidence and significant passages of each row of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = _lists(batch.column("words"))
            fold = batch.column("fold").to_numpy()
            rows = []
            for k in range(batch.num_rows):
                scores, n = by_fold[fold[k]], int(ends[k + 1] - ends[k])
                found = segments(scores.of(ids[ends[k] : ends[k + 1]]))
                cut = log(scores.k * max(n, 1))
                normal = sorted((scores.lam * v - cut for _, _, v in found), reverse=True)
                p = [-np.expm1(-exp(min(cut - scores.lam * v, 700.0))) for _, _, v in found]
                told = [(f, s - f, v, x) for (f, s, v), x in zip(found, p) if x <= SIGNIFICANT]
                rows.append((n, evidence_of(normal), *([list(c) for c in zip(*told)] if told else [[], [], [], []])))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["row", "n_words", "evidence", "first", "length", "value", "p"],
            )

    return run


@dataclass
class Model:
    scores: Scores
    intercept: float
    slope: float


def fit_curve(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Logistic curve over the bins' ln(1 + evidence), by Newton's steps; the small ridge
    and one added row of each label keep it finite."""
    bins = np.arange(BINS)
    n = np.array([[counts.get((b, t), 0) for t in (0, 1)] for b in bins], dtype=np.float64)
    n[0, 0] += 1
    n[-1 if not n[:, 1].any() else int(np.flatnonzero(n[:, 1])[-1]), 1] += 1
    x = np.stack([np.ones(BINS), (bins + 0.5) * BIN], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        total = n.sum(axis=1)
        slope = x.T @ (n[:, 1] - total * p) - 1e-3 * at
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return float(at[0]), float(max(at[1], 1e-6))  # more evidence is never less toxic


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1)."""
    given = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    given = written(given, "toxic-labels")
    if given.count() <= BROADCAST_ROWS:
        given = F.broadcast(given)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(FOLDS)).cast("int")
    train = docs.select("doc_id", "text").join(given, "doc_id").select(fold.alias("fold"), "toxic", slots(words("text")).alias("words"))
    train = written(train, "toxic-train")
    told = train.select("fold", "toxic", F.explode(F.array_distinct("words")).alias("slot")).groupBy("slot").agg(
        *[F.count_if((F.col("fold") == f) & (F.col("toxic") == t)).cast("int").alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    )
    told = told.toArrow()  # one row per slot at most: their number is a parameter
    counts = np.zeros((FOLDS, 2, BUCKETS), dtype=np.int32)
    for f in range(FOLDS):
        for t in (0, 1):
            counts[f, t, told["slot"].to_numpy()] = told[f"n{f}_{t}"].to_numpy()
    del told
    clean, toxic = counts.sum(axis=0, dtype=np.int32)
    crossed = [word_scores(clean - counts[f, 0], toxic - counts[f, 1]) for f in range(FOLDS)]
    best = train.where("toxic = 0 AND size(words) > 0").mapInArrow(_best(crossed), "fold int, best double, n long")
    # a fixed number of bins, whatever the scores: the last one holds the rest
    b = F.when(F.col("best") > 0, F.least(F.lit(SCORE_BINS), F.floor(F.col("best") / SCORE_BIN) + 1)).otherwise(0)
    c = F.round(F.log("n") / LENGTH_BIN)
    told = best.groupBy("fold", b.cast("int").alias("b"), c.cast("int").alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()
    for f in range(FOLDS):
        crossed[f].lam, crossed[f].k = fit_extremes({(r["b"], r["c"]): r["k"] for r in told if r["fold"] == f})
    del counts
    judged = train.withColumn("row", F.col("toxic").cast("long")).select("row", "fold", "words").mapInArrow(_passages(crossed), PASSAGES)
    place = F.least(F.lit(BINS - 1), F.floor(F.log1p("evidence") / BIN)).cast("int")
    fitted = {(r["b"], r["t"]): r["n"] for r in judged.groupBy(place.alias("b"), F.col("row").cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    scores = word_scores(clean, toxic)
    scores.lam, scores.k = (float(np.exp(np.mean(np.log([getattr(c, x) for c in crossed])))) for x in ("lam", "k"))
    return Model(scores, *fit_curve(fitted))


def score(docs: DataFrame, model: Model, column: str = "doc_id") -> DataFrame:
    """Each row's ``column``, words, evidence, score, and significant passages as arrays of
    first word, length, score and p-value."""
    rows = docs.select(F.col(column).cast("long").alias("row"), F.lit(0).alias("fold"), slots(words("text")).alias("words"))
    found = rows.mapInArrow(_passages([model.scores]), PASSAGES)
    chance = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.log1p("evidence"))))
    return found.withColumn("score", chance).withColumnRenamed("row", column)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first, length, value, p, words): each significant passage and its words.
    Ids must be distinct here; rows without id are left out."""
    spans = score(docs, model).select("doc_id", F.explode(F.arrays_zip("first", "length", "value", "p")).alias("_rf_p")).select("doc_id", "_rf_p.*")
    return spans.join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", "first", "length", "value", "p", F.array_join(F.slice(words("text"), F.col("first") + 1, F.col("length")), " ").alias("words")
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_words", "evidence", F.size("first").alias("n_passages"),
    )
