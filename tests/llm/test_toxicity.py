import random
import zlib

import numpy as np
from llm.conftest import odd_rows, prose
from pyspark.sql import functions as F

from ricefield.llm import toxicity as tox

BAD = ["vilex", "scumx", "nastyx", "rottenx", "foulx"]


def brute_segments(scores, at=0):
    """The best segment (the shortest of the first), then those on both of its sides."""
    best, where = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best or (where and total == best and (j + 1 - i) < where[1] - where[0] and i == where[0]):
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    return [*brute_segments(scores[:i], at), (at + i, at + j, best), *brute_segments(scores[j:], at + j)]


def test_segments_against_brute_force():
    r = random.Random(2)
    for _ in range(400):
        scores = [r.choice([-7, -3, -2, -1, 1.5, 2.25, 4.125]) + r.random() for _ in range(r.randrange(0, 26))]
        got = tox.segments(np.array(scores))
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert tox.segments(np.array([-1.0, -2.0])) == []


def test_segments_take_linear_time():
    scores = np.where(np.arange(400_000) % 2, 1.0, -1.001)  # sums fall, so nothing merges
    assert len(tox.segments(scores)) == 200_000
    scores = np.where(np.arange(400_000) % 2, 1.001, -1.0)  # sums rise, so all merge
    assert len(tox.segments(scores)) == 1


def test_evidence_rises_with_scores():
    at = [tox.evidence_of([x]) for x in (-900, -5, -1, 0, 2, 29.9, 30.1, 500)]
    assert at == sorted(at) and at[0] == 0
    assert tox.evidence_of([6, 5, 4]) > tox.evidence_of([6]) == tox.evidence_of([6, -1])
    assert tox.evidence_of([]) == 0


def test_extreme_values_are_fitted():
    """Best scores drawn from the law itself give its parameters back."""
    r = np.random.default_rng(4)
    lam, k, counts = 1.7, 0.02, {}
    n = np.exp(r.uniform(2, 8, 20_000))
    best = np.log(k * n / r.exponential(size=len(n))) / lam
    for b, c in zip(best, np.round(np.log(n) / tox.LENGTH_BIN)):
        key = (int(b / tox.SCORE_BIN) + 1 if b > 0 else 0, int(c))
        counts[key] = counts.get(key, 0) + 1
    got = tox.fit_extremes(counts)
    assert abs(got[0] - lam) < 0.05 and abs(got[1] - k) < 0.002
    assert tox.fit_extremes({}) == tox.fit_extremes({(0, 4): 9}) == (1.0, 1.0)


def test_word_scores():
    clean, toxic = np.zeros(tox.BUCKETS), np.zeros(tox.BUCKETS)
    clean[:500], toxic[:500], toxic[500:520], clean[500:520] = 40, 4, 30, 1
    s = tox.word_scores(clean, toxic)
    assert s.weights[510] > 1 > 0 > s.weights[5]


def corpus(n=600):
    rows, labels = [], []
    for k in range(n):
        r = random.Random(k)
        words = prose(k, r.choice([5, 60, 300, 900]), 800).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(min(len(words), len(words) // 2), r.choice(BAD))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def is_held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def run(spark, tmp_path, docs, labels, name):
    docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    return tox.op11_toxic_segments(spark, str(tmp_path / name)).collect()


def test_held_out_accuracy_and_labels(spark, tmp_path, documents):
    rows, labels = corpus()
    full = [(k, 1, t) for k, t in labels]
    got = {r.doc_id: r for r in run(spark, tmp_path, documents(rows), full, "a")}
    held = [(got[k], t) for k, t in labels if is_held(k)]
    assert all(got[k].held_out == is_held(k) for k, _ in labels)
    assert sum(r.predicted == t for r, t in held) >= 0.97 * len(held)
    # labels held out, sources and languages change nothing
    flipped = [(k, 0, 1 - t if is_held(k) else t) for k, t in labels]
    other = documents(rows).withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in run(spark, tmp_path, other, flipped, "b")} == {k: r.score for k, r in got.items()}


def test_passages_are_found(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    model = tox.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = prose(77, 4000, 800).split()
    long[100:100] = ["vilex", "scumx", "nastyx", "foulx"]
    long[3000:3000] = ["rottenx", "vilex", "foulx", "scumx"]
    probe = documents([(1, " ".join(long)), (2, prose(78, 4000, 800))])
    found = tox.passages(probe, model).orderBy("first").collect()
    assert {r.doc_id for r in found} == {1}
    assert [set(r.words.split()) & set(BAD) for r in found] == [set(long[100:104]), set(long[3000:3004])]
    assert all(r.words.split()[0] in BAD and r.words.split()[-1] in BAD and r.p <= tox.SIGNIFICANT for r in found)


def test_odd_rows(spark, tmp_path, documents):
    rows, labels = corpus(120)
    full = [(k, 1, t) for k, t in labels] + [(0, 1, 0), (7, 0, None), (None, 1, 1), (10**9, 0, 1)]
    odd = odd_rows()
    got = run(spark, tmp_path, documents([(i if i is None else i + 1000, t) for i, t in odd] + rows, clashing=True), full, "a")
    assert len(got) == len(odd) + len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1001, 1002, 1003)}) == 1
    assert run(spark, tmp_path, documents([]), full, "b") == []
    assert all(0 <= r.score <= 1 for r in run(spark, tmp_path, documents(rows), [], "c"))
    assert all(0 <= r.score <= 1 for r in run(spark, tmp_path, documents(rows), [(k, 1, 0) for k, _ in labels], "d"))
