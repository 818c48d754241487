import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import edited, odd_rows, prose

from ricefield.llm import lsh_forest
from ricefield.llm.components import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, similar=80):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    have = defaultdict(list)
    flat = [(i, s) for i, own in sets.items() for s in own]
    for k, (_, s) in enumerate(flat):
        for x in s:
            have[x].append(k)
    for k, (i, s) in enumerate(flat):
        for other, n in Counter(o for x in s for o in have[x] if o < k).items():
            j, t = flat[other]
            if 100 * n >= similar * (len(s) + len(t) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def family(start, base, n, share):
    return [(start + k, edited(base, start + k, share)) for k in range(n)]


def test_components_match_brute_force(documents):
    rows = [(k, prose(k, 20 + 3 * k)) for k in range(60)]
    rows += [(100 + k, edited(prose(k, 20 + 3 * k), k, 0.02 * (k % 4))) for k in range(60)]
    rows += family(200, prose(900, 160), 60, 0.02) + family(300, prose(901, 90), 40, 0.04) + [(400 + k, prose(902, 300)) for k in range(50)]
    got = lsh_forest.near_duplicates(documents(rows, clashing=True), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 4)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, 4)) for i, t in rows}


def test_one_of_each_group_stays(documents):
    rows = odd_rows() + family(100, prose(50, 120), 20, 0.01)
    docs = documents(rows, clashing=True)
    left = lsh_forest.keep_one(docs)
    assert left.schema == docs.schema
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in left.collect())
    want = brute(rows, 5)
    once = [i for i in want if want[i] == i]
    assert ids == sorted([-1] * 4 + once)


def test_odd_rows(documents):
    rows = odd_rows()
    got = lsh_forest.near_duplicates(documents(rows), 4).collect()
    assert len(got) == len(rows)
    want = brute(rows, 4)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert lsh_forest.near_duplicates(documents([])).collect() == []


def test_texts_of_one_id_are_kept_apart(documents):
    a, b, c = prose(71, 80), prose(72, 80), prose(73, 80)
    docs = documents([(1, a), (2, b), (2, a), (3, c), (4, b), (4, b + " end"), (5, b)])
    got = {(r.doc_id, r.component_id) for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 1)}
    assert sorted((r.doc_id, r.text) for r in lsh_forest.keep_one(docs).collect()) == sorted([(1, a), (2, b), (3, c)])


def crowd_with_twins(n, twins, words, own, lone):
    """``n`` texts of ``words`` words that share all but ``own`` of them; the first ``2 * twins``
    go in pairs that share all but ``lone``."""
    base = prose(500, words - own)
    tail = [prose(10_000 + k, own, 10**9) for k in range(n)]
    for k in range(twins):
        tail[2 * k + 1] = " ".join([*tail[2 * k].split()[: own - lone], *tail[2 * k + 1].split()[own - lone :]])
    return [(k, f"{base} {t}") for k, t in enumerate(tail)]


@pytest.mark.parametrize("n", [300, 2000])
def test_isolated_links_in_a_crowd_are_found(documents, n):
    rows = crowd_with_twins(n, 100, 204, 25, 20)  # sets of 200: crowd 175 / 225, pairs 180 / 220
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(documents(rows)).collect()}
    assert got == {k: k - k % 2 if k < 200 else k for k in range(n)}


def test_crowd_pairs_lose_no_link(spark):
    r = np.random.default_rng(8)
    sets = []
    for k in range(120):
        base = np.arange(40 * (k % 3), 40 * (k % 3) + r.integers(30, 90))
        sets.append(np.unique(np.concatenate([base[r.random(len(base)) > 0.06], r.integers(1000, 1200, r.integers(0, 9))])).astype(np.int64))
    crowd = spark.createDataFrame([(k, k // 4, s.tobytes()) for k, s in enumerate(sets)], "node long, comp long, shingles binary")
    for similar in (80, 65, 100):
        got = {(x.a, x.b) for x in lsh_forest.crowd_pairs(crowd, similar).collect()}
        want = {
            (a, b)
            for a, x in enumerate(map(set, sets)) for b, y in enumerate(map(set, sets))
            if a < b and a // 4 != b // 4 and 100 * len(x & y) >= similar * len(x | y)
        }
        assert want <= got and (want or similar == 100)
        assert all(a // 4 != b // 4 for a, b in got)


def test_border_and_crowded_rows_are_marked():
    lead = np.zeros((60, lsh_forest.PREFIX), ">u4")
    lead[:, 0] = [0] * 3 + [1] * 5 + [2] * 40 + [3] * 6 + [4] * 6
    batch = pa.record_batch(
        [pa.array(np.zeros(60, np.int32)), pa.array([x.tobytes() for x in lead], pa.binary()), pa.array(np.arange(60))], ["tree", "lead", "node"]
    )
    out = pa.Table.from_batches(list(lsh_forest._neighbours(iter([batch.slice(0, 20), batch.slice(20)])))).to_pylist()
    assert {x["a"] for x in out if x["a"] == x["b"]} == {*range(3), *range(8, 48), *range(54, 60)}


def test_texts_are_sketched_a_bounded_part_at_once(monkeypatch):
    seen, sets = [], lsh_forest.shingle_sets
    monkeypatch.setattr(lsh_forest, "shingle_sets", lambda texts, width: seen.append(texts.nbytes) or sets(texts, width))
    texts = [prose(k, 4000) for k in range(120)]
    rows = [list(range(120)), [b"x"] * 120, texts]
    batch = pa.record_batch([pa.array(x) for x in rows], ["doc_id", "text_key", "text"])
    out = list(lsh_forest._sketch(4)(iter([batch])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == rows[0]
    batch = pa.record_batch([pa.array(rows[0]), pa.array(texts)], ["node", "text"])
    assert [i for b in lsh_forest._set_column(4)(iter([batch])) for i in b.column("node").to_pylist()] == rows[0]
    assert sum(map(len, texts)) > 2_000_000 and max(seen) < 1_100_000


def test_sets_are_exact():
    texts = ["A b c d e A b c d", "a B c", "", None, "x", " a\tb\x0bc d "]
    flat, ends = lsh_forest.shingle_sets(pa.array(texts), 4)
    assert np.diff(ends).tolist() == [len(shingles(t, 4)) for t in texts]
    same = [set(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    assert same[5] <= same[0] and not same[1] & same[0]


def test_region_pairs_adapt_to_the_crowd():
    n = 100
    shared = np.full(n - 1, lsh_forest.LEAST)  # one crowded region
    shared[40:44] = 12  # and a small one, deeper
    a, b = lsh_forest.region_pairs(shared, n)
    pairs = set(zip(a.tolist(), b.tolist()))
    assert {(i, j) for i in range(40, 45) for j in range(i + 1, 45)} <= pairs
    assert len(pairs) < n * (lsh_forest.STEPS + 1)
    shared = np.zeros(9, int)
    shared[2:6] = lsh_forest.LEAST
    a, b = lsh_forest.region_pairs(shared, 10)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(2, 7) for j in range(i + 1, 7)}


def test_components(spark):
    import random

    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.id: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_agreement_of_rare_true_links_is_enough():
    """Signatures of a pair of similarity 0.8 agree in 54 of 96 values now and then."""
    r = np.random.default_rng(3)
    a = r.integers(0, 2**32, lsh_forest.K, dtype=np.uint32)
    b = np.where(np.arange(lsh_forest.K) < 54, a, a ^ np.uint32(1))
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b", "sa", "sb"])
    (got,) = lsh_forest._agreement(iter([batch]))
    assert got.to_pylist() == [{"a": 1, "b": 2, "agree": 54}]
