import hashlib
import random
import re

import numpy as np
from llm.conftest import edited, odd_rows, prose

from ricefield.llm import repeated_spans as rs

N = rs.LENGTH


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - N + 1):
            s = data[k : k + N]
            if i is not None and i < first.get(s, 1 << 62):
                first[s] = i
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - N + 1):
            if i is not None and first[data[k : k + N]] < i:
                gone[k : k + N] = b"\1" * N
        left = bytes(c for c, g in zip(data, gone) if not g)
        out.append((-1 if i is None else i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def result(docs):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rs.remove_repeats(docs).collect())


def corpus():
    r = random.Random(8)
    passages = [prose(k, 12, 200) for k in range(30)]
    rows = []
    for d in range(120):
        rows.append((d * 3 % 121, " ".join(r.choice(passages) if r.random() < 0.4 else prose(r.randrange(10**6), 6, 50) for _ in range(r.randrange(9)))))
    rows += [(200 + k, edited(rows[k][1], k, 0.05)) for k in range(40)] + [(300 + k, rows[5][1]) for k in range(30)]
    rows += [(400, "a" * 500), (401, "b" + "a" * 300 + "b"), (402, "ab" * 100), (403, "é" * 70), (404, "xé" + "é" * 60)]
    return rows


def test_bytes_match_brute_force(documents):
    rows = corpus()
    assert result(documents(rows, clashing=True).repartition(7)) == brute(rows)


def test_odd_rows(documents):
    rows = odd_rows()
    rows = [(i, t[:3000] if t else t) for i, t in rows]
    assert result(documents(rows)) == brute(rows)
    assert result(documents([])) == []


def test_a_crowded_minimizer_gives_the_same(documents, monkeypatch):
    monkeypatch.setattr(rs, "CROWD", 2)
    rows = corpus()
    assert result(documents(rows)) == brute(rows)


def test_small_shards_and_units_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(rs, "SHARD_BYTES", 300)
    monkeypatch.setattr(rs, "UNIT_BYTES", 2000)
    rows = corpus()[:160]
    assert result(documents(rows)) == brute(rows)


def test_merged_shards_have_the_order_and_common_prefixes_of_one_sort():
    r = random.Random(9)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(40)]
    strings = list(dict.fromkeys(strings))
    depth, shards, rotations, at = 8, [], [], 0
    for k in range(0, len(strings), 7):
        own = [s + b"\xff" for s in strings[k : k + 7]]
        sizes = np.array([len(s) for s in own])
        shards.append(rs.shard_transform(np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes))
        rotations += [((s[i:] + s[:i]) * depth)[:depth] for s in own for i in range(len(s))]
        at += sizes.sum()
    order, group, common = rs.merged_intervals(shards, depth)
    prefixes = [rotations[i] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(at)) and prefixes == sorted(prefixes)
    for i in range(1, at):
        lcp = next((k for k in range(depth) if prefixes[i][k] != prefixes[i - 1][k]), depth)
        assert (group[i] == group[i - 1]) == (lcp == depth)
        assert common[i] == lcp


def test_blocks_beyond_the_separator_stay_together():
    own = [s + b"\xff" for s in (b"xaaaaaaaaab", b"yaaaaaaaaab", b"zaaaaaaaaac")]
    shards = [rs.shard_transform(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)])) for s in own]
    left = np.concatenate([np.arange(len(s), 0, -1) for s in own])
    order, group, _ = rs.merged_intervals(shards, 10, left)
    block = dict(zip(order.tolist(), group.tolist()))
    assert block[1] == block[13] != block[25] and block[2] == block[14] != block[26]


def test_the_piece_filter_drops_no_repeat():
    """All ways in which two fragments of a minimizer can share a string, and near misses."""
    r = random.Random(5)

    def noise(n):
        return bytes(r.randrange(97, 123) for _ in range(n))

    gram = b"abcdefghijklmnop"
    key = rs.gram_hashes(np.frombuffer(gram, np.uint8))[0]
    apart = 0
    for before in range(N - rs.GRAM + 1):
        for short in (0, 1):  # a whole string in common, or a byte less
            core = noise(before) + gram + noise(N - rs.GRAM - before - short)
            # what stands around the core differs for certain
            frags = [b"A" * r.randrange(1, 40) + core + b"B" * r.randrange(1, 40), b"C" * r.randrange(1, 40) + core + b"D" * r.randrange(1, 40), noise(30) + gram + noise(30)]
            text = np.frombuffer(b"".join(f + b"\xff" for f in frags), np.uint8)
            got = rs.may_share(text, np.array([len(f) + 1 for f in frags]), np.full(3, key).view(np.int64))
            if not short:
                assert got.tolist() == [True, True, False]
            apart += not got[0]
    assert apart  # a byte less is often seen already
    alone = np.frombuffer(noise(N) + b"\xff" + noise(N) + b"\xff", np.uint8)
    assert rs.may_share(alone, np.array([N + 1, N + 1]), np.full(2, key).view(np.int64)).all()


def test_fragments_in_blocks(monkeypatch):
    """Runs of strings with one minimizer, by their definition, whatever the block; the scan
    holds less than 24 bytes for a byte of text."""
    import tracemalloc

    r = np.random.default_rng(4)
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(rs, "BLOCK", block, raising=False)
        for alphabet in (1, 2, 20):
            ends = np.concatenate([[0], np.cumsum(r.choice([0, 1, 49, 50, 51, 60, 200], 12))]).astype(np.int64)
            data = r.integers(97, 97 + alphabet, ends[-1]).astype(np.uint8)
            grams = rs.gram_hashes(data)
            want = []
            for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                for at in range(a, b - rs.LENGTH + 1):
                    least = int(grams[at : at + rs.LENGTH - rs.GRAM + 1].min())
                    if want and want[-1][0] == d and want[-1][3] == least:
                        want[-1][2] += 1
                    else:
                        want.append([d, at, 1, least])
            assert [list(x) for x in zip(*(x.tolist() for x in rs.fragments(data, ends)))] == want
    data = r.integers(97, 123, 1_000_000).astype(np.uint8)
    tracemalloc.start()
    rs.fragments(data, np.arange(0, 1_000_001, 2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data)
