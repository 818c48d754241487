import zlib
from collections import Counter, defaultdict

from llm.conftest import odd_rows, prose

from ricefield.llm import sharding
from ricefield.llm.common import shared_folder


def check(rows, placed, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by = defaultdict(list)
    for r in placed:
        assert 0 <= r.shard < shards
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[s]) for s in range(shards)]


def test_shards_are_whole_and_even(documents):
    rows = [(k, prose(k, 1 + k % 60)) for k in range(2000)]
    sizes = check(rows, sharding.shard_documents(documents(rows)).collect(), 8)
    assert max(sizes) - min(sizes) <= 0.001 * sum(sizes)


def test_odd_rows(documents):
    rows = odd_rows()
    check(rows, sharding.shard_documents(documents(rows, clashing=True)).collect(), 8)
    assert sharding.shard_documents(documents([])).collect() == []


def test_rows_of_one_id_spread(documents):
    rows = [(7, prose(k, 20)) for k in range(500)] + [(None, prose(k, 20)) for k in range(500, 900)]
    sizes = check(rows, sharding.shard_documents(documents(rows)).collect(), 8)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)


def test_versions_are_edits_of_each_other(spark, documents):
    folder = shared_folder(spark, "t-map")
    rows = [(k, prose(k, 30)) for k in range(800)]
    sharding.shard_documents(documents(rows), slots=512, folder=folder).collect()
    more = rows + [(k, prose(k, 300)) for k in range(800, 900)]
    placed = sharding.shard_documents(documents(more), slots=512, folder=folder).collect()
    sizes = check(more, placed, 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes)
    versions = {v: {r.virtual_slot: r for r in sharding.load_version(spark, folder, v).collect()} for v in (0, 1, 2)}
    for old, new in ((0, 1), (1, 2)):
        for slot in range(512):
            moved = versions[new][slot].shard != versions[old][slot].shard
            assert versions[new][slot].moved == moved
    # the second edit moves few slots: those that even out the new bytes
    assert sum(r.moved for r in versions[2].values()) < 200


def test_edit_of_one_huge_slot():
    moves = sharding.edited([s % 4 for s in range(16)], {0: 1000, **{s: 1 for s in range(1, 16)}}, 4)
    shard_of = [moves.get(s, s % 4) for s in range(16)]
    assert [s for s in range(16) if shard_of[s] == shard_of[0]] == [0]
