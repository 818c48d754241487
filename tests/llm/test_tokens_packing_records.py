import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import odd_rows, prose
from tokenizers import Tokenizer

from ricefield.llm import packing, records
from ricefield.llm import token_ids as tokens
from ricefield.llm.common import shared_folder
from ricefield.llm.token_ids import token_ids

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = st.text(st.sampled_from("abzAZé'sdtmlre09 ..,$\n\n  \t́ İ\x01\x02ß"), max_size=60)


def plain_ids(name: str, text: str | None) -> list[int]:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), ODD, st.text(max_size=30)), max_size=6))
def test_cut_texts_give_the_library_s_ids(name, texts):
    codes = token_ids(public_tokenizers.path(name))
    ids, ends = codes.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == codes.whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_units_of_earlier_batches_are_not_encoded_again(name, monkeypatch):
    codes, seen = tokens.TokenIds(public_tokenizers.path(name)), []
    units = codes._units
    monkeypatch.setattr(codes, "_units", lambda x: seen.append(len(x)) or units(x))
    for known in (tokens.KNOWN, 120, 0):  # as many as there are, some of them, none
        monkeypatch.setattr(tokens, "KNOWN", known)
        del seen[:]
        for turn in range(3):
            texts = [prose(k, 20) for k in (range(12), range(12), range(6, 18))[turn]]
            ids, ends = codes.encode(pa.array(texts))
            for k, text in enumerate(texts):
                assert ids[ends[k] : ends[k + 1]].tolist() == codes.whole.encode(text, add_special_tokens=False).ids
            assert len(codes.known[0]) <= known and len(codes.known[0]) == len(codes.known[2])
        if known == tokens.KNOWN > 120:
            assert seen[0] > 0 == seen[1]


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_fills_bins_without_overlap(lengths):
    bins, offsets = packing.best_fit(np.array(lengths, np.int64), 40)
    for b in set(bins.tolist()):
        at = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist()) if x == b)
        assert at[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(at, at[1:])) and sum(at[-1]) <= 40
    fills = [sum(n for n, x in zip(lengths, bins.tolist()) if x == b) for b in set(bins.tolist())]
    assert all(x + y > 40 for i, x in enumerate(fills) for y in fills[:i])


def check_packed(rows, packed, length):
    held = {}
    for i, t in rows:
        ids = np.array(plain_ids(FILES[0], t) + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            key = (i, piece, at, len(part), zlib.crc32(part.tobytes()))
            held[key] = held.get(key, 0) + 1
    for r in packed:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        held[key] -= 1
    assert not any(held.values())
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in by.values():
        at.sort()
        assert at[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(at, at[1:])) and sum(at[-1]) <= length
    return len(by)


def test_packing_whole_and_near_optimal(spark, documents):
    rows = odd_rows() + [(100 + k, prose(k, 5 + 7 * k % 90)) for k in range(300)]
    docs = documents(rows, clashing=True).repartition(11)
    packed = packing.pack(docs, public_tokenizers.path(FILES[0]), length=256).collect()
    n = check_packed(rows, packed, 256)
    total = sum(r.length for r in packed)
    assert n <= 1.02 * total / 256 + 2


def test_merge_rounds_join_the_partitions_last_bins(spark, documents):
    """40 partitions of one short document each fit into few sequences."""
    rows = [(k, prose(k, 10)) for k in range(40)]
    docs = documents(rows).repartition(40, "doc_id")
    packed = packing.pack(docs, public_tokenizers.path(FILES[0]), length=256, fan_in=3).collect()
    n = check_packed(rows, packed, 256)
    assert n <= sum(r.length for r in packed) / 256 + 2


def test_packing_of_an_empty_table(documents):
    assert packing.pack(documents([]), public_tokenizers.path(FILES[0])).collect() == []


def test_records_round_trip(spark, documents):
    rows = odd_rows()
    folder = shared_folder(spark, "t-records")
    manifest = records.write_records(documents(rows, clashing=True).repartition(5), folder, public_tokenizers.path(FILES[1]), file_bytes=20_000)
    got = records.read_digests(manifest, folder).collect()
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(plain_ids(FILES[1], t) + [0], "<u4").tobytes())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    at, last = 0, -1
    for r in got:
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) >= last
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    # a read in any order through the index
    f = max(manifest.collect(), key=lambda f: f.n_records)
    doc, ids = records.read_one(folder, f.path, f.n_records - 1, f.width)
    assert zlib.crc32(ids.tobytes()) in {r.ids_crc32 for r in got if r.doc_id == doc}


def test_records_encode_a_bounded_batch_at_once(tmp_path, monkeypatch):
    """A task's rows come in one Arrow batch of 12 MB; no more than 4 MB of it are encoded at once."""
    sizes = []

    class Codes:
        whole = type("Whole", (), {"get_vocab_size": lambda self: 50_000})()

        def encode(self, texts):
            sizes.append(sum(len(t) for t in texts.to_pylist()))
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)

    context = type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0), "taskAttemptId": classmethod(lambda c: 0)})
    monkeypatch.setattr(records, "token_ids", lambda path: Codes())
    monkeypatch.setattr(records, "TaskContext", context)
    batch = pa.record_batch([pa.array(range(120), pa.int64()), pa.array(["x" * 100_000] * 120)], ["doc_id", "text"])
    (rows,) = records.write_partition(f"file:{tmp_path}", "", 0, 10**9)(iter([batch]))
    assert max(sizes) <= 4_000_000 and sum(sizes) == 12_000_000
    assert rows.column("n_records").to_pylist() == [120] and rows.column("n_tokens").to_pylist() == [120]


def test_a_changed_byte_is_found():
    data = bytearray(records.frame(b"payload"))
    assert bytes(records.unframe(memoryview(bytes(data)))) == b"payload"
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Exception):
            records.unframe(memoryview(bytes(bad)))


def test_records_of_an_empty_table(spark, documents):
    folder = shared_folder(spark, "t-records")
    manifest = records.write_records(documents([]), folder, public_tokenizers.path(FILES[1]))
    assert records.read_digests(manifest, folder).collect() == []
