"""Repeated byte strings: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with
a smaller doc_id.  Copies and strings are found so:

1.  Texts that are equal as a whole form a class; the smallest doc_id stands for it, and
    the others lose all their bytes (if they have ``LENGTH``).
2.  Every string of ``LENGTH`` bytes has a minimizer, the least hash of its ``GRAM``-byte
    pieces.  Equal strings have equal minimizers.  A run of strings with the same minimizer
    is cut out as one fragment.  Fragments whose minimizer no other text has are dropped;
    that loses no repeat.
3.  Fragments with the same minimizer meet.  Equal fragments are one, held by the smallest
    doc_id.  Of the fragments of a minimizer that differ, those that have none of the
    ``PIECE``-byte pieces around the minimizer's place in common with another are dropped:
    a string of ``LENGTH`` bytes holds one of these pieces whole, so that loses no repeat
    either.  The rest is dealt to shards; each shard gets the Burrows-Wheeler transform of
    its fragments' rotations.
4.  The shards' transforms are merged by refining their interleave: an order that is right
    for the first k symbols becomes right for k + 1 by one stable pass over the transforms'
    symbols, without sorting suffixes again.  A place where neighbours part in pass k + 1 has
    a common prefix of k.  After ``LENGTH`` passes what has not parted is a repeated
    interval, whose smallest doc_id is known to all its strings.
5.  Strings that start in a smaller document are marked in every occurrence of their
    fragment, and the marked bytes leave the text.

Cases: a null or empty text has no bytes; a text shorter than ``LENGTH`` stays; rows
without doc_id neither lose bytes nor take them from others; rows with the same doc_id
don't take bytes from each other; wholly repeated rows get the same result; overlapping
strings count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import ragged_take, sized, table, written
from ricefield.llm.decontaminate import BITS, _has, _probes, bit_set
from ricefield.llm.quality import mixed

LENGTH, GRAM = 50, 16
STEP = 9  # pieces begin at the minimizer's place and every STEP bytes before it
PIECE = LENGTH - STEP + 1
SEPARATOR = 0xFF  # never part of UTF-8
SHARD_BYTES, UNIT_BYTES, CROWD = 16_000, 50_000, 5_000
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of each GRAM-byte piece."""
    with np.errstate(over="ignore"):
        h = _BYTE[data]
        step = 1
        while step < GRAM:  # hashes of 2, 4, 8, 16 bytes
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
            step *= 2
        return mixed(h)


BLOCK = 1 << 16  # strings hashed at once: what lies between two steps stays in the cache


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each start of a string of LENGTH bytes, the least hash of its GRAM-byte pieces."""
    out = np.zeros(max(0, len(data) - LENGTH + 1), np.uint64)
    for at in range(0, len(out), BLOCK):
        h = gram_hashes(data[at : at + BLOCK + LENGTH - 1])
        width, have = LENGTH - GRAM + 1, 1
        while 2 * have <= width:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        out[at : at + BLOCK] = np.minimum(h[: -(width - have)], h[width - have :]) if width > have else h
    return out


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and the texts' offsets in them."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else texts.take(pa.array(np.arange(len(texts))))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[: ends[-1]], ends


def fragments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, number of starts, minimizer) of each run of strings."""
    value = minimizers(data)
    stops = np.maximum(ends[1:] - LENGTH + 1, ends[:-1])  # starts of strings end here
    begins = np.ones(len(value), bool)
    begins[1:] = value[1:] != value[:-1]
    begins[ends[:-1][ends[:-1] < len(value)]] = True
    tails = np.minimum(ends[1:], len(value)) - np.minimum(stops, len(value))
    begins[ragged_take(np.arange(len(value)), np.minimum(stops, len(value)), tails)] = False
    first = np.flatnonzero(begins)
    owner = np.searchsorted(ends, first, side="right") - 1
    last = np.minimum(np.concatenate([first[1:], [len(value)]]), stops[owner])
    return owner, first, last - first, value[first]


def _only(bits, column: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose key may be in the bit set."""
    first, second = _probes(mixed(batch.column(column).to_numpy().view(np.uint64)))
    return batch.filter(pa.array(_has(bits.value, first) & _has(bits.value, second)))


def _bits(keys: DataFrame, column: str):
    """A broadcast bit set of fixed size; it lets through all keys and maybe others."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["hash"])

    return keys.sparkSession.sparkContext.broadcast(bit_set(keys.select(column).mapInArrow(spread, "hash long")))


def maybe_among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` (a long, never null) may be among ``keys``: a filter
    of fixed size in front of a join, so that the join need not shuffle all rows."""
    bits = _bits(keys, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _only(bits, column, batch)

    return df.mapInArrow(run, df.schema)


def _scan(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", 4_000_000):
            batch = _only(bits, "row_key", batch)
            data, ends = _texts(batch)
            owner, _, _, value = fragments(data, ends)
            ids = batch.column("doc_id").to_numpy()
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(ids[owner])], ["minimizer", "doc_id"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (minimizer, doc_id), those whose minimizer has two documents or
    more.  A group that is cut off by the partition's border, or by a very long run, counts
    as shared: that only lets more rows through."""
    keys = docs = np.zeros(0, np.int64)
    open_ = True  # the first group may have begun in the partition before

    def out(k: np.ndarray, d: np.ndarray, begin_open: bool, end_open: bool) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.concatenate([first[1:], [len(k)]])
        several = d[first] != d[last - 1]
        several[0] |= begin_open
        several[-1] |= end_open
        keep = np.repeat(several, last - first)
        keep &= np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        return pa.record_batch([pa.array(d[keep]), pa.array(k[keep])], ["doc_id", "minimizer"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("minimizer").to_numpy()])
        docs = np.concatenate([docs, batch.column("doc_id").to_numpy()])
        apart = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(apart):
            cut = int(apart[-1])
            yield out(keys[:cut], docs[:cut], open_, False)
            keys, docs, open_ = keys[cut:], docs[cut:], False
        elif len(keys) > 200_000:
            yield out(keys, docs, True, True)
            keys, docs, open_ = keys[:0], docs[:0], True
    if len(keys):
        yield out(keys, docs, open_, True)


def _binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Parts of ``data`` as a binary array, null where not valid."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    bits = np.packbits(valid, bitorder="little").tobytes()
    buffers = [pa.py_buffer(bits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(ragged_take(data, starts, lengths).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


FRAGMENT = "doc_id long, row_key long, at int, n int, minimizer long, frag_hash long, more boolean, frag binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments with shared minimizers.  Within a batch equal fragments carry their
    bytes once, at the smallest doc_id."""
    import xxhash

    for batch in sized(batches, "text", 4_000_000):
        data, ends = _texts(batch)
        owner, start, n, value = fragments(data, ends)
        wanted = batch.column("minimizers")
        offsets, flat = np.asarray(wanted.offsets, np.int64), wanted.values.to_numpy().view(np.uint64)
        borders, keep = np.searchsorted(owner, np.arange(batch.num_rows + 1)), np.zeros(len(owner), bool)
        for d in range(batch.num_rows):
            a, b = borders[d], borders[d + 1]
            if b > a:
                keep[a:b] = np.isin(value[a:b], flat[offsets[d] : offsets[d + 1]])
        owner, start, n, value = owner[keep], start[keep], n[keep], value[keep]
        if not len(owner):
            continue
        whole = memoryview(data)
        places = zip(start.tolist(), (start + n + LENGTH - 1).tolist())
        code = np.array([xxhash.xxh3_64_intdigest(whole[x:y]) for x, y in places], np.uint64).view(np.int64)
        ids = batch.column("doc_id").to_numpy()[owner]
        order = np.lexsort((ids, code))
        first = np.zeros(len(order), bool)
        sorted_h, sorted_d = code[order], ids[order]
        begins = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
        first[order] = begins
        at = np.flatnonzero(begins)
        several = sorted_d[at] != sorted_d[np.concatenate([at[1:], [len(order)]]) - 1]
        more = np.zeros(len(order), bool)
        more[order] = np.repeat(several, np.diff(np.concatenate([at, [len(order)]])))
        yield pa.record_batch(
            [
                pa.array(ids), batch.column("row_key").take(pa.array(owner)), pa.array((start - ends[owner]).astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(code), pa.array(more),
                _binary(data, start, np.where(first, n + LENGTH - 1, 0), first),
            ],
            ["doc_id", "row_key", "at", "n", "minimizer", "frag_hash", "more", "frag"],
        )


def shard_transform(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all rotations of a shard's strings (each ends with the separator), the
    symbols before them, and for each the rank of the rotation that begins one earlier."""
    n = len(text)
    after = np.arange(1, n + 1)
    after[begins + sizes - 1] = begins
    before = np.arange(-1, n - 1)
    before[begins] = begins + sizes - 1
    key, jump = np.zeros(n, np.uint64), np.arange(n)
    for _ in range(8):  # the first eight symbols, then twice as many each round
        key = key << np.uint64(8) | text[jump].astype(np.uint64)
        jump = after[jump]
    reach, longest = 8, int(sizes.max())
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1 or reach > longest:
            break
        key = rank << np.uint64(32) | rank[jump]
        jump, reach = jump[jump], 2 * reach
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, text[before[order]], place[before[order]]


def merged_intervals(
    shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, left: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shard transforms: (rotations in merged order, as numbers over all shards one
    after another; the interval of equal ``depth``-symbol prefixes that each lies in, by its
    first place; the common prefix of each with the one before, ``depth`` where it is that
    long).  ``left``: symbols up to the separator in each rotation, beyond which its order
    does not matter.

    While many places have not parted, a pass goes over all symbols.  Later passes visit only
    blocks whose next symbols' blocks changed in the pass before; no other block can part."""
    firsts = np.cumsum([0, *(len(s[0]) for s in shards)])
    rotation = np.concatenate([s[0] + f for s, f in zip(shards, firsts)])
    symbol = np.concatenate([s[1] for s in shards])
    earlier = np.concatenate([s[2] + f for s, f in zip(shards, firsts)])
    n = len(rotation)
    merged, block, common = np.arange(n), np.zeros(n, np.int64), np.full(n, depth, np.int16)
    parted, k = np.zeros(n, bool), 0
    while k < depth and 2 * np.count_nonzero(parted) < n:
        c = symbol[merged]
        order = np.argsort(c, kind="stable")
        merged, c, block = earlier[merged[order]], c[order], block[order]
        now = np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])])
        common[now & ~parted] = k
        parted, k = now, k + 1
        block = np.maximum.accumulate(np.where(now, np.arange(n), 0))
    of = np.empty(n, np.int64)  # the block of each rotation, in the shards' numbering
    of[merged] = block
    later = np.empty(n, np.int64)
    later[earlier] = np.arange(n)
    reach = np.full(n, depth) if left is None else left[rotation]
    starts, size = np.flatnonzero(parted), np.zeros(n, np.int64)
    size[starts] = np.diff(np.concatenate([starts, [n]]))
    todo = starts[size[starts] > 1]
    for k in range(k, depth):
        if not len(todo):
            break
        places = np.repeat(todo - (np.cumsum(size[todo]) - size[todo]), size[todo]) + np.arange(size[todo].sum())
        own = merged[places]
        inside = reach[own] > k  # alike for all of a block
        places, own = places[inside], own[inside]
        within, following = of[own], of[later[own]]
        parting = np.zeros(n, bool)
        parting[within[1:][(within[1:] == within[:-1]) & (following[1:] != following[:-1])]] = True
        pick = parting[within]
        places, own, within, following = places[pick], own[pick], within[pick], following[pick]
        if not len(places):
            break  # what has not parted now will not part
        order = np.lexsort((following, within))
        own, within, following = own[order], within[order], following[order]
        fresh = np.concatenate([[True], (within[1:] != within[:-1]) | (following[1:] != following[:-1])])
        inner = fresh & np.concatenate([[False], within[1:] == within[:-1]])
        common[places[inner]] = k
        first = np.flatnonzero(fresh)
        size[places[first]] = np.diff(np.concatenate([first, [len(places)]]))
        merged[places], of[own] = own, np.repeat(places[first], size[places[first]])
        moved = own[of[own] != within]
        todo = np.unique(of[earlier[moved]])  # blocks before a changed one may part next
        todo = todo[size[todo] > 1]
    return rotation[merged], of[merged], common


def repeated(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which strings of the fragments also start in a fragment of a smaller document.

    ``text``: the fragments one after another, a separator after each; ``sizes``: their
    lengths with it; ``docs``: the smallest document of each.  Marks by place in ``text``."""
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff(ends // SHARD_BYTES)) + 1
    shards, begin_at = [], 0
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        own = sizes[a:b]
        part = text[begin_at : begin_at + own.sum()]
        shards.append(shard_transform(part, np.cumsum(own) - own, own))
        begin_at += own.sum()
    left = np.repeat(ends, sizes) - np.arange(len(text))  # symbols up to the separator, with it
    rotation, block, _ = merged_intervals(shards, LENGTH, left)
    whole = left > LENGTH  # a full string starts here
    doc = np.where(whole, np.repeat(docs, sizes), np.iinfo(np.int64).max)[rotation]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.concatenate([first, [len(text)]])))
    hit = np.zeros(len(text), bool)
    hit[rotation] = least < doc
    return hit & whole


def may_share(text: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which fragments may have a string in common with another one of their key.

    ``text``, ``sizes``: as for ``repeated``; ``key``: the minimizer of each.  A fragment
    without its minimizer (a string dealt out alone) may always."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.flatnonzero(gram_hashes(text) == key.view(np.uint64)[owner[: len(text) - GRAM + 1]])
    out = np.ones(len(sizes), bool)
    out[owner[places]] = False
    weights = mixed(np.arange(1, PIECE + 1, dtype=np.uint64)) | np.uint64(1)
    codes, owners = [], []
    with np.errstate(over="ignore"):
        for k in range((LENGTH - GRAM) // STEP + 1):
            at = places - k * STEP
            of = owner[places]
            inside = (at >= (ends - sizes)[of]) & (at + PIECE < ends[of])
            at, of = at[inside], of[inside]
            code = key.view(np.uint64)[of] + np.uint64(k)
            for j in range(PIECE):
                code += _BYTE[text[at + j]] * weights[j]
            codes.append(mixed(code))
            owners.append(of)
    code, of = np.concatenate(codes), np.concatenate(owners)
    if len(code):
        order = np.argsort(code)
        code, of = code[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        several = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
        out[of[np.repeat(several, np.diff(np.concatenate([first, [len(code)]])))]] = True
    return out


def _units(key: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Parts of about ``most`` bytes, cut between keys."""
    total, at = np.cumsum(sizes), 0
    while at < len(key):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1
        while stop < len(key) and key[stop] == key[stop - 1]:
            stop += 1
        yield slice(at, stop)
        at = stop


RESULT = "frag_hash long, base int, width int, first_doc long, runs array<int>"
KEYS = ("key", "frag_hash", "base", "doc_id", "more")


def _bytes(frags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fragments one after another with separators, their lengths with these)."""
    frags = pa.concat_arrays([frags.cast(pa.large_binary()), pa.array([], pa.large_binary())])
    ends = np.frombuffer(frags.buffers()[1], np.int64)[frags.offset : frags.offset + len(frags) + 1]
    data = np.frombuffer(frags.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    out = np.full(len(data) + len(frags), SEPARATOR, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(frags)), sizes)] = data
    return out, sizes + 1


def _merged_keys(table: pa.Table) -> pa.RecordBatch:
    """The rows of whole keys, sorted by (key, frag_hash, base, doc_id): equal fragments
    become one; the fragments of a key that differ go through the merge."""
    key, code, base, doc, more = (table.column(c).to_numpy() for c in KEYS)
    other = (key[1:] != key[:-1]) | (code[1:] != code[:-1]) | (base[1:] != base[:-1])
    first = np.flatnonzero(np.concatenate([[True], other]))
    last = np.concatenate([first[1:], [len(key)]]) - 1
    held = np.logical_or.reduceat(more, first) | (doc[first] != doc[last])  # others have it too
    key, doc = key[first], doc[first]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([begins, [len(key)]]))
    several = np.flatnonzero(np.repeat(count > 1, count))
    frags = table.column("frag").cast(pa.large_binary()).combine_chunks()
    sizes = pc.binary_length(frags).to_numpy(zero_copy_only=False)[first]
    near = np.zeros(len(several), bool)
    for part in _units(key[several], sizes[several], 10 * UNIT_BYTES):
        near[part] = may_share(*_bytes(frags.take(pa.array(first[several[part]]))), key[several[part]])
    several = several[near]
    runs: dict[int, list[int]] = {}
    for part in _units(key[several], sizes[several], UNIT_BYTES):
        own = several[part]
        text, lengths = _bytes(frags.take(pa.array(first[own])))
        places = np.flatnonzero(np.diff(np.concatenate([[False], repeated(text, lengths, doc[own]), [False]]).astype(np.int8)))
        ends = np.cumsum(lengths)
        which = np.searchsorted(ends, places, side="right")  # a run ends before its separator
        for w, p in zip(which.tolist(), (places - (ends - lengths)[which]).tolist()):
            runs.setdefault(int(own[w]), []).append(p)
    keep = held.copy()
    keep[list(runs)] = True
    kept = np.flatnonzero(keep)
    return pa.record_batch(
        [
            pa.array(code[first][kept]), pa.array(base[first][kept]), pa.array((sizes[kept] - LENGTH + 1).astype(np.int32)),
            pa.array(doc[kept]), pa.array([runs.get(i, []) for i in kept.tolist()], pa.list_(pa.int32())),
        ],
        ["frag_hash", "base", "width", "first_doc", "runs"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, some millions of bytes at a time; the rows of the last key wait for more."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.nbytes
        key = batch.column("key").to_numpy()
        if held < 4_000_000 or waiting[0].column("key")[0].as_py() == key[-1]:
            continue
        table = pa.Table.from_batches(waiting)
        key = table.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield _merged_keys(table.slice(0, cut))
        waiting = table.slice(cut).to_batches()
        held = sum(b.nbytes for b in waiting)
    if waiting:
        yield _merged_keys(pa.Table.from_batches(waiting))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, "text", 8_000_000):
        data, ends = _texts(batch)
        spans = batch.column("spans").flatten()
        per_text = pc.list_value_length(batch.column("spans")).to_numpy(zero_copy_only=False)
        runs = spans.field("runs")
        per_span = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
        base = np.repeat(ends[:-1], per_text) + spans.field("at").to_numpy()
        places = runs.flatten().to_numpy() + np.repeat(base, per_span)
        edge = np.bincount(places[::2], minlength=len(data) + 1) - np.bincount(places[1::2] + LENGTH - 1, minlength=len(data) + 1)
        gone = np.cumsum(edge[: len(data)]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = ends[:-1][ends[:-1] < len(data)]
        begins[inner] = gone[inner]  # a run ends with its text
        n_spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[ends])
        left = data[~gone].tobytes()
        at = ends - total[ends]
        shas = [hashlib.sha256(left[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch(
            [batch.column("row_key"), pa.array(np.diff(total[ends])), pa.array(n_spans), pa.array(shas, pa.string())],
            ["row_key", "n_removed", "n_spans", "kept_sha256"],
        )


def marked_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with row_key, one digest row for each row, runs of marked strings by row_key)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    digest = written(
        texts.select("doc_id", "row_key", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "span-digests"
    )
    # the smallest doc_id stands for all equal texts
    reps = digest.where(f"doc_id is not null and n_bytes >= {LENGTH}").groupBy("sha").agg(F.min(F.struct("doc_id", "row_key")).alias("r"))
    reps = written(reps.select("sha", F.col("r.doc_id").alias("first_doc"), F.col("r.row_key").alias("first_key")), "span-classes")
    bits = _bits(reps, "first_key")
    scan = texts.where("doc_id is not null").mapInArrow(_scan(bits), "minimizer long, doc_id long")
    scan = scan.repartitionByRange("minimizer", "doc_id").sortWithinPartitions("minimizer", "doc_id")
    wanted = scan.mapInArrow(_shared, "doc_id long, minimizer long").groupBy("doc_id").agg(F.collect_list("minimizer").alias("minimizers"))
    wanted = wanted.join(reps.select(F.col("first_doc").alias("doc_id"), "first_key"), "doc_id").select(F.col("first_key").alias("row_key"), "minimizers")
    frags = written(texts.join(wanted, "row_key").dropDuplicates(["row_key"]).select("doc_id", "row_key", "text", "minimizers").mapInArrow(_cut, FRAGMENT), "fragments")
    own = frags.where("frag is not null").select(
        F.col("minimizer").alias("key"), "frag_hash", F.lit(0).alias("base"), "doc_id", "more", "frag"
    )
    # a minimizer with very many different fragments: its strings are dealt out one by one,
    # by their first half
    crowded = written(own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("key"), "crowded-minimizers")
    if not crowded.isEmpty():
        single = own.join(crowded, "key", "left_semi").withColumn("base", F.explode(F.sequence(F.lit(0), F.length("frag") - LENGTH)))
        single = single.withColumn("frag", F.expr(f"substring(frag, base + 1, {LENGTH})"))
        single = single.withColumn("key", F.xxhash64("key", F.expr("substring(frag, 1, 25)")))
        own = own.join(crowded, "key", "left_anti").unionByName(single.select(*own.columns))
    dealt = own.repartition("key").sortWithinPartitions("key", "frag_hash", "base", "doc_id")
    marks = written(dealt.mapInArrow(_merge, RESULT), "marked-strings")
    places = frags.select("row_key", "doc_id", "at", "frag_hash").join(marks, "frag_hash")
    # a fragment's strings are marked in all documents but its smallest, there as found
    runs = F.when(F.col("doc_id") > F.col("first_doc"), F.array(F.lit(0), F.col("width"))).otherwise(F.col("runs"))
    spans = places.select("row_key", (F.col("at") + F.col("base")).alias("at"), runs.alias("runs")).where(F.size("runs") > 0)
    return texts, digest, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, digest, spans = marked_runs(docs)
    reps = digest.where(f"doc_id is not null and n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("doc_id").alias("first_doc"))
    # one document's runs: at most as many as it has bytes
    spans = written(spans.groupBy("row_key").agg(F.collect_list(F.struct("at", "runs")).alias("spans")), "spans")
    few = maybe_among(texts.select("row_key", "text"), spans, "row_key").dropDuplicates(["row_key"])
    cut = few.join(spans, "row_key").mapInArrow(_remove, "row_key long, n_removed long, n_spans long, kept_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    rows = digest.join(reps, "sha", "left").join(cut, "row_key", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op10_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that a smaller document has."""
    return remove_repeats(table(spark, sf_dir, "documents"))
