"""Token ids in length-delimited binary records, with a separate offset index.

A data file is a run of frames; a frame is

    uint64 length of the payload, uint32 masked CRC-32 of these eight bytes,
    payload, uint32 masked CRC-32 of the payload

(all little-endian; the mask turns the checksum right by 15 bits and adds a constant, so
that checksums of data that hold checksums stay apart).  A payload is the document's id
(int64, and one byte that is 0 when there is none) and its ids, in 2 bytes each when the
vocabulary allows it and 4 otherwise.  The index beside a data file has two uint64 for
each record, offset and length of its frame, so a reader can visit records in any order.

Documents are dealt out by ranges of doc_id, each range is encoded, framed and written by
one task, and a manifest names the files of the attempts that succeeded.  A document lies
after all documents with smaller ids; rows without an id come first; equal ids follow in
the order of the table.

Cases: a null or empty text is its end id alone; an empty table writes nothing and reads
back as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ricefield.llm.common import released, shared_folder, sized, table, written
from ricefield.llm.token_ids import token_ids

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
FILE_BYTES = 256_000_000
BATCH = 4_000_000  # bytes of text encoded at once
# Fixed values of the frame format: the mask of a checksum, and a frame's fixed parts.
MASK = 0xA282EAD8
HEAD, FOOT, WHO = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")

MANIFEST = "part int, file_no int, path string, n_records long, n_tokens long, n_bytes long, width int"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder as Spark names it (file:/x, hdfs://..., s3://...)."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, FOOT.pack(masked(size)), payload, FOOT.pack(masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of a frame; an error if either checksum differs."""
    size, crc = HEAD.unpack_from(data)
    payload = data[HEAD.size : HEAD.size + size]
    if masked(bytes(data[:8])) != crc or FOOT.unpack_from(data, HEAD.size + size)[0] != masked(payload):
        raise ValueError("checksum of a record does not match")
    return payload


class Writer:
    """One data file and its index."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.path, self.at, self.records, self.tokens = path, 0, 0, 0
        self.data, self.index = store.open_output_stream(path), store.open_output_stream(f"{path}.index")

    def add(self, doc_id: int | None, ids: np.ndarray, width: int) -> None:
        out = frame(WHO.pack(doc_id or 0, doc_id is not None) + ids.astype(f"<u{width}").tobytes())
        self.data.write(out)
        self.index.write(struct.pack("<QQ", self.at, len(out)))
        self.at, self.records, self.tokens = self.at + len(out), self.records + 1, self.tokens + len(ids)

    def close(self) -> None:
        self.data.close()
        self.index.close()


def write_partition(folder: str, vocabulary: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, context = token_ids(vocabulary), TaskContext.get()
        width = 2 if codes.whole.get_vocab_size() <= 65536 else 4
        (store, root), files, out = file_system(folder), [], None
        for batch in released(sized(batches, "text", BATCH)):
            ids, ends = codes.encode(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                if out is None or out.at >= file_bytes:
                    if out:
                        out.close()
                    # the attempt is part of the name: one that fails leaves no half of another's file
                    name = f"part-{context.partitionId():06d}-{len(files):04d}-{context.taskAttemptId()}.records"
                    files.append(out := Writer(store, f"{root}/{name}"))
                out.add(doc, np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)), width)
        if out:
            out.close()
        rows = [(context.partitionId(), n, f.path.rsplit("/", 1)[-1], f.records, f.tokens, f.at, width) for n, f in enumerate(files)]
        names = ["part", "file_no", "path", "n_records", "n_tokens", "n_bytes", "width"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return run


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write all documents in order of doc_id; returns the manifest, one row per file,
    with ``first_token``: the number of tokens in the files before it."""
    spark = docs.sparkSession
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    # the row number of the scan tells equal ids apart, so a range can end between them
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    manifest = written(dealt.mapInArrow(write_partition(folder, vocabulary, end_id, file_bytes), MANIFEST), "records-manifest")
    earlier = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("long"))


def payload_ids(payload: memoryview, width: int) -> tuple[int | None, np.ndarray]:
    doc, known = WHO.unpack_from(payload)
    return (doc if known else None), np.frombuffer(payload, f"<u{width}", offset=WHO.size).astype("<u4")


def read_one(folder: str, path: str, n: int, width: int) -> tuple[int | None, np.ndarray]:
    """Record ``n`` of a file, found through the index: for reads in shuffled order."""
    store, root = file_system(folder)
    with store.open_input_file(f"{root}/{path}.index") as index:
        offset, length = struct.unpack("<QQ", index.read_at(16, 16 * n))
    with store.open_input_file(f"{root}/{path}") as data:
        return payload_ids(unframe(memoryview(data.read_at(length, offset))), width)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_partition(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with store.open_input_file(f"{root}/{f['path']}.index") as index:
                    places = np.frombuffer(index.read(), "<u8").reshape(-1, 2)
                start, rows = f["first_token"], []
                with store.open_input_stream(f"{root}/{f['path']}", buffer_size=1 << 20) as data:
                    for _, length in places.tolist():
                        doc, ids = payload_ids(unframe(memoryview(data.read(length))), f["width"])
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                if len(rows) != f["n_records"] or start - f["first_token"] != f["n_tokens"]:
                    raise ValueError(f"{f['path']} does not hold what the manifest says")
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the files: its document, place in the token stream and checksum."""
    files = manifest.select("path", "n_records", "n_tokens", "width", "first_token")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read_partition(folder), DIGEST)


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as records, then read the files back."""
    import public_tokenizers

    folder = shared_folder(spark, "token-records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return read_digests(manifest, folder)
