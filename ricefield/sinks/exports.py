"""Farmer exports: the 23-column upload template and the 10-column short list.

The reference exports one association per request; here one job exports every
association at once, one CSV folder per association (``partitionBy``), rows in
last-name, first-name order.  Query-friendly column names are used in the
DataFrames; the display headers are applied by the writers.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricefield.functions.exprs import slug
from ricefield.operators.ranking import sequence_number
from ricefield.session import conf_set, workers_find_package
from ricefield.sinks import store

# Template export headers in order, with the farmer field written under
# each ('' = always blank).  area and variety appear twice, as in the reference.
TEMPLATE_EXPORT = [
    ("FFRS RSBSA Number", "rsbsa"),
    ("Farmer Last Name", "last_name"),
    ("Farmer First Name", "first_name"),
    ("Farmer Middle Name", "middle_name"),
    ("Farmer Ext Name", "suffix"),
    ("Farm Address (Province)", ""),
    ("Farm Address (Municipality)", ""),
    ("Seed Variety Claimed", "variety"),
    ("Claimed Area (ha)", "area"),
    ("Claimed seeds (kg)", ""),
    ("Lot Series", ""),
    ("Sex", ""),
    ("Birthdate", ""),
    ("Contact Number", ""),
    ("Crop Establishment", ""),
    ("Eco-System", ""),
    ("Eco-System Source", ""),
    ("Date of Sowing", ""),
    ("Average Weight per Bag (kg) - for all variety(ies)", "kg"),
    ("Total Production (no. of bags) - for all variety(ies)", "sacks"),
    ("Average Area Harvested (ha)", "area"),
    ("Seed Variety Planted", "variety"),
    ("Seed Class (Hybrid, Inbred, etc.)", ""),
]

# Short export headers in order with their farmer field.
SHORT_EXPORT = [
    ("ID", "id"),
    ("RSBSA", "rsbsa"),
    ("Last Name", "last_name"),
    ("First Name", "first_name"),
    ("Middle Name", "middle_name"),
    ("Suffix", "suffix"),
    ("Area (ha)", "area"),
    ("Variety", "variety"),
    ("Sacks", "sacks"),
    ("Kilograms", "kg"),
]


def column_name(header: str) -> str:
    """Query-friendly name for a display header: lower case, runs of other
    characters as '_'."""
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


# List order inside an association: last name, first name (NULLs first), id.
LIST_ORDER = ["_last", "_first", "_id"]


def _list_keys(farmer: DataFrame) -> list:
    return [F.col("last_name").alias("_last"), F.col("first_name").alias("_first"), F.col("id").alias("_id")]


def _ordered(f: DataFrame, with_pos: bool) -> DataFrame:
    if not with_pos:
        return f
    order = [F.asc_nulls_first("_last"), F.asc_nulls_first("_first"), "_id"]
    return sequence_number(f, order, partition_by=["season", "association_id"])


def template_rows(farmer: DataFrame, with_pos: bool = True) -> DataFrame:
    """Template export rows of every association: season, association_id, [pos], the
    list-order keys (_last, _first, _id), then the 23 template columns (blank ones as '').
    ``with_pos=False`` skips the position column (the writer sorts by the keys)."""
    cols = [
        (F.col(field) if field else F.lit("")).alias(column_name(header)) for header, field in TEMPLATE_EXPORT
    ]
    f = _ordered(farmer.select("season", "association_id", *_list_keys(farmer), *cols), with_pos)
    pos = ["pos"] if with_pos else []
    return f.select("season", "association_id", *pos, *LIST_ORDER, *[column_name(h) for h, _ in TEMPLATE_EXPORT])


def short_rows(farmer: DataFrame, association: DataFrame, with_pos: bool = True) -> DataFrame:
    """Short export rows of every association with farmers, plus ``file_stem`` =
    '<association name lower, spaces as _>_<season>_farmers' ('association' when the
    association row is missing).  Associations without farmers export nothing."""
    a = association.select(F.col("season").alias("a_season"), F.col("id").alias("a_id"), F.col("name").alias("a_name"))
    f = farmer.join(a, (farmer.season == a.a_season) & (farmer.association_id == a.a_id), "left")
    stem = F.concat(F.coalesce(slug("a_name"), F.lit("association")), F.lit("_"), F.col("season"), F.lit("_farmers"))
    cols = [F.col(field).alias(column_name(header)) for header, field in SHORT_EXPORT]
    f = _ordered(f.select("season", "association_id", stem.alias("file_stem"), *_list_keys(f), *cols), with_pos)
    pos = ["pos"] if with_pos else []
    return f.select("season", "association_id", "file_stem", *pos, *LIST_ORDER, *[column_name(h) for h, _ in SHORT_EXPORT])


def _display(df: DataFrame, spec) -> DataFrame:
    keep = [c for c in df.columns if c not in {column_name(h) for h, _ in spec}]
    return df.select(*keep, *[F.col(column_name(h)).alias(h) for h, _ in spec])


# An export has a file for each association.  The tasks put their files in place, not the
# driver one after the other (``_SUCCESS`` tells a complete export).  On a local disk Hadoop
# starts a process for each file (to set its mode), so there the tasks write and read the
# files themselves; lines are made and parsed by Spark's CSV functions as everywhere.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
# Folders are listed by so many tasks, not by one task each.
LISTING_TASKS = 64
CSV = {"header": "true", "escape": '"'}
AS_IS = {**CSV, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
READ_BYTES, WRITE_CHARS = 1_000_000, 1_000_000  # of lines handed on and written at once


def _sort_keys():
    return [F.asc_nulls_first("_last"), F.asc_nulls_first("_first"), F.asc("_id")]


def _local(spark, path: str) -> str | None:
    """The path on the local disk, if that is where it lies."""
    fs, p = store.fs_path(spark, path)
    uri = str(fs.makeQualified(p).toUri())
    return unquote(urlparse(uri).path) if urlparse(uri).scheme == "file" else None


# What Spark escapes in the name of a folder, and the folder of NULL and ''.
ESCAPED = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(column: str, value) -> str:
    """``column=value`` as Spark names it."""
    text = "" if value is None else str(value)
    return f"{column}=" + ("".join(ESCAPED.get(c, c) for c in text) or NO_VALUE)


def folder_value(name: str) -> str | None:
    """The value in a folder's name."""
    text = name.split("=", 1)[1]
    return None if text == NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def _made(folder: str) -> None:
    try:
        os.mkdir(folder)
    except FileExistsError:
        pass
    except FileNotFoundError:
        _made(os.path.dirname(folder))
        _made(folder)


def _put(top: str, folders: list[str], header: str, job: str):
    """Write sorted rows (folder columns, line) into one file a folder and task.  A file
    appears whole, under a name that a second attempt of the task uses again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.c000.csv"
        now, file, at, n, held, size = None, None, None, 0, [], 0

        def flush():
            left = memoryview("".join(held).encode())
            while left:
                left = left[os.write(file, left) :]
            held.clear()

        def close():
            if file is not None:
                flush()
                os.close(file)
                os.replace(f"{at}/_{name}.{task.taskAttemptId()}", f"{at}/{name}")

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*folders, "line")]
            for *key, line in zip(*columns):
                if key != now:
                    close()
                    now, at, size = key, "/".join([top, *map(folder_name, folders, key)]), 0
                    _made(at)
                    file = os.open(f"{at}/_{name}.{task.taskAttemptId()}", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o666)
                    held.append(header)
                    n += 1
                held += (line, "\n")
                size += len(line)
                if size > WRITE_CHARS:
                    flush()
                    size = 0
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return run


def _write(rows: DataFrame, spec, folders: list[str], path: str, mode: str) -> None:
    out = _display(rows, spec)
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, folders), *_sort_keys()]
    dealt = out.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("pos", *LIST_ORDER)
    top = _local(spark, path) if mode in ("overwrite", "append") else None
    if top is None or spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() != "static":
        dealt.write.mode(mode).partitionBy(*folders).options(**MANY_FILES).options(**AS_IS).csv(path)
        return
    if mode == "overwrite":
        store.delete(spark, path)
    workers_find_package(spark)
    names = [h for h, _ in spec]

    def line(cells):
        return F.coalesce(F.to_csv(F.struct(*[c.alias(h) for c, h in zip(cells, names)]), AS_IS), F.lit(""))

    header = spark.range(1).select(line([F.lit(h) for h in names]).alias("line")).first()["line"] + "\n"
    lines = dealt.select(*folders, line([F.col(f"`{h}`") for h in names]).alias("line"))
    lines.mapInArrow(_put(top, folders, header, str(uuid.uuid4())), "n long").collect()  # a row a task
    os.makedirs(top, exist_ok=True)
    with open(f"{top}/_SUCCESS", "w"):
        pass


def write_template_export(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one folder per (season, association_id), rows in list order.

    ``rows`` from ``template_rows(..., with_pos=False)``.  Range partitioning on
    (season, association_id, list order) keeps each file an ordered, contiguous slice
    and splits a very large association over several tasks/files (part numbers follow
    list order)."""
    _write(rows, TEMPLATE_EXPORT, ["season", "association_id"], path, mode)


def write_short_export(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one folder per association, rows in list order (see above):
    ``season=<s>/association_id=<id>/file_stem=<name>``.  Associations that share a name
    have folders of their own."""
    _write(rows, SHORT_EXPORT, ["season", "association_id", "file_stem"], path, mode)


def _folders(top: str, depth: int, deal: int, task: int, tasks: int) -> Iterator[tuple[list[str], str]]:
    """(names, path) of the folders ``depth`` levels down; those ``deal`` levels down are dealt
    out to tasks by their names."""

    def walk(at: str, names: list[str]) -> Iterator[tuple[list[str], str]]:
        if len(names) == depth:
            yield names, at
            return
        with os.scandir(at) as entries:
            for e in entries:
                own = [*names, e.name]
                if "=" in e.name and e.name[0] not in "._" and (len(own) != deal or zlib.crc32("/".join(own).encode("utf-8", "surrogateescape")) % tasks == task):
                    yield from walk(e.path, own)

    return walk(top, [])


def _get(top: str, folders: list[str], tasks: int):
    """(folder columns, line) of the files below the folders dealt to each task, without headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(values, counts, lines):
            columns = [pa.array([v[i] for v, n in zip(values, counts) for _ in range(n)], pa.string()) for i in range(len(folders))]
            return pa.record_batch([*columns, pa.array(lines, pa.string())], [*folders, "line"])

        for task in (t for b in batches for t in b.column(0).to_pylist()):
            values, counts, lines, held = [], [], [], 0
            for names, at in _folders(top, len(folders), min(2, len(folders)), task, tasks):
                for name in sorted(os.listdir(at)):
                    if name[0] in "._":
                        continue
                    with open(f"{at}/{name}", encoding="utf-8", newline=None) as file:  # lines end as for Spark's reader
                        text = file.read()
                    own = [x for x in text.split("\n") if x.strip(WHITE)][1:]
                    values.append([folder_value(x) for x in names])
                    counts.append(len(own))
                    lines += own
                    held += len(text)
                    if held > READ_BYTES:
                        yield batch(values, counts, lines)
                        values, counts, lines, held = [], [], [], 0
            yield batch(values, counts, lines)

    return run


WHITE = "".join(map(chr, range(33)))  # a line of nothing else is no row


def read_written(spark, path: str, spec, folders: str) -> DataFrame:
    """The rows of a written export, under query-friendly names (all cells as text);
    ``folders``: the schema of its folder levels."""
    schema = ", ".join(f"`{h}` string" for h, _ in spec)
    levels = [c.split() for c in folders.split(", ")]
    top = _local(spark, path)
    if top is None:
        with conf_set(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS)):
            out = spark.read.schema(f"{schema}, {folders}").options(**CSV).csv(path)
        return out.select(*[c for c, _ in levels], *[F.col(f"`{h}`").alias(column_name(h)) for h, _ in spec])
    workers_find_package(spark)
    names = [c for c, _ in levels]
    lines = spark.range(0, LISTING_TASKS, 1, LISTING_TASKS).mapInArrow(
        _get(top, names, LISTING_TASKS), ", ".join(f"{c} string" for c in [*names, "line"])
    )
    out = lines.select(*[F.col(c).cast(t).alias(c) for c, t in levels], F.from_csv("line", schema, {"escape": '"'}).alias("cells"))
    return out.select(*names, *[F.col("cells").getField(h).alias(column_name(h)) for h, _ in spec])
