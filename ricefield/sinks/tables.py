"""Whole-table jobs: export, replace-import, snapshots, copy between stores.

Every job that changes a store writes new data folders, checks what was written and then
publishes all tables of the job in one commit (``sinks.store``), so a failed job changes
nothing and a reader never sees half of one.  Paths are Hadoop paths (HDFS, S3A, ABFS,
file:).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StringType, StructField, StructType

from ricefield.session import checkpoint_dir, stored
from ricefield.sinks import store
from ricefield.sinks.store import exists as path_exists
from ricefield.sinks.store import fs_path as _fs
from ricefield.sources.model import SCHEMAS, TABLE_ORDER, Tables, conform, read_tables, table_path, write_table

# Fixed value: time zone of snapshot names.
SNAPSHOT_TZ = "Asia/Manila"


def work_dir(spark: SparkSession) -> str:
    """A fresh folder inside the shared checkpoint location (for jobs and tests that need
    scratch tables)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ricefield-work-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ commits


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per (table_name, season)."""
    parts = [
        df.groupBy("season").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "season", "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


class WrittenRowsDiffer(RuntimeError):
    """What was read back is not what was written, or not what an export's manifest names."""


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(f"rows-{uuid.uuid4().hex[:8]}")
    return conform(df, name).observe(seen, *store.digest_columns(name)), seen


def _total(seen: Observation) -> tuple[int, int, int]:
    got = seen.get
    return tuple(int(got[k] or 0) for k in ("rows", "sum1", "sum2"))


def write_staged(
    spark: SparkSession,
    tables: Tables | dict[str, DataFrame],
    dest_root: str,
    verify: bool = True,
    stream: tuple[str, int] | None = None,
    before: dict | None = None,
    seasons: list[str] | None = None,
    expected: dict[str, list] | None = None,
) -> DataFrame:
    """Write every table to a new data folder of the store (parents first), check the rows
    read back against the rows that the write saw (their number and an order-free checksum
    of all columns, and against ``expected`` totals where given), then publish all tables in
    one commit.  ``seasons`` writes and replaces only these seasons; the files of the others
    stay.  ``stream`` (id, batch) is recorded with the commit.

    ``before`` is the state that the tables were computed from (known for ``Tables`` from
    ``read_tables`` of this store): if the store has changed since, the commit is refused
    with ``ConcurrentCommit``.  Without it the tables stand for themselves, as in an import.
    Returns rows per (table_name, season) as written."""
    if before is None and isinstance(tables, Tables) and tables.read_at and tables.read_at["store"] == dest_root.rstrip("/"):
        before = tables.read_at
    before = before or store.state(spark, dest_root)
    items = dict(tables.items()) if isinstance(tables, Tables) else dict(tables)
    if seasons is not None:
        items = {name: df.where(F.col("season").isin(seasons)) for name, df in items.items()}
    folders, seen = {}, {}
    try:
        for name in [n for n in TABLE_ORDER if n in items]:
            observed, seen[name] = _observed(items[name], name)
            folders[name] = store.add_folder(observed, dest_root, name)
        written = {n: store.read(spark, dest_root, n, {"tables": {n: [e]}}) for n, e in folders.items()}
        digests = {n: store.digest(df, n) for n, df in written.items()}
        if verify:
            for name in folders:
                got, want = store.digest_total(digests[name]), _total(seen[name])
                if got != want:
                    raise WrittenRowsDiffer(f"{name}: {want[0]} rows written, {got[0]} read back, or their content differs; nothing was replaced")
                if expected and tuple(int(x) for x in expected[name]) != got:
                    raise WrittenRowsDiffer(f"{name}: the rows are not those that the manifest names; nothing was replaced")
        store.commit(spark, dest_root, before, replace=folders, stream=stream, seasons=seasons, digests=digests)
    except Exception:
        for name, entry in folders.items():
            store.delete(spark, f"{table_path(dest_root, name)}/{entry}")
        raise
    store.vacuum(spark, dest_root)
    result = [(name, season, d[0]) for name, by in digests.items() for season, d in by.items()]
    return spark.createDataFrame(result, "table_name string, season string, rows long")


# Outcomes after which a table differs.
EFFECTS = ("inserted", "updated", "renamed", "deleted")


def commit_change(spark: SparkSession, dest_root: str, change, retries: int = 3) -> DataFrame:
    """Read the tables as of one commit, let ``change(tables)`` give the changed tables (name
    -> DataFrame) and an outcome per request (with season and status), and commit them.

    Only the seasons that have an effective outcome are read in full, written and replaced;
    the files of other seasons stay as they are, and without an effect nothing is written.
    If another writer commits meanwhile, the change is computed again from the new tables."""
    for attempt in range(retries + 1):
        tables = read_tables(spark, dest_root)
        changed, outcome = change(tables)
        outcome = stored(outcome, "outcome")  # told as of the tables that it was decided on
        hit = outcome.where(F.col("status").isin(*EFFECTS)).select("season").distinct()
        seasons = sorted(r["season"] for r in hit.collect())  # a handful of labels
        if not seasons:
            return outcome
        try:
            write_staged(spark, changed, dest_root, before=tables.read_at, seasons=seasons)
            return outcome
        except store.ConcurrentCommit:
            if attempt == retries:
                raise
    raise AssertionError("unreachable")


def verify_store(spark: SparkSession, root: str) -> list[str]:
    """Tables and seasons whose rows are no longer those that their commit recorded (appended
    seasons have no record)."""
    at, wrong = store.state(spark, root), []
    for name, by in at["digests"].items():
        now = store.digest(store.read(spark, root, name, at), name)
        wrong += [f"{name} {season}" for season, d in by.items() if now.get(season) != d]
    return sorted(wrong)


def append_rows(
    spark: SparkSession, table: str, rows: DataFrame, dest_root: str, before: dict, stream: tuple[str, int] | None = None
) -> None:
    """Add rows to a table in one commit on top of ``before``; only new files are written."""
    entry = store.add_folder(rows, dest_root, table)
    try:
        store.commit(spark, dest_root, before, append={table: entry}, stream=stream)
    except Exception:
        store.delete(spark, f"{table_path(dest_root, table)}/{entry}")
        raise


# ------------------------------------------------------------------ export / import


# Fixed value: NULL marker of the CSV database export, so NULL and '' both survive.
CSV_NULL = "\\N"


def _escape(df: DataFrame, undo: bool = False) -> DataFrame:
    """Line breaks in CSV cells as ``\\n`` and ``\\r`` (and ``\\`` doubled), so that a record
    is one line and files can be split; ``undo`` reads them back."""
    def cell(name: str):
        c = F.col(name)
        if not undo:
            c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
            return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))

        def piece(x):  # between doubled backslashes
            return F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

        return F.array_join(F.transform(F.split(c, r"\\\\", -1), piece), "\\")

    return df.select(*[cell(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields])


def csv_writer(writer):
    """CSV with header that keeps cell text exactly (no trimming) and marks NULLs."""
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", CSV_NULL)
    )


def csv_reader(reader):
    return reader.option("header", True).option("escape", '"').option("nullValue", CSV_NULL)


EXPORT_MANIFEST = "_manifest.json"


def export_tables(tables: Tables, out_root: str, fmt: str = "parquet") -> None:
    """Whole-database export: one folder per table (parquet partitioned by season, or CSV
    with header), and a manifest with rows and checksums of each, written last: an export
    with a manifest is complete."""
    spark, out_root, totals = tables.farmer.sparkSession if tables.farmer is not None else tables.association.sparkSession, out_root.rstrip("/"), {}
    store.delete(spark, f"{out_root}/{EXPORT_MANIFEST}")  # an export written over is not the old one
    for name in TABLE_ORDER:
        df = getattr(tables, name)
        if df is None:
            continue
        df, totals[name] = _observed(df, name)
        if fmt == "parquet":
            write_table(df, out_root, name)
        elif fmt == "csv":
            csv_writer(_escape(df).write.mode("overwrite")).csv(table_path(out_root, name))
        else:
            raise ValueError(f"unknown export format {fmt!r}")
    manifest = {"format": fmt, "tables": {name: [str(x) for x in _total(seen)] for name, seen in totals.items()}}
    store.create_text(spark, f"{out_root}/{EXPORT_MANIFEST}", json.dumps(manifest))


def export_manifest(spark: SparkSession, root: str) -> dict | None:
    """What a complete export holds; None without a manifest."""
    path = f"{root.rstrip('/')}/{EXPORT_MANIFEST}"
    return json.loads(store.read_text(spark, path)) if path_exists(spark, path) else None


class ImportError_(ValueError):
    pass


def read_export(spark: SparkSession, root: str, fmt: str = "parquet", tables: list[str] = TABLE_ORDER) -> dict[str, DataFrame]:
    """Read one folder per table with the declared schema; every table must be present and
    carry every declared column (checked before any data job runs)."""
    out, problems = {}, []
    for name in tables:
        path = table_path(root, name)
        if not path_exists(spark, path):
            problems.append(f"{name}: missing")
            continue
        if fmt == "parquet":
            try:
                df = spark.read.parquet(path)
            except AnalysisException:  # a folder without data files: an empty table
                df = spark.read.schema(SCHEMAS[name]).parquet(path)
        elif fmt == "csv":
            df = _escape(csv_reader(spark.read).csv(path), undo=True)
        else:
            raise ValueError(f"unknown import format {fmt!r}")
        missing = [f.name for f in SCHEMAS[name].fields if f.name not in df.columns]
        if missing:
            problems.append(f"{name}: missing columns {missing}")
            continue
        out[name] = conform(df, name)
    if problems:
        raise ImportError_("import rejected, nothing replaced: " + "; ".join(problems))
    return out


def import_replace(
    spark: SparkSession, src_root: str, dest_root: str, fmt: str = "parquet", tables: list[str] = TABLE_ORDER, complete: bool = False
) -> DataFrame:
    """Replace the named tables at ``dest_root`` with the export at ``src_root`` (all of them
    validated first, declared schema kept).  An export without varieties is imported by
    naming the other three tables.  Where the export has a manifest, rows that are not those
    it names are refused; ``complete`` also refuses an export without one."""
    rows, manifest = read_export(spark, src_root, fmt, tables), export_manifest(spark, src_root)
    if manifest is None and complete:
        raise ImportError_("import rejected, nothing replaced: the export has no manifest")
    lost = [n for n in tables if manifest and n not in manifest["tables"]]
    if lost:
        raise ImportError_("import rejected, nothing replaced: the manifest does not name " + ", ".join(lost))
    return write_staged(spark, rows, dest_root, expected=manifest and manifest["tables"])


# ------------------------------------------------------------------ snapshots


def snapshot_name(at) -> Column:
    """Snapshot name of a moment: its date and time in the snapshot time zone, whatever
    the session's."""
    return F.date_format(F.convert_timezone(None, F.lit(SNAPSHOT_TZ), at), "yyyyMMdd_HHmmss")


def snapshot_id(spark: SparkSession) -> str:
    """Snapshot name of the current time."""
    return spark.range(1).select(snapshot_name(F.current_timestamp()).alias("ts")).first()["ts"]


def _manifest(snap_root: str, ts: str) -> str:
    return f"{snap_root.rstrip('/')}/_snapshots/{ts}.json"


def _complete(spark: SparkSession, snap_root: str) -> list[str]:
    """Ids of the snapshots that were finished."""
    folder = f"{snap_root.rstrip('/')}/_snapshots"
    if not path_exists(spark, folder):
        return []
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))


def snapshot(spark: SparkSession, tables_root: str, snap_root: str, ts: str | None = None, copy: bool = True) -> str:
    """Keep every table as of one commit; a manifest written last makes the snapshot
    complete.  Returns the snapshot id.

    ``copy`` writes the rows under ``snap_root/<table>/ts=<ts>/``, apart from the store.
    Without it no row is written: the manifest names the commit's data folders, which never
    change, and a pin in the store keeps ``vacuum`` from them (``drop_snapshot`` ends it)."""
    ts = ts or snapshot_id(spark)
    at, names = store.state(spark, tables_root), []
    about = {"tables": [n for n in TABLE_ORDER if store.has_table(spark, tables_root, n)]}
    if not copy:
        own = {n: at["tables"].get(n, [store.PLAIN]) for n in about["tables"]}
        own = {n: [e for x in entries for e in store.season_entries(spark, tables_root, n, x)] for n, entries in own.items()}
        store.pin(spark, tables_root, f"snapshot-{ts}", own)
        store.create_text(spark, _manifest(snap_root, ts), json.dumps(about | {"store": tables_root.rstrip("/"), "folders": own, "digests": at["digests"]}))
        return ts
    for name in about["tables"]:
        store.read(spark, tables_root, name, at).write.mode("overwrite").partitionBy("season").parquet(f"{table_path(snap_root, name)}/ts={ts}")
        names.append(name)
    store.create_text(spark, _manifest(snap_root, ts), json.dumps(about))
    return ts


def _pinned(spark: SparkSession, snap_root: str, done: list[str]) -> dict[str, dict]:
    """The manifests of the snapshots that only pin folders."""
    all_ = {ts: json.loads(store.read_text(spark, _manifest(snap_root, ts))) for ts in done}
    return {ts: m for ts, m in all_.items() if "store" in m}


def drop_snapshot(spark: SparkSession, snap_root: str, ts: str) -> None:
    """Forget a snapshot: its manifest first, then its rows or its pin."""
    about = json.loads(store.read_text(spark, _manifest(snap_root, ts)))
    store.delete(spark, _manifest(snap_root, ts))
    if "store" in about:
        store.unpin(spark, about["store"], f"snapshot-{ts}")
    else:
        for name in about["tables"]:
            store.delete(spark, f"{table_path(snap_root, name)}/ts={ts}")


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def list_snapshots(spark: SparkSession, snap_root: str) -> DataFrame:
    """Complete snapshots newest first with row counts and stored size per table:
    ts, table_name, rows, bytes (the size is file-system metadata, one call per
    snapshot folder)."""
    done = _complete(spark, snap_root)
    parts, sizes = [], []
    for ts, about in _pinned(spark, snap_root, done).items():
        for name, entries in about["folders"].items():
            # rows as recorded with the commit; a season without a record (appended) is counted
            known, seasons = about["digests"].get(name, {}), {store.season_of(e) for e in entries}
            if seasons <= set(known):
                rows = spark.createDataFrame([(ts, sum(known[s][0] for s in seasons))], "ts string, rows long") if seasons else None
            else:
                rows = store.read(spark, about["store"], name, {"tables": {name: entries}}).agg(F.lit(ts).alias("ts"), F.count(F.lit(1)).alias("rows"))
            if rows is not None:
                parts.append(rows.withColumn("table_name", F.lit(name)))
            sizes.append((ts, name, sum(_bytes(spark, f"{table_path(about['store'], name)}/{e}") for e in entries)))
    for name in TABLE_ORDER:
        path = table_path(snap_root, name)
        if path_exists(spark, path):
            schema = StructType(SCHEMAS[name].fields + [StructField("ts", StringType())])
            df = spark.read.schema(schema).option("basePath", path).parquet(path)
            per_ts = df.where(F.col("ts").isin(done)).groupBy("ts").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
            parts.append(per_ts)
    if not parts:
        return spark.createDataFrame([], "ts string, table_name string, rows long, bytes long")
    listing = reduce(DataFrame.unionByName, parts).select("ts", "table_name", "rows")
    for name in TABLE_ORDER:
        path = table_path(snap_root, name)
        if path_exists(spark, path):
            fs, p = _fs(spark, path)
            for st in fs.listStatus(p):
                folder = st.getPath().getName()
                if st.isDirectory() and folder.startswith("ts="):
                    sizes.append((folder[3:], name, _bytes(spark, st.getPath().toString())))
    size_df = spark.createDataFrame(sizes, "ts string, table_name string, bytes long")
    return listing.join(size_df, ["ts", "table_name"], "left").orderBy(F.desc("ts"), "table_name")


def restore(spark: SparkSession, snap_root: str, ts: str, dest_root: str) -> DataFrame:
    """Replace the tables at ``dest_root`` with snapshot ``ts``; a snapshot that is not
    complete, or lacks a table that its manifest names, is refused whole."""
    if ts not in _complete(spark, snap_root):
        raise FileNotFoundError(f"no complete snapshot {ts!r} under {snap_root}")
    about = json.loads(store.read_text(spark, _manifest(snap_root, ts)))
    names = about["tables"]
    if "store" in about:
        return _restore_pinned(spark, about, ts, dest_root)
    paths = {name: f"{table_path(snap_root, name)}/ts={ts}" for name in names}
    lost = [name for name, path in paths.items() if not path_exists(spark, path)]
    if lost:
        raise FileNotFoundError(f"snapshot {ts!r} lacks {lost}; nothing was restored")
    tables = {name: conform(spark.read.schema(SCHEMAS[name]).parquet(path), name) for name, path in paths.items()}
    return write_staged(spark, tables, dest_root)


def _restore_pinned(spark: SparkSession, about: dict, ts: str, dest_root: str) -> DataFrame:
    """In its own store a pinned snapshot is published again as it lies, without writing a
    row; elsewhere its rows are copied."""
    own, folders = about["store"], about["folders"]
    lost = [f"{n}/{e}" for n, entries in folders.items() for e in entries if not path_exists(spark, f"{table_path(own, n)}/{e}")]
    if lost:
        raise FileNotFoundError(f"snapshot {ts!r} lacks {lost}; nothing was restored")
    if dest_root.rstrip("/") != own:
        return write_staged(spark, {n: store.read(spark, own, n, {"tables": {n: e}}) for n, e in folders.items()}, dest_root)
    before = store.state(spark, own)
    store.publish(spark, own, before, {**before["tables"], **folders}, {**before["digests"], **{n: about["digests"].get(n, {}) for n in folders}})
    return counts({n: store.read(spark, own, n) for n in folders})


# ------------------------------------------------------------------ copy between stores


def copy_tables(spark: SparkSession, src_root: str, dest_root: str, src_fmt: str = "store") -> DataFrame:
    """Copy all tables from one store (or export, by its format) to another, ids kept; all
    or nothing, with a row count check per table.  Returns (table_name, season, rows)."""
    if src_fmt != "store":
        return write_staged(spark, read_export(spark, src_root, src_fmt), dest_root)
    at = store.state(spark, src_root)
    lost = [n for n in TABLE_ORDER if not store.has_table(spark, src_root, n)]
    if lost:
        raise ImportError_("copy rejected, nothing replaced: missing " + ", ".join(lost))
    return write_staged(spark, {n: store.read(spark, src_root, n, at) for n in TABLE_ORDER}, dest_root)
