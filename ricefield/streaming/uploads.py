"""Uploads as a stream: farmer sheets dropped into a landing folder are classified and
appended micro-batch by micro-batch with the same operators as the batch upload.

The stream lists new files; each micro-batch reads its files as the batch upload does
(every file by its own header), classifies the rows against the farmer table as of the
last commit and appends the inserted rows.  The commit carries the stream's id (Spark
keeps it in the checkpoint) and the batch id, so a batch that Spark replays is recognised,
whatever was committed in between, and two streams on one table do not mix.

The season and target association come from the folder layout
``<landing>/season=<s>/association_id=<id>/*.csv``.  Files without the template's columns
and rows for an association that does not exist go to the reject folder; the rest of the
batch is committed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.operators.ingest import (
    classify_upload,
    clean_upload,
    inserted_farmers,
    read_upload,
    split_targets,
    template_gaps,
    upload_summary,
)
from ricefield.operators.ingest import headers as file_headers
from ricefield.session import checkpoint_dir
from ricefield.sinks import store
from ricefield.sinks.tables import append_rows


def upload_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Paths of the files that arrive below ``landing`` (their content is not read here).

    ``files_per_batch`` cuts a backlog into batches of that many files; the batches then
    decide which of two equal rows comes first.  By default a batch takes all new files."""
    files = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(landing).select("path")


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that Spark gave the stream of this checkpoint."""
    return json.loads(store.read_text(spark, f"{checkpoint_location.rstrip('/')}/metadata"))["id"]


def _reject(df: DataFrame, rejects_path: str, stream: str, batch_id: int, kind: str) -> None:
    df.write.mode("overwrite").parquet(f"{rejects_path}/{kind}/stream={stream}/batch_id={batch_id}")


def commit_files(
    spark: SparkSession,
    files: list[str],
    tables_root: str,
    scope,
    stream: str,
    batch_id: int,
    summaries_path: str | None = None,
    rejects_path: str | None = None,
) -> None:
    """One micro-batch: the files' rows, classified and appended in one commit."""
    if store.applied(spark, tables_root, stream, batch_id):
        return  # replay of a batch whose commit already happened
    rejects_path = rejects_path or f"{tables_root.rstrip('/')}/_rejects"
    gaps_of = {f: template_gaps(list(h), "full") for f, h in file_headers(spark, sorted(files)).items()}
    bad = [(f, "; ".join(gaps)) for f, gaps in gaps_of.items() if gaps]
    if bad:
        _reject(spark.createDataFrame(bad, "file string, missing string"), rejects_path, stream, batch_id, "files")
    good = [f for f, gaps in gaps_of.items() if not gaps]
    if not good:
        return
    raw = read_upload(spark, good, template="full")
    cleaned = clean_upload(raw, template="full", keep=["_file", "_block", "_row"])
    cleaned = cleaned.withColumn("season", F.regexp_extract("_file", "/season=([^/]*)/", 1)).withColumn(
        "association_id", F.regexp_extract("_file", "/association_id=([0-9]+)/", 1).try_cast("long")
    )
    checkpoint_dir(spark)
    cleaned = cleaned.checkpoint(eager=True)
    known, unknown = split_targets(spark, cleaned, tables_root)
    if not unknown.isEmpty():
        _reject(unknown, rejects_path, stream, batch_id, "rows")
    before = store.state(spark, tables_root)
    farmer = store.read(spark, tables_root, "farmer", before)
    classified = classify_upload(known, farmer, ["_file", "_block", "_row"], scope=scope, durable=False)
    classified = classified.checkpoint(eager=True)
    if summaries_path:  # before the commit, under the batch's name: a replay writes it again
        upload_summary(classified).write.mode("overwrite").parquet(f"{summaries_path}/stream={stream}/batch_id={batch_id}")
    append_rows(spark, "farmer", inserted_farmers(classified), tables_root, before, stream=(stream, batch_id))


def start_upload_stream(
    spark: SparkSession,
    landing: str,
    tables_root: str,
    checkpoint_location: str,
    scope="season",
    summaries_path: str | None = None,
    rejects_path: str | None = None,
    files_per_batch: int | None = None,
    available_now: bool = True,
):
    """Start the upload stream; ``available_now`` processes what is in the landing folder
    and stops (scheduled runs), otherwise it keeps running."""

    def batch(df: DataFrame, batch_id: int) -> None:
        files = [r["path"] for r in df.collect()]  # names of the batch's files
        if files:
            own = df.sparkSession
            commit_files(own, files, tables_root, scope, stream_id(own, checkpoint_location), batch_id, summaries_path, rejects_path)

    writer = upload_stream(spark, landing, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
