"""Bulk farmer upload: clean, classify (insert / duplicate / skipped), assign ids.

Rules (per uploaded row, in file order):

1. text cells are stripped; a row with blank last *and* first name is skipped;
2. area, bags and kg-per-bag are numbers or 0.0 (junk such as '1,200', 'x', '12d' -> 0);
3. variety = claimed, else planted, else '';
4. key = lower(stripped RSBSA).  A blank key is always inserted.  A non-blank key is a
   duplicate if it exists in the target table within the dedupe scope
   (``'season'``: the whole season; ``'association'``: the target association), or if
   an earlier non-skipped row of the upload has it in the same scope.

Plan: the table's keys are first cut to those in the upload (semi join against the
distinct upload keys); one aggregate over those and the
upload's keys gives, per (scope, key), "exists" and the first file position; map-side
partial aggregation means a hot key never gathers its rows in one task.  Upload rows with a key are then joined to
that aggregate (AQE splits a skewed join partition); blank-key rows bypass the join.
New ids continue each season's maximum in file order (``sequence_number``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ricefield.functions.exprs import number_or_zero, py_key, sql_key, text_or_blank
from ricefield.operators.ranking import sequence_number
from ricefield.session import checkpoint_dir
from ricefield.sources.model import FARMER, conform

# The 23 headers of the upload template (compared after strip + lower).
REQUIRED_COLUMNS = [
    "ffrs rsbsa number",
    "farmer last name",
    "farmer first name",
    "farmer middle name",
    "farmer ext name",
    "farm address (province)",
    "farm address (municipality)",
    "seed variety claimed",
    "claimed area (ha)",
    "claimed seeds (kg)",
    "lot series",
    "sex",
    "birthdate",
    "contact number",
    "crop establishment",
    "eco-system",
    "eco-system source",
    "date of sowing",
    "average weight per bag (kg) - for all variety(ies)",
    "total production (no. of bags) - for all variety(ies)",
    "average area harvested (ha)",
    "seed variety planted",
    "seed class (hybrid, inbred, etc.)",
]

# Template header -> model field, for the columns the upload reads.
TEMPLATE_FIELDS = {
    "rsbsa": "ffrs rsbsa number",
    "last_name": "farmer last name",
    "first_name": "farmer first name",
    "middle_name": "farmer middle name",
    "suffix": "farmer ext name",
    "claimed": "seed variety claimed",
    "planted": "seed variety planted",
    "area": "claimed area (ha)",
    "kg": "average weight per bag (kg) - for all variety(ies)",
    "sacks": "total production (no. of bags) - for all variety(ies)",
}

# The short (legacy) upload headers; alternatives in preference order.
SHORT_FIELDS = {
    "rsbsa": ["rsbsa"],
    "last_name": ["last name", "lastname"],
    "first_name": ["first name", "firstname"],
    "middle_name": ["middle name"],
    "suffix": ["suffix"],
    "claimed": ["variety"],
    "planted": [],
    "area": ["area"],
    "kg": ["kg"],
    "sacks": ["sacks"],
}
SHORT_REQUIRED = [["last name", "lastname"], ["first name", "firstname"]]

STATUS_INSERTED = "inserted"
STATUS_DUPLICATE = "duplicate"
STATUS_SKIPPED = "skipped"


class UploadTemplateError(ValueError):
    def __init__(self, missing: list[str], file: str | None = None):
        self.missing, self.file = missing, file
        super().__init__((f"{file}: " if file else "") + "Invalid upload template. Missing columns: " + ", ".join(missing))


class UploadRefused(ValueError):
    """An upload that names associations which do not exist.  ``targets``: all unknown
    (season, association_id), as a DataFrame."""

    def __init__(self, targets: DataFrame):
        self.targets = targets
        super().__init__("upload refused, nothing written: unknown (season, association_id), see targets")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def template_gaps(columns: list[str], template: str) -> list[str]:
    """Headers (stripped, lower case) that a template demands and ``columns`` lacks."""
    if template == "full":
        return [c for c in REQUIRED_COLUMNS if c not in columns]
    if template == "short":
        return [" | ".join(alts) for alts in SHORT_REQUIRED if not any(a in columns for a in alts)]
    raise ValueError(f"unknown template {template!r}")


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Raise ``UploadTemplateError`` naming every missing header (before any job runs)."""
    missing = missing_columns(df, required)
    if missing:
        raise UploadTemplateError(missing)
    return df


def _cell(df: DataFrame, names: list[str]):
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`").cast("string")
    return F.lit(None).cast("string")


def clean_upload(df: DataFrame, template: str = "full", keep: list[str] = ()) -> DataFrame:
    """Header check and typed projection of raw upload cells (all strings).

    Output: ``keep`` columns, rsbsa, last_name, first_name, middle_name, suffix, area,
    variety, sacks, kg, key (lower stripped RSBSA), skipped (bool).
    """
    df = normalize_headers(df)
    keep = [k.strip().lower() for k in keep]
    missing = template_gaps(df.columns, template)
    if missing:
        raise UploadTemplateError(missing)
    fields = {k: [v] for k, v in TEMPLATE_FIELDS.items()} if template == "full" else SHORT_FIELDS
    # the read cells under fixed names, then one typed projection over them
    cells = df.select(
        *[F.col(f"`{k}`").alias(k) for k in keep], *[_cell(df, v).alias(f"_cell_{k}") for k, v in fields.items()]
    )
    typed = cells.select(
        *keep,
        *[text_or_blank(f"_cell_{k}").alias(k) for k in ("rsbsa", "last_name", "first_name", "middle_name", "suffix", "claimed", "planted")],
        *[number_or_zero(f"_cell_{k}").alias(k) for k in ("area", "sacks", "kg")],
    )
    claimed, planted = F.col("claimed"), F.col("planted")
    return typed.select(
        *keep,
        "rsbsa",
        "last_name",
        "first_name",
        "middle_name",
        "suffix",
        "area",
        F.when(claimed != "", claimed).when(planted != "", planted).otherwise(F.lit("")).alias("variety"),
        "sacks",
        "kg",
        py_key("rsbsa").alias("key"),
        ((F.col("last_name") == "") & (F.col("first_name") == "")).alias("skipped"),
    )


def _csv_files(spark: SparkSession, path: str) -> list[str]:
    """The data files at ``path`` (a file, or all files below a folder; names that begin
    with '.' or '_' are not data)."""
    from ricefield.sinks.store import fs_path

    fs, p = fs_path(spark, path)
    found = fs.listFiles(p, True)
    root, out = fs.makeQualified(p).toString(), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if not any(part.startswith((".", "_")) for part in name[len(root) :].split("/")):
            out.append(name)
    return sorted(out)


def _split_header(record: str) -> tuple[str, ...]:
    import csv
    import io

    return tuple(c.strip().lower() for c in next(csv.reader(io.StringIO(record.removeprefix("\ufeff"))), []))


DRIVER_OPENS = 32  # the first records of more files than this are read by tasks


def headers(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, ...]]:
    """The headers of CSV files, in the order of ``files``.

    Many files are read as lines in a job, which takes the first line of each (a partial
    aggregate, so one row a file is shuffled) and groups the files by it: the driver opens
    only files without a line or with a line break inside a quoted header.
    """
    from urllib.parse import unquote

    def name(path: str) -> str:
        return re.sub("^(file:)?/+", "/", path)

    found = {}
    if len(files) > DRIVER_OPENS:
        lines = spark.read.text(files).select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
            "value",
        )
        first = lines.groupBy("file").agg(F.min_by("value", "place").alias("record"))
        for record, own in first.groupBy("record").agg(F.collect_list("file")).collect():  # one row a header
            if record.count('"') % 2 == 0:
                found |= dict.fromkeys((name(unquote(f)) for f in own), _split_header(record))
    return {f: found[name(f)] if name(f) in found else _header(spark, f) for f in files}


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The headers of one CSV file, stripped and lower-cased (its first record only)."""
    from ricefield.sinks.store import fs_path

    fs, p = fs_path(spark, file)
    codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(fs.getConf())
    codec, raw = codecs.getCodec(p), fs.open(p)
    stream = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8")
    )
    try:
        line = stream.readLine() or ""
        while line.count('"') % 2:  # a line break inside a quoted header
            more = stream.readLine()
            if more is None:
                break
            line += "\n" + more
    finally:
        stream.close()
    return _split_header(line)


def read_upload(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    preferred: str | None = "NRP DISTRIBUTION",
    multiline: bool = False,
    template: str | None = None,
) -> DataFrame:
    """Read upload files (a file, a folder of files or a list of files) as all-string cells,
    adding the file-order columns ``_file``, ``_block``, ``_row``.

    ``preferred`` names a sub-folder to use when present (the workbook's preferred sheet),
    else the path itself is read.  Each CSV file is read by its own header: files may have
    their columns in any order, and with ``template`` every file's header is checked (the
    first file that lacks a column is named).  CSV follows the usual spreadsheet dialect
    (quoted cells, a doubled quote inside quotes); ``multiline=True`` allows line breaks
    inside quoted cells, at the price of reading each file in one task.
    """
    target = path
    if preferred and isinstance(path, str):
        from ricefield.sinks.store import fs_path

        fs, hpath = fs_path(spark, f"{path.rstrip('/')}/{preferred}")
        if fs.exists(hpath):
            target = hpath.toString()
    order = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]
    if fmt == "parquet":
        raw = spark.read.parquet(*([target] if isinstance(target, str) else target))
        columns = [c.strip().lower() for c in raw.columns]
        if template and template_gaps(columns, template):
            raise UploadTemplateError(template_gaps(columns, template))
        return raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns], *order)
    if fmt != "csv":
        raise ValueError(f"unknown upload format {fmt!r}")
    by_header: dict[tuple[str, ...], list[str]] = {}
    found = headers(spark, _csv_files(spark, target) if isinstance(target, str) else target)
    for file, header in found.items():
        if template and template_gaps(list(header), template):
            raise UploadTemplateError(template_gaps(list(header), template), file)
        by_header.setdefault(header, []).append(file)
    if not by_header:
        raise FileNotFoundError(f"no upload files at {target}")
    parts = []
    for header, files in by_header.items():  # one plan for each distinct header
        # a repeated or empty header gets a name of its own; the first of equal names counts
        names = [c if c and c not in header[:i] else f"_column_{i}" for i, c in enumerate(header)]
        schema = StructType([StructField(c, StringType()) for c in names])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        raw = reader.option("escape", '"').option("multiLine", multiline).csv(files)
        parts.append(raw.select(*[F.col(f"`{c}`") for c in names if not c.startswith("_column_")], *order))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _scope_col(scope: str | dict[str, str], season_col: str = "season", assoc_col: str = "association_id"):
    """Dedupe scope key next to (season, key): the association id for seasons deduped per
    association, NULL for seasons deduped over the whole season."""
    scopes = {"*": scope} if isinstance(scope, str) else dict(scope)
    for v in scopes.values():
        if v not in ("season", "association"):
            raise ValueError(f"unknown dedupe scope {v!r}")
    default = scopes.pop("*", "season")
    assoc_seasons = [s for s, v in scopes.items() if v == "association"]
    season_seasons = [s for s, v in scopes.items() if v == "season"]
    null = F.lit(None).cast("long")
    if default == "association":
        cond = ~F.col(season_col).isin(season_seasons) if season_seasons else F.lit(True)
    else:
        cond = F.col(season_col).isin(assoc_seasons) if assoc_seasons else F.lit(False)
    return F.when(cond, F.col(assoc_col).cast("long")).otherwise(null)


def classify_upload(
    rows: DataFrame,
    existing: DataFrame,
    order: list[str],
    scope: str | dict[str, str] = "season",
    durable: bool = True,
    ids: bool = True,
) -> DataFrame:
    """Classify cleaned upload rows (``clean_upload`` output plus ``season`` and
    ``association_id``) against the ``existing`` farmer table.

    ``scope`` is 'season', 'association', or a dict season -> scope.  Returns the rows
    with ``status`` and, for inserted rows, the new ``id``.  ``order`` columns give file
    order and must be unique per season.  ``durable`` checkpoints the cleaned rows first
    (reliable checkpoint in ``spark.checkpoint.dir``): needed when the order columns are
    generated row numbers (file reads), so they survive executor loss, and cheaper in
    general since the upload is read by several steps.  ``ids=False`` leaves out the new
    ids (their numbering sorts the inserted rows), for callers that only count.
    """
    if durable:
        checkpoint_dir(rows.sparkSession)
        rows = rows.checkpoint(eager=True)
    # a single order column is compared as is (hash aggregation); several as a struct
    ord_struct = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    ord_type = rows.select(ord_struct.alias("o")).schema["o"].dataType
    rows = rows.withColumn("_scope", _scope_col(scope))
    keyed = rows.where(~F.col("skipped") & (F.col("key") != ""))
    ex_keys = (
        existing.select("season", _scope_col(scope).alias("_scope"), sql_key("rsbsa").alias("key"))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
    )
    # Only existing keys that occur in the upload matter: a semi join cuts the table's keys
    # to them (Spark broadcasts the upload's keys when their size in bytes allows it), and
    # the aggregate below shuffles the matches only.
    upload_keys = keyed.select("season", "key").distinct()
    ex_keys = ex_keys.join(upload_keys, ["season", "key"], "left_semi").select(
        "season", "_scope", "key", F.lit(1).alias("exists"), F.lit(None).cast(ord_type).alias("_ord")
    )
    up_keys = keyed.select("season", "_scope", "key", F.lit(0).alias("exists"), ord_struct.alias("_ord"))
    per_key = (
        ex_keys.unionByName(up_keys)
        .groupBy("season", "_scope", "key")
        .agg(F.max("exists").alias("_exists"), F.min("_ord").alias("_first"))
        .withColumnRenamed("season", "_pk_season")
        .withColumnRenamed("_scope", "_pk_scope")
        .withColumnRenamed("key", "_pk_key")
    )
    cond = (
        (keyed.season == per_key._pk_season)
        & keyed._scope.eqNullSafe(per_key._pk_scope)
        & (keyed.key == per_key._pk_key)
    )
    out_cols = [c for c in rows.columns if c != "_scope"]
    judged = keyed.join(per_key, cond, "left").select(
        *out_cols,
        F.when((F.col("_exists") == 0) & (ord_struct == F.col("_first")), F.lit(STATUS_INSERTED))
        .otherwise(F.lit(STATUS_DUPLICATE))
        .alias("status"),
    )
    unkeyed = rows.where(F.col("skipped") | (F.col("key") == "")).select(
        *out_cols,
        F.when(F.col("skipped"), F.lit(STATUS_SKIPPED)).otherwise(F.lit(STATUS_INSERTED)).alias("status"),
    )
    classified = judged.unionByName(unkeyed)
    return assign_ids(classified, existing, order) if ids else classified


def assign_ids(classified: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """New ids for inserted rows: the season's max id + position in file order."""
    max_id = existing.groupBy("season").agg(F.max("id").alias("_max_id"))  # one row per season
    ins = classified.where(F.col("status") == STATUS_INSERTED)
    ins = ins.join(F.broadcast(max_id), "season", "left").withColumn("_base", F.coalesce("_max_id", F.lit(0)))
    numbered = sequence_number(ins, order, partition_by=["season"], name="_seq", start=0)
    numbered = numbered.select(*classified.columns, (F.col("_base") + F.col("_seq") + 1).alias("id"))
    rest = classified.where(F.col("status") != STATUS_INSERTED).withColumn("id", F.lit(None).cast("long"))
    return numbered.unionByName(rest)


def upload_summary(classified: DataFrame) -> DataFrame:
    """Per season: inserted, duplicates, skipped."""
    return classified.groupBy("season").agg(
        F.sum((F.col("status") == STATUS_INSERTED).cast("long")).alias("inserted"),
        F.sum((F.col("status") == STATUS_DUPLICATE).cast("long")).alias("duplicates"),
        F.sum((F.col("status") == STATUS_SKIPPED).cast("long")).alias("skipped"),
    )


def inserted_farmers(classified: DataFrame) -> DataFrame:
    """The rows to append to the farmer table."""
    return conform(classified.where(F.col("status") == STATUS_INSERTED), "farmer")


def apply_upload(farmer: DataFrame, classified: DataFrame) -> DataFrame:
    """Farmer table after the upload (existing rows plus inserted rows)."""
    cols = [f.name for f in FARMER.fields]
    return farmer.select(*cols).unionByName(inserted_farmers(classified).select(*cols))


def split_targets(spark: SparkSession, cleaned: DataFrame, tables_root: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose (season, association_id) exists, rows whose target does not)."""
    from ricefield.sources.model import read_table

    parents = read_table(spark, tables_root, "association").select("season", F.col("id").alias("association_id"))
    keys = ["season", "association_id"]
    return cleaned.join(parents, keys, "left_semi"), cleaned.join(parents, keys, "left_anti")


def check_targets(spark: SparkSession, cleaned: DataFrame, tables_root: str) -> None:
    """The association foreign key: an upload naming a (season, association_id) that
    does not exist is refused whole, before anything is written."""
    unknown = split_targets(spark, cleaned, tables_root)[1].select("season", "association_id").distinct()
    if not unknown.isEmpty():
        raise UploadRefused(unknown)


def target_columns(cleaned: DataFrame, extra: list[str], season: str | None, association_id: int | None) -> DataFrame:
    """Give the rows their target where the files carry no such columns."""
    if "season" not in extra:
        if season is None:
            raise ValueError("season is required when the upload has no season column")
        cleaned = cleaned.withColumn("season", F.lit(season))
    if "association_id" in extra:
        return cleaned.withColumn("association_id", F.col("association_id").cast("long"))
    if association_id is None:
        raise ValueError("association_id is required when the upload has no association_id column")
    return cleaned.withColumn("association_id", F.lit(association_id).cast("long"))


def run_upload(
    spark: SparkSession,
    path: str,
    tables_root: str,
    association_id: int | None = None,
    season: str | None = None,
    scope: str | dict[str, str] = "season",
    template: str = "full",
    fmt: str = "csv",
    multiline: bool = False,
) -> DataFrame:
    """End-to-end upload job: read the files at ``path``, clean and classify the rows
    against the farmer table under ``tables_root`` and append the inserted rows in one
    commit, all or none; only new files are written.  ``season`` / ``association_id`` give
    the target when the files carry no such columns.  Returns the per-season summary.
    """
    from ricefield.sinks import store
    from ricefield.sinks.tables import append_rows

    raw = read_upload(spark, path, fmt=fmt, multiline=multiline, template=template)
    extra = [c for c in ("season", "association_id") if c in [x.strip().lower() for x in raw.columns]]
    cleaned = clean_upload(raw, template=template, keep=extra + ["_file", "_block", "_row"])
    checkpoint_dir(spark)
    # the one checkpoint of the upload: row numbers and all later steps come from it
    cleaned = target_columns(cleaned, extra, season, association_id).checkpoint(eager=True)
    check_targets(spark, cleaned, tables_root)
    before = store.state(spark, tables_root)
    existing = store.read(spark, tables_root, "farmer", before)
    seasons = [r["season"] for r in cleaned.select("season").distinct().collect()]  # a handful of labels
    existing = existing.where(F.col("season").isin(seasons))
    classified = classify_upload(cleaned, existing, ["_file", "_block", "_row"], scope=scope, durable=False)
    classified = classified.checkpoint(eager=True)  # written once, read by the append and the summary
    append_rows(spark, "farmer", inserted_farmers(classified), tables_root, before)
    return upload_summary(classified)
