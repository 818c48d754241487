"""Change-sets: batches of inserts, updates, renames and cascading deletes.

The reference edits one row per web request.  Here each edit kind is a function
``f(table(s), changes) -> (new table(s), outcomes)``: the new table is a lazy plan over
the old one (copy-on-write; ``sinks.tables`` writes it to a staging folder and swaps),
and ``outcomes`` has one row per requested change with its status.

Within a batch, changes apply in ``order`` (file order): a later insert whose name
duplicates an earlier accepted one is rejected, and a later update of the same farmer
wins.  A batch of renames is one change: its names are tested against the table as it was before
the batch and against earlier accepted renames of the batch, so a name that the batch
itself frees can be taken by the next batch (a deliberate batch rule; one by one, the
reference's requests would see it freed at once).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricefield.functions.exprs import form_number, py_strip, sql_key
from ricefield.operators.ranking import sequence_number
from ricefield.sources.model import FARMER, Tables, conform

FARMER_COLS = [f.name for f in FARMER.fields]
TEXT_FIELDS = ["rsbsa", "last_name", "first_name", "middle_name", "suffix", "variety"]
NUMBER_FIELDS = ["area", "sacks", "kg"]


def form_rows(df: DataFrame) -> DataFrame:
    """Typed form values: text stripped (NULL -> ''), numbers ``float(x or 0)``.

    Adds ``valid`` (False when a number does not parse; the reference would fail that
    request).  Other columns (season, id, association_id, line, ...) pass through.
    """
    keep = [c for c in df.columns if c not in TEXT_FIELDS + NUMBER_FIELDS]
    nums = {c: form_number(F.col(c)) for c in NUMBER_FIELDS}
    valid = reduce(lambda a, b: a & b, [v.isNotNull() for v in nums.values()])
    return df.select(
        *keep,
        *[F.coalesce(py_strip(F.col(c).cast("string")), F.lit("")).alias(c) for c in TEXT_FIELDS],
        *[v.alias(c) for c, v in nums.items()],
        valid.alias("valid"),
    )


def _next_ids(rows: DataFrame, table: DataFrame, order: list[str], group: list[str] = ("season",)) -> DataFrame:
    """``id`` = the season's max id in ``table`` + position of the row in ``order``."""
    group = list(group)
    max_id = table.groupBy(*group).agg(F.max("id").alias("_max_id"))  # one row per season
    r = rows.join(F.broadcast(max_id), group, "left").withColumn("_base", F.coalesce("_max_id", F.lit(0)))
    n = sequence_number(r, order, partition_by=group, name="_seq", start=0)
    return n.withColumn("id", (F.col("_base") + F.col("_seq") + 1).cast("long")).drop("_max_id", "_base", "_seq")


# ------------------------------------------------------------------ farmers


def insert_farmers(farmer: DataFrame, proposals: DataFrame, order: list[str], association: DataFrame | None = None):
    """Append ``form_rows`` proposals (season, association_id, fields); no dedupe.
    With ``association`` given, a proposal whose association does not exist in its
    season is rejected (the foreign key).  Outcomes: proposal columns + status
    ('inserted' | 'invalid' | 'no association') + new id."""
    out_cols = [c for c in proposals.columns if c != "valid"]
    none = F.lit(None).cast("long")
    valid = proposals.where("valid")
    rejected = proposals.where(~F.col("valid")).select(*out_cols, F.lit("invalid").alias("status"), none.alias("id"))
    if association is not None:
        parents = association.select("season", F.col("id").alias("association_id"))
        orphans = valid.join(parents, ["season", "association_id"], "left_anti")
        valid = valid.join(parents, ["season", "association_id"], "left_semi")
        rejected = rejected.unionByName(orphans.select(*out_cols, F.lit("no association").alias("status"), none.alias("id")))
    numbered = _next_ids(valid, farmer, order)
    new_rows = conform(numbered, "farmer")
    table = farmer.select(*FARMER_COLS).unionByName(new_rows)
    outcome = numbered.select(*out_cols, F.lit("inserted").alias("status"), "id").unionByName(rejected)
    return table, outcome


def update_farmers(farmer: DataFrame, edits: DataFrame, order: list[str]):
    """Replace the nine editable fields of farmers by (season, id); the association is
    unchanged.  Unknown ids -> 'not found' (looked up first), numbers that do not parse ->
    'invalid'; of several valid edits of one farmer the last in ``order`` wins
    ('superseded' for the others)."""
    ok = edits.where("valid")
    fields = TEXT_FIELDS + NUMBER_FIELDS
    last = ok.groupBy("season", "id").agg(
        F.max_by(F.struct(*fields, *order), F.struct(*order)).alias("_e")
    )
    last = last.select("season", "id", *[F.col(f"_e.{c}").alias(f"_new_{c}") for c in fields], *[F.col(f"_e.{c}").alias(f"_win_{c}") for c in order])
    f = farmer.select(*FARMER_COLS)
    j = f.join(last, ["season", "id"], "left")
    hit = F.col("_new_rsbsa").isNotNull()
    table = j.select(
        *[
            (F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c)
            for c in FARMER_COLS
        ]
    )
    # only the batch's ids of the table take part in the outcomes
    ids = edits.select("season", "id").distinct()
    known = f.select("season", "id").join(ids, ["season", "id"], "left_semi").withColumn("_known", F.lit(True))
    e = edits.join(known, ["season", "id"], "left").join(
        last.select("season", "id", *[f"_win_{c}" for c in order]), ["season", "id"], "left"
    )
    is_winner = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_win_{c}")) for c in order])
    status = (
        F.when(F.col("_known").isNull(), "not found")
        .when(~F.col("valid"), "invalid")
        .when(is_winner, "updated")
        .otherwise("superseded")
    )
    out_cols = [c for c in edits.columns if c != "valid"]
    return table, e.select(*out_cols, status.alias("status"))


def delete_farmers(farmer: DataFrame, ids: DataFrame):
    """Remove farmers by (season, id).  Outcomes: requested ids with 'deleted' / 'not found'."""
    keys = ids.select("season", "id").distinct()
    table = farmer.join(keys, ["season", "id"], "left_anti")
    found = farmer.select("season", "id").join(keys, ["season", "id"], "left_semi").withColumn("_hit", F.lit(True))
    outcome = keys.join(found, ["season", "id"], "left").select(
        "season", "id", F.when(F.col("_hit"), "deleted").otherwise("not found").alias("status")
    )
    return table, outcome


# ---------------------------------------------------------- cascading deletes


def delete_associations(tables: Tables, ids: DataFrame):
    """Remove associations by (season, id) together with their farmers."""
    keys = ids.select("season", "id").distinct()
    assoc = tables.association.join(keys, ["season", "id"], "left_anti")
    fk = keys.select("season", F.col("id").alias("association_id"))
    farmer = tables.farmer.join(fk, ["season", "association_id"], "left_anti")
    return tables.with_(association=assoc, farmer=farmer), keys


def delete_municipalities(tables: Tables, ids: DataFrame):
    """Remove municipalities by (season, id), their associations and those associations'
    farmers (semi join to find the victims, anti joins to keep the rest)."""
    keys = ids.select("season", "id").distinct()
    muni = tables.municipality.join(keys, ["season", "id"], "left_anti")
    victims = tables.association.join(
        keys.select("season", F.col("id").alias("municipality_id")), ["season", "municipality_id"], "left_semi"
    ).select("season", "id")
    out, _ = delete_associations(tables.with_(municipality=muni), victims)
    return out, keys


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of model tables in one shape: table_name, season, id, parent_id, name (a
    farmer's RSBSA, last and first name), area, sacks, kg."""
    parts = []
    for name, df in tables.items():
        parent = {"association": "municipality_id", "farmer": "association_id"}.get(name)
        label = F.concat_ws("|", "rsbsa", "last_name", "first_name", "middle_name", "suffix", "variety") if name == "farmer" else F.col("name")
        numbers = [F.col(c) if name == "farmer" else F.lit(None).cast("double").alias(c) for c in NUMBER_FIELDS]
        parts.append(
            df.select(
                F.lit(name).alias("table_name"), "season", "id",
                (F.col(parent) if parent else F.lit(None)).cast("long").alias("parent_id"), label.alias("name"), *numbers,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per (table, season)."""
    parts = [df.groupBy("season").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "season", "rows")


# ------------------------------------------------------------- named parents

def _matching_keys(table_keys: DataFrame, batch: DataFrame, scope: list[str]) -> DataFrame:
    """The table's (scope, _key) rows whose key occurs in the batch: a semi join, so only
    matching table rows reach what follows.  Spark broadcasts the batch's keys when their
    size in bytes allows it."""
    keys = batch.select(*scope, "_key").distinct()
    return table_keys.join(keys, [*scope, "_key"], "left_semi")


def _add_named(
    table: DataFrame,
    proposals: DataFrame,
    order: list[str],
    scope: list[str],
    unique: bool,
    target: str,
    parents: DataFrame | None = None,
):
    """Shared add logic for municipalities (scope: season) and associations
    (scope: season, municipality_id).  Blank names are rejected; with ``unique`` a name
    whose key LOWER(TRIM(name)) exists in the scope, or belongs to an earlier accepted
    proposal, is rejected."""
    p = proposals.withColumn("name", F.coalesce(py_strip(F.col("name").cast("string")), F.lit("")))
    p = p.withColumn("_key", sql_key("name"))
    blank = p.where(F.col("name") == "")
    named = p.where(F.col("name") != "")
    orphans = named.where(F.lit(False))
    if parents is not None:  # the foreign key to the parent table (same season)
        fk = [c for c in scope if c != "season"]
        keys = parents.select("season", *[F.col("id").alias(c) for c in fk])
        orphans = named.join(keys, ["season", *fk], "left_anti")
        named = named.join(keys, ["season", *fk], "left_semi")
    if unique:
        ord_struct = F.struct(*[F.col(c) for c in order])
        ord_type = named.select(ord_struct.alias("o")).schema["o"].dataType
        ex = _matching_keys(table.select(*scope, sql_key("name").alias("_key")), named, scope)
        ex = ex.select(*scope, "_key", F.lit(1).alias("_exists"), F.lit(None).cast(ord_type).alias("_ord"))
        up = named.select(*scope, "_key", F.lit(0).alias("_exists"), ord_struct.alias("_ord"))
        per_key = ex.unionByName(up).groupBy(*scope, "_key").agg(F.max("_exists").alias("_ex"), F.min("_ord").alias("_first"))
        judged = named.join(per_key, [*scope, "_key"], "left")
        accepted_cond = (F.col("_ex") == 0) & (ord_struct == F.col("_first"))
        accepted = judged.where(accepted_cond).drop("_ex", "_first")
        dup = judged.where(~accepted_cond).drop("_ex", "_first")
    else:
        accepted, dup = named, named.where(F.lit(False))
    numbered = _next_ids(accepted, table, order)
    new_rows = conform(numbered, target)
    new_table = table.unionByName(new_rows)
    cols = [c for c in proposals.columns]
    none = F.lit(None).cast("long")
    outcome = (
        numbered.select(*cols, F.lit("inserted").alias("status"), F.col("id").alias("new_id"))
        .unionByName(dup.select(*cols, F.lit("duplicate").alias("status"), none.alias("new_id")))
        .unionByName(blank.select(*cols, F.lit("blank").alias("status"), none.alias("new_id")))
        .unionByName(orphans.select(*cols, F.lit("no municipality").alias("status"), none.alias("new_id")))
    )
    return new_table, outcome


def add_municipalities(municipality: DataFrame, proposals: DataFrame, order: list[str], unique: bool = False):
    """proposals: season, name, order columns."""
    return _add_named(municipality, proposals, order, ["season"], unique, "municipality")


def add_associations(
    association: DataFrame,
    proposals: DataFrame,
    order: list[str],
    unique: bool = False,
    municipality: DataFrame | None = None,
):
    """proposals: season, municipality_id, name, order columns.  With ``municipality``
    given, a proposal for a municipality missing in its season gets 'no municipality'."""
    return _add_named(
        association, proposals, order, ["season", "municipality_id"], unique, "association", parents=municipality
    )


def _rename(table: DataFrame, renames: DataFrame, order: list[str], scope: list[str], unique: bool, target: str):
    """Rename rows by (season, id): unknown id -> 'not found', blank -> 'blank'; with
    ``unique`` a new key held by another row of the scope (before the batch) or by an
    earlier accepted rename is 'duplicate'.  Of several accepted renames of one row
    the last wins."""
    cols = list(renames.columns)
    r = renames.withColumn("new_name", F.coalesce(py_strip(F.col("name").cast("string")), F.lit("")))
    cur = table.select("season", "id", *[c for c in scope if c not in ("season", "id")], F.col("name").alias("old_name"))
    r = r.drop(*[c for c in scope if c not in ("season", "id")]).join(cur, ["season", "id"], "left")
    r = r.withColumn("_key", sql_key("new_name"))
    status = F.when(F.col("old_name").isNull(), "not found").when(F.col("new_name") == "", "blank")
    if unique:
        ord_struct = F.struct(*[F.col(c) for c in order])
        cand = r.where((F.col("new_name") != "") & F.col("old_name").isNotNull())
        holders = _matching_keys(table.select(*scope, sql_key("name").alias("_key"), F.col("id").alias("_hid")), cand, scope)
        # another row of the scope holds the key -> duplicate (keeping one's own key is fine)
        taken = cand.alias("c").join(
            holders.alias("h"),
            [F.col(f"c.{s}") == F.col(f"h.{s}") for s in scope]
            + [F.col("c._key") == F.col("h._key"), F.col("c.id") != F.col("h._hid")],
            "left_semi",
        ).select("season", "id", *order).withColumn("_taken", F.lit(True))
        r = r.join(taken, ["season", "id", *order], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
        # of the renames to a key no other row holds, the first in order wins it
        free = r.where((F.col("new_name") != "") & F.col("old_name").isNotNull() & ~F.col("_taken"))
        first = free.groupBy(*scope, "_key").agg(F.min(ord_struct).alias("_first"))
        r = r.join(first, [*scope, "_key"], "left")
        status = status.when(F.col("_taken") | (ord_struct != F.col("_first")), "duplicate")
    r = r.withColumn("status", status.otherwise("renamed"))
    ok = r.where(F.col("status") == "renamed")
    last = ok.groupBy("season", "id").agg(F.max_by("new_name", F.struct(*order)).alias("_nn"))
    new_table = table.join(last, ["season", "id"], "left").select(
        *[(F.coalesce("_nn", "name") if c == "name" else F.col(c)).alias(c) for c in table.columns]
    )
    outcome = r.select(*[c for c in cols if c != "name"], "old_name", "new_name", "status")
    return conform(new_table, target), outcome


def rename_associations(association: DataFrame, renames: DataFrame, order: list[str], unique: bool = False):
    """renames: season, id, name, order columns (uniqueness within the association's municipality)."""
    return _rename(association, renames, order, ["season", "municipality_id"], unique, "association")


def rename_municipalities(municipality: DataFrame, renames: DataFrame, order: list[str]):
    """renames: season, id, name, order columns (no duplicate check, as in both seasons)."""
    return _rename(municipality, renames, order, ["season"], False, "municipality")


def seed_varieties(variety: DataFrame, seeds: list[str], seasons: list[str]):
    """Insert each seed name absent from a season's variety table (exact name match),
    ids continuing the season's maximum in seed order."""
    spark = variety.sparkSession
    s = spark.createDataFrame([(season, i, name) for season in seasons for i, name in enumerate(seeds)], "season string, seed_order int, name string")
    missing = s.join(variety.select("season", "name"), ["season", "name"], "left_anti")
    numbered = _next_ids(missing, variety, ["seed_order"])
    added = conform(numbered, "variety")
    return variety.unionByName(added), numbered.select("season", "name", "id")
