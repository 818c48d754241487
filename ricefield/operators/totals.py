"""Association totals that follow the changes of the farmer table.

The rollups (season, municipality, association) all start from one row per association with
its farmers, area, sacks and production.  This module keeps these rows beside a store, per
version of it: a change brings the rows that it removed and added, these are summed with
their signs per association, and the new totals are the old ones plus that.  So totals after
a change read the old totals and the few associations of the change, and no farmers.

A sum counts its non-NULL terms too: when none is left it is NULL again, as a sum over no
rows is, and an association without farmers has no row.  Sums are doubles; after many
changes the last bits can differ from a sum over all rows (``rebuild`` starts anew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.functions.exprs import production_kg
from ricefield.operators.changes import delete_associations, delete_farmers, delete_municipalities, insert_farmers, update_farmers
from ricefield.session import stored
from ricefield.sinks import store
from ricefield.sinks.tables import commit_change
from ricefield.sources.model import Tables, read_tables

KEY = ["season", "association_id"]
MEASURES = ["area", "sacks", "kg"]
SCHEMA = "season string, association_id long, farmers long, area double, sacks double, kg double, n_area long, n_sacks long, n_kg long"


def _summed(rows: DataFrame) -> DataFrame:
    """Totals of rows with a ``sign``."""
    values = {"area": F.col("area"), "sacks": F.col("sacks"), "kg": production_kg()}
    return rows.groupBy(*KEY).agg(
        F.sum("sign").alias("farmers"),
        *[F.sum(v * F.col("sign")).alias(n) for n, v in values.items()],
        *[F.coalesce(F.sum(F.when(v.isNotNull(), F.col("sign"))), F.lit(0)).alias(f"n_{n}") for n, v in values.items()],
    )


def totals_of(farmer: DataFrame) -> DataFrame:
    """Totals of a whole farmer table."""
    return _summed(farmer.withColumn("sign", F.lit(1).cast("long")))


def moved(removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """What farmer rows that went and came change in the totals."""
    parts = [
        df.select(*KEY, "area", "sacks", "kg", F.lit(sign).cast("long").alias("sign"))
        for df, sign in ((removed, -1), (added, 1))
        if df is not None
    ]
    return _summed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def merged(totals: DataFrame, change: DataFrame) -> DataFrame:
    """Totals after a change (``moved``)."""
    both = totals.unionByName(change).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("farmers", *MEASURES, *[f"n_{m}" for m in MEASURES])])
    kept = both.where(F.col("farmers") > 0)
    return kept.select(
        *KEY, "farmers", *[F.when(F.col(f"n_{m}") > 0, F.col(m)).alias(m) for m in MEASURES], *[f"n_{m}" for m in MEASURES]
    )


# ------------------------------------------------------------------ beside a store


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_totals/{version:012d}"


def rebuild(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the store's last version from its farmers, kept."""
    at = store.state(spark, root)
    totals_of(store.read(spark, root, "farmer", at)).write.mode("overwrite").parquet(_folder(root, at["version"]))
    return _kept(spark, root, at["version"])


def _kept(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    folder = _folder(root, version)
    return spark.read.schema(SCHEMA).parquet(folder) if store.exists(spark, f"{folder}/_SUCCESS") else None


def current(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the last version: those kept with it, else from its farmers."""
    found = _kept(spark, root, store.state(spark, root)["version"])
    return rebuild(spark, root) if found is None else found


def tables_with_totals(spark: SparkSession, root: str) -> Tables:
    """The tables and their totals, for the rollups."""
    tables = read_tables(spark, root)
    found = _kept(spark, root, tables.read_at["version"])
    return tables.with_(totals=totals_of(tables.farmer) if found is None else found)


def commit_with_totals(spark: SparkSession, root: str, change) -> DataFrame:
    """``commit_change`` for a ``change(tables)`` that also gives ``moved``; the totals kept
    with the version it started from are carried to the new one.  Should another job commit
    right after, its version has none kept, and ``current`` counts anew."""
    seen: dict = {}

    def inner(tables: Tables):
        changed, outcome, delta = change(tables)
        seen.update(version=tables.read_at["version"], moved=stored(delta, "moved"))
        return changed, outcome

    outcome = commit_change(spark, root, inner)
    old = _kept(spark, root, seen["version"])
    if old is not None and store.state(spark, root)["version"] == seen["version"] + 1:
        merged(old, seen["moved"]).write.mode("overwrite").parquet(_folder(root, seen["version"] + 1))
    return outcome


def inserting(proposals: DataFrame, order: list[str]):
    def change(t: Tables):
        table, outcome = insert_farmers(t.farmer, proposals, order, t.association)
        outcome = stored(outcome, "inserted")
        return {"farmer": table}, outcome, moved(added=outcome.where("status = 'inserted'"))

    return change


def updating(edits: DataFrame, order: list[str]):
    def change(t: Tables):
        table, outcome = update_farmers(t.farmer, edits, order)
        ids = edits.where("valid").select("season", "id").distinct()
        return {"farmer": table}, outcome, moved(*(f.join(ids, ["season", "id"], "left_semi") for f in (t.farmer, table)))

    return change


def deleting(ids: DataFrame):
    def change(t: Tables):
        table, outcome = delete_farmers(t.farmer, ids)
        return {"farmer": table}, outcome, moved(t.farmer.join(ids.select("season", "id").distinct(), ["season", "id"], "left_semi"))

    return change


def _cascade(t: Tables, after: Tables, rows: DataFrame, keys: DataFrame, names: list[str]):
    known = keys.join(rows.select("season", "id"), ["season", "id"], "left_semi").withColumn("status", F.lit("deleted"))
    gone = t.association.join(after.association.select("season", "id"), ["season", "id"], "left_anti")
    lost = t.farmer.join(gone.select("season", F.col("id").alias("association_id")), KEY, "left_semi")
    return {n: getattr(after, n) for n in names}, known, moved(lost)


def deleting_associations(ids: DataFrame):
    def change(t: Tables):
        after, keys = delete_associations(t, ids)
        return _cascade(t, after, t.association, keys, ["association", "farmer"])

    return change


def deleting_municipalities(ids: DataFrame):
    def change(t: Tables):
        after, keys = delete_municipalities(t, ids)
        return _cascade(t, after, t.municipality, keys, ["municipality", "association", "farmer"])

    return change
