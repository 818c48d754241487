"""Ordered batches of additions, renames and deletions of named rows.

One request at a time, a name is refused when another row of its scope bears it at that
moment: a name that an earlier request of the batch freed can be taken, and one that an
earlier request took can't.  So whether request i holds depends on the requests before it.

``replay`` solves a batch in rounds over these dependencies.  A round takes the outcomes of
the round before (at first: every request holds) and judges all requests against them at
once: a request's key is followed through the batch as arrivals (rows that bear it at the
start, requests that give it) and departures (requests that give its bearer another name or
delete it), and the request holds when the running count of bearers just before it, without
the row itself, is zero.  A request depends on earlier ones only, so after round r at least
the first r requests of a scope are settled; a round that changes nothing in a scope has
found its result, and only the other scopes go on.  Chains that hold as a whole, and rows of
requests for one name, settle in the first rounds.

Running counts and last names come from ``running``, so neither a name that a third of all
requests ask for nor a row that they all rename is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ricefield.functions.exprs import py_strip, sql_key
from ricefield.operators.changes import _next_ids, delete_associations
from ricefield.operators.running import running
from ricefield.session import stored
from ricefield.sources.model import Tables, conform


def judge(requests: DataFrame, bearers: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """One round: ``requests`` (scope, order, who, kind 'add' | 'rename' | 'delete', key,
    name, first_key, first_name, holds) with ``now`` = whether the request holds when those
    with ``holds`` do, and the name its row has then, ``had_name``.  ``bearers``: scope, key
    and ``n`` rows of the table bearing it."""
    named = F.col("holds") & (F.col("kind") != "delete")
    # what each row is called just before each request for it
    rows = running(
        requests, [*scope, "who"], order,
        lasts={"_had": F.when(named, F.struct("key", "name"))},
    )
    rows = rows.withColumn("had_key", F.coalesce("_had.key", "first_key")).withColumn("had_name", F.coalesce("_had.name", "first_name"))
    rows = rows.drop("_had")
    at = [*scope, *order]
    # a request is asked about its key before its own arrival and departure count
    asked = rows.where(F.col("kind") != "delete").select(*at, "key", F.lit(0).alias("_after"), F.lit(0).cast("long").alias("_step"), "who")
    come = rows.where(named).select(*at, "key", F.lit(1).alias("_after"), F.lit(1).cast("long").alias("_step"), "who")
    gone = rows.where(F.col("holds") & F.col("had_key").isNotNull()).select(
        *at, F.col("had_key").alias("key"), F.lit(2).alias("_after"), F.lit(-1).cast("long").alias("_step"), "who"
    )
    wanted = rows.where(F.col("kind") != "delete").select(*scope, "key").distinct()
    events = asked.unionByName(come).unionByName(gone).join(wanted, [*scope, "key"], "left_semi")
    counted = running(events, [*scope, "key"], [*order, "_after", "who"], sums={"_moved": F.col("_step")})
    counted = counted.where(F.col("_after") == 0).select(*at, "who", "key", "_moved").join(bearers, [*scope, "key"], "left")
    bears = F.coalesce("n", F.lit(0)) + F.col("_moved")
    judged = rows.join(counted.select(*at, "who", bears.alias("_bears")), [*at, "who"], "left")
    own = F.when(F.col("had_key") == F.col("key"), 1).otherwise(0)
    return judged.withColumn("now", F.when(F.col("kind") == "delete", F.lit(True)).otherwise(F.col("_bears") - own == 0)).drop("_bears")


def replay(requests: DataFrame, bearers: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``requests`` (see ``judge``, without ``holds``) with ``holds`` and ``had_name`` as one
    request at a time would have them."""
    open_, settled = requests.withColumn("holds", F.lit(True)), None
    columns = open_.columns
    while True:
        judged = stored(judge(open_, bearers, scope, order), "replay")
        changed = judged.where(F.col("now") != F.col("holds")).select(*scope).distinct()
        last = changed.isEmpty()
        same = (judged if last else judged.join(changed, scope, "left_anti")).select(*columns, "had_name")
        settled = same if settled is None else settled.unionByName(same)
        if last:
            return settled
        open_ = judged.join(changed, scope, "left_semi").withColumn("holds", F.col("now")).select(*columns)


def change_named(
    table: DataFrame,
    requests: DataFrame,
    order: list[str],
    scope: list[str],
    target: str,
    parents: DataFrame | None = None,
    missing_parent: str = "no municipality",
) -> tuple[DataFrame, DataFrame]:
    """Apply an ordered batch to a table of named rows.

    ``requests``: kind, season, id (of 'rename' and 'delete'), the scope's columns (of
    'add'), name, and the ``order`` columns (a total order).  Outcomes: kind, season, id,
    order, ``old_name`` (the row's name just before), ``new_name``, status ('inserted',
    'renamed', 'deleted', 'duplicate', 'blank', 'not found', ``missing_parent``), ``new_id``.
    Ids in requests are those of the table before the batch; new ids follow the season's
    greatest one, in order.
    """
    fk = [c for c in scope if c != "season"]
    r = requests.withColumn("new_name", F.when(F.col("kind") != "delete", F.coalesce(py_strip(F.col("name").cast("string")), F.lit(""))))
    r = r.withColumn("key", sql_key("new_name")).withColumn("who", F.when(F.col("kind") == "add", F.to_json(F.struct(*order))).otherwise(F.concat(F.lit("id "), F.col("id"))))
    ids = r.where("kind <> 'add'").select("season", "id").distinct()
    known = table.join(ids, ["season", "id"], "left_semi").select("season", "id", *[F.col(c).alias(f"_of_{c}") for c in fk], F.col("name").alias("first_name"))
    r = r.join(known, ["season", "id"], "left")
    for c in fk:
        r = r.withColumn(c, F.when(F.col("kind") == "add", F.col(c)).otherwise(F.col(f"_of_{c}"))).drop(f"_of_{c}")
    # a row is there until the first request that deletes it
    ends = r.where((F.col("kind") == "delete") & F.col("first_name").isNotNull()).groupBy("season", "id").agg(F.min(F.struct(*order)).alias("_end"))
    r = r.join(ends, ["season", "id"], "left")
    there = F.col("first_name").isNotNull() & F.coalesce(F.struct(*order) <= F.col("_end"), F.lit(True))
    refused = F.when((F.col("kind") != "add") & ~there, "not found").when((F.col("kind") != "delete") & (F.col("new_name") == ""), "blank")
    if parents is not None:
        have = parents.select("season", *[F.col("id").alias(c) for c in fk], F.lit(True).alias("_parent"))
        r = r.join(have, ["season", *fk], "left")
        refused = refused.when((F.col("kind") == "add") & F.col("_parent").isNull(), missing_parent)
    r = r.withColumn("refused", refused).withColumn("first_key", sql_key("first_name")).drop("_parent", "_end")
    r = stored(r, "requests")
    asked = r.where(F.col("refused").isNull())
    wanted = asked.where("kind <> 'delete'").select(*scope, "key").distinct()
    bearers = table.select(*scope, sql_key("name").alias("key")).join(wanted, [*scope, "key"], "left_semi")
    bearers = bearers.groupBy(*scope, "key").agg(F.count(F.lit(1)).alias("n"))
    played = replay(
        asked.select(*scope, *order, "id", "who", "kind", "key", F.col("new_name").alias("name"), "first_key", "first_name"), bearers, scope, order
    )
    played = played.withColumn(
        "status",
        F.when(~F.col("holds"), "duplicate").when(F.col("kind") == "add", "inserted").when(F.col("kind") == "rename", "renamed").otherwise("deleted"),
    )
    columns = ["kind", "season", "id", *order]
    none = F.lit(None).cast("long").alias("new_id")
    added = _next_ids(played.where("status = 'inserted'").drop("id"), table, order)
    outcome = (
        added.select("kind", "season", F.lit(None).cast("long").alias("id"), *order, F.col("had_name").alias("old_name"), F.col("name").alias("new_name"), "status", F.col("id").alias("new_id"))
        .unionByName(played.where("status <> 'inserted'").select(*columns, F.col("had_name").alias("old_name"), F.col("name").alias("new_name"), "status", none))
        .unionByName(r.where(F.col("refused").isNotNull()).select(*columns, _no_name("kind", "first_name"), "new_name", F.col("refused").alias("status"), none))
    )
    last = played.where("status = 'renamed'").groupBy("season", "id").agg(F.max_by("name", F.struct(*order)).alias("_name"))
    gone = played.where("status = 'deleted'").select("season", "id")
    kept = table.join(gone, ["season", "id"], "left_anti").join(last, ["season", "id"], "left")
    kept = kept.select(*[(F.coalesce("_name", "name") if c == "name" else F.col(c)).alias(c) for c in table.columns])
    return conform(kept, target).unionByName(conform(added, target)), outcome


def _no_name(kind: str, name: str) -> Column:
    """A refused request tells the row's name before the batch, if there is such a row."""
    return F.when(F.col(kind) != "add", F.col(name)).alias("old_name")


def change_associations(tables: Tables, requests: DataFrame, order: list[str]) -> tuple[Tables, DataFrame]:
    """An ordered batch on associations (scope: their municipality); farmers of deleted ones
    go with them.  Returns the tables and the outcomes."""
    table, outcome = change_named(
        tables.association, requests, order, ["season", "municipality_id"], "association", parents=tables.municipality
    )
    gone = outcome.where("status = 'deleted'").select("season", "id")
    farmers = delete_associations(tables, gone)[0].farmer
    return tables.with_(association=table, farmer=farmers), outcome


def change_municipalities(municipality: DataFrame, requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """An ordered batch on municipalities (scope: their season)."""
    return change_named(municipality, requests, order, ["season"], "municipality")
