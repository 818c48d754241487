"""Rollups of production, area and yield up the municipality > association > farmer tree.

Every rollup starts from one pre-aggregate, ``association_totals``: farmers grouped by
``(season, association_id)``.  Parents (associations, municipalities) are joined to
that aggregate, never to farmer rows, so the big side is reduced map-side before the
only farmer shuffle.  Farmer ids are keys and the hierarchy is a tree, so the
reference's ``COUNT(DISTINCT farmer)`` per municipality equals the sum of the
association counts (no ``Expand``, no second shuffle of joined farmer rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.functions.exprs import mt, production_kg, r2, ratio0
from ricefield.operators.ranking import first_by, sequence_number
from ricefield.sources.model import Tables


def association_totals(farmer: DataFrame) -> DataFrame:
    """farmers, area, sacks and production kg (sacks * kg-per-bag) per association."""
    return farmer.groupBy("season", "association_id").agg(
        F.count("id").alias("farmers"),
        F.sum("area").alias("area"),
        F.sum("sacks").alias("sacks"),
        F.sum(production_kg()).alias("kg"),
    )


def association_rollup(tables: Tables) -> DataFrame:
    """Every association (childless ones with zeros) with its farmer totals.

    Columns: season, id, municipality_id, name, farmers, area, sacks, kg.
    """
    t = association_totals(tables.farmer) if tables.totals is None else tables.totals
    a = tables.association
    j = a.join(t, (a.season == t.season) & (a.id == t.association_id), "left")
    return j.select(
        a.season,
        a.id,
        a.municipality_id,
        a.name,
        F.coalesce(t.farmers, F.lit(0)).alias("farmers"),
        F.coalesce(t.area, F.lit(0.0)).alias("area"),
        F.coalesce(t.sacks, F.lit(0.0)).alias("sacks"),
        F.coalesce(t.kg, F.lit(0.0)).alias("kg"),
    )


def municipality_rollup(tables: Tables) -> DataFrame:
    """Every municipality with association count and farmer totals (zeros when empty).

    Columns: season, id, name, associations, farmers, area, sacks, kg.
    """
    per_m = association_rollup(tables).groupBy("season", "municipality_id").agg(
        F.count(F.lit(1)).alias("associations"),
        F.sum("farmers").alias("farmers"),
        F.sum("area").alias("area"),
        F.sum("sacks").alias("sacks"),
        F.sum("kg").alias("kg"),
    )
    m = tables.municipality
    j = m.join(per_m, (m.season == per_m.season) & (m.id == per_m.municipality_id), "left")
    return j.select(
        m.season,
        m.id,
        m.name,
        F.coalesce(per_m.associations, F.lit(0)).alias("associations"),
        F.coalesce(per_m.farmers, F.lit(0)).alias("farmers"),
        F.coalesce(per_m.area, F.lit(0.0)).alias("area"),
        F.coalesce(per_m.sacks, F.lit(0.0)).alias("sacks"),
        F.coalesce(per_m.kg, F.lit(0.0)).alias("kg"),
    )


def _seasons(spark: SparkSession, seasons: list[str]) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(seasons)], "season string, season_order int")


def season_totals(tables: Tables, seasons: list[str]) -> DataFrame:
    """Raw per-season totals (all farmers of the season, orphans included).

    Columns: season, municipalities, associations, farmers, area, sacks, kg.
    Seasons without rows are present with zeros.
    """
    spark = tables.farmer.sparkSession
    cond = F.col("season").isin(seasons)
    m = tables.municipality.where(cond).groupBy("season").agg(F.count(F.lit(1)).alias("municipalities"))
    a = tables.association.where(cond).groupBy("season").agg(F.count(F.lit(1)).alias("associations"))
    if tables.totals is not None:
        f = tables.totals.where(cond).groupBy("season").agg(*[F.sum(c).alias(c) for c in ("farmers", "area", "sacks", "kg")])
    else:
        f = tables.farmer.where(cond).groupBy("season").agg(
            F.count(F.lit(1)).alias("farmers"),
            F.sum("area").alias("area"),
            F.sum("sacks").alias("sacks"),
            F.sum(production_kg()).alias("kg"),
        )
    s = _seasons(spark, seasons)
    out = s.join(m, "season", "left").join(a, "season", "left").join(f, "season", "left")
    return out.select(
        "season",
        "season_order",
        F.coalesce("municipalities", F.lit(0)).alias("municipalities"),
        F.coalesce("associations", F.lit(0)).alias("associations"),
        F.coalesce("farmers", F.lit(0)).alias("farmers"),
        F.coalesce("area", F.lit(0.0)).alias("area"),
        F.coalesce("sacks", F.lit(0.0)).alias("sacks"),
        F.coalesce("kg", F.lit(0.0)).alias("kg"),
    )


def season_summary(tables: Tables, seasons: list[str]) -> DataFrame:
    """Executive summary per season: counts, area and MT rounded to 2 places."""
    t = season_totals(tables, seasons)
    return t.select(
        "season",
        "municipalities",
        "associations",
        "farmers",
        r2("area").alias("area"),
        r2(mt("kg")).alias("mt"),
    )


def season_dashboard(tables: Tables, seasons: list[str]) -> DataFrame:
    """Season page totals: area, sacks and kg rounded, MT from the rounded kg."""
    t = season_totals(tables, seasons)
    kg_r = r2("kg")
    return t.select(
        "season",
        "municipalities",
        "associations",
        "farmers",
        r2("area").alias("area"),
        r2("sacks").alias("sacks"),
        kg_r.alias("kg"),
        r2(kg_r / 1000.0).alias("mt"),
    )


def season_averages(tables: Tables, seasons: list[str]) -> DataFrame:
    """Per season: MT per municipality, per association, per farmer, and yield (MT/ha)."""
    s = season_summary(tables, seasons)
    return s.select(
        "season",
        ratio0("mt", "municipalities").alias("avg_mt_per_municipality"),
        ratio0("mt", "associations").alias("avg_mt_per_association"),
        ratio0("mt", "area").alias("avg_yield"),
        ratio0("mt", "farmers").alias("avg_mt_per_farmer"),
    )


def season_pair(tables: Tables, base: str, current: str) -> DataFrame:
    """One row: the season summary of ``base`` and ``current`` side by side (b_*, c_*)."""
    s = season_summary(tables, [base, current])
    cols = ["municipalities", "associations", "farmers", "area", "mt"]
    aggs = []
    for prefix, season in (("b_", base), ("c_", current)):
        for c in cols:
            aggs.append(F.max(F.when(F.col("season") == season, F.col(c))).alias(prefix + c))
    return s.agg(*aggs)


def season_change(tables: Tables, base: str, current: str) -> DataFrame:
    """Differences, percent changes and trend status between two seasons."""
    from ricefield.functions.exprs import pct_change, trend

    p = season_pair(tables, base, current)
    farmer_diff = F.col("c_farmers") - F.col("b_farmers")
    area_diff = r2(F.col("c_area") - F.col("b_area"))
    prod_diff = r2(F.col("c_mt") - F.col("b_mt"))
    return p.select(
        farmer_diff.alias("farmer_difference"),
        area_diff.alias("area_difference"),
        prod_diff.alias("production_difference"),
        (F.col("c_associations") - F.col("b_associations")).alias("association_difference"),
        (F.col("c_municipalities") - F.col("b_municipalities")).alias("municipality_difference"),
        pct_change("b_farmers", "c_farmers").alias("farmer_change"),
        pct_change("b_area", "c_area").alias("area_change"),
        pct_change("b_mt", "c_mt").alias("production_change"),
        trend(prod_diff).alias("production_status"),
        trend(area_diff).alias("area_status"),
        trend(farmer_diff).alias("farmer_status"),
    )


def overall_totals(tables: Tables, base: str, current: str) -> DataFrame:
    """Both seasons combined; municipalities is the larger of the two counts."""
    p = season_pair(tables, base, current)
    total_farmers = F.col("b_farmers") + F.col("c_farmers")
    total_area = r2(F.col("b_area") + F.col("c_area"))
    total_mt = r2(F.col("b_mt") + F.col("c_mt"))
    q = p.select(
        total_farmers.alias("total_farmers"),
        (F.col("b_associations") + F.col("c_associations")).alias("total_associations"),
        total_area.alias("total_area"),
        total_mt.alias("total_mt"),
        F.greatest("b_municipalities", "c_municipalities").alias("total_municipalities"),
    )
    return q.select(
        "*",
        ratio0("total_mt", "total_area").alias("avg_yield"),
        ratio0("total_mt", "total_farmers").alias("avg_production_per_farmer"),
        ratio0("total_area", "total_farmers").alias("avg_area_per_farmer"),
    )


def municipality_summary(tables: Tables) -> DataFrame:
    """Per-season municipality rollup as shown on the dashboard (area, MT rounded)."""
    r = municipality_rollup(tables)
    return r.select(
        "season", "id", "name", "associations", "farmers", r2("area").alias("area"), r2(mt("kg")).alias("mt")
    )


def municipality_listing(tables: Tables) -> DataFrame:
    """Municipalities by name with association and farmer counts; ``pos`` within season."""
    r = municipality_rollup(tables).select(
        "season", "id", "name", F.col("associations").alias("association_count"), F.col("farmers").alias("farmer_count")
    )
    return sequence_number(r, ["name", "id"], partition_by=["season"])


def association_listing(tables: Tables, newest_first: bool = False) -> DataFrame:
    """Associations by name (or newest first: id descending) with municipality name
    (NULL for orphans) and farmer count; ``pos`` within season."""
    ar = association_rollup(tables)
    m = tables.municipality.select(
        F.col("season").alias("m_season"), F.col("id").alias("m_id"), F.col("name").alias("municipality_name")
    )
    j = ar.join(m, (ar.season == m.m_season) & (ar.municipality_id == m.m_id), "left")
    r = j.select("season", "id", "name", "municipality_name", F.col("farmers").alias("farmer_count"))
    order = [F.desc("id")] if newest_first else ["name", "id"]
    return sequence_number(r, order, partition_by=["season"])


def municipality_associations(
    tables: Tables, season: str | None = None, municipality_id: int | None = None, with_pos: bool = True
) -> DataFrame:
    """Associations of each municipality (or of one, by ``season`` and ``municipality_id``) by
    name with farmer count, area, sacks and kg (raw sums); ``pos`` restarts per (season,
    municipality).  The ids become filters of the association scan, and only farmers of
    the associations found are aggregated."""
    if season is not None:
        tables = tables.season(season)
    if municipality_id is not None:
        own = tables.association.where(F.col("municipality_id") == municipality_id)
        keys = own.select("season", F.col("id").alias("association_id"))
        tables = tables.with_(association=own, farmer=tables.farmer.join(keys, ["season", "association_id"], "left_semi"))
    ar = association_rollup(tables).select(
        "season",
        "municipality_id",
        "id",
        "name",
        F.col("farmers").alias("farmer_count"),
        F.col("area").alias("total_area"),
        F.col("sacks").alias("total_sacks"),
        F.col("kg").alias("total_kg"),
    )
    return sequence_number(ar, ["name", "id"], partition_by=["season", "municipality_id"]) if with_pos else ar


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a total order: a look at a table."""
    return df.orderBy(*order).limit(n)


def municipality_totals(tables: Tables) -> DataFrame:
    """Municipality detail totals: association count (childless included), farmers,
    area, sacks, kg rounded, MT from the rounded kg."""
    r = municipality_rollup(tables)
    kg_r = r2("kg")
    return r.select(
        "season",
        "id",
        "name",
        F.col("associations").alias("association_count"),
        F.col("farmers").alias("total_farmers"),
        r2("area").alias("total_area"),
        r2("sacks").alias("total_sacks"),
        kg_r.alias("total_kg"),
        r2(kg_r / 1000.0).alias("total_mt"),
    )


def association_kpi(tables: Tables) -> DataFrame:
    """Association dashboard KPIs: MT = round(round(kg,2)/1000,2), yield = MT / rounded
    area when the area is positive."""
    r = association_rollup(tables)
    area_r = r2("area")
    kg_r = r2("kg")
    mt_r = r2(kg_r / 1000.0)
    return r.select(
        "season",
        "id",
        "name",
        F.col("farmers").alias("total_farmers"),
        area_r.alias("total_area"),
        r2("sacks").alias("total_sacks"),
        kg_r.alias("total_kg"),
        mt_r.alias("total_mt"),
        F.when(area_r > 0, r2(mt_r / area_r)).otherwise(F.lit(0.0)).alias("average_yield"),
    )


def top_variety(tables: Tables) -> DataFrame:
    """Per association: the variety with the largest positive production (blank or NULL
    variety counts as 'Unknown'); ties go to the variety seen first (lowest farmer id).
    Associations with no positive production get NULL and 0."""
    f = tables.farmer
    label = F.when(F.col("variety").isNull() | (F.col("variety") == ""), F.lit("Unknown")).otherwise(F.col("variety"))
    per_v = f.groupBy("season", "association_id", label.alias("variety")).agg(
        F.sum(F.coalesce("sacks", F.lit(0.0)) * F.coalesce("kg", F.lit(0.0))).alias("value"),
        F.min("id").alias("first_id"),
    )
    picks = first_by(
        per_v.where(F.col("value") > 0),
        ["season", "association_id"],
        [F.col("value"), -F.col("first_id")],
        ["variety", "value"],
    )
    a = tables.association
    j = a.join(picks, (a.season == picks.season) & (a.id == picks.association_id), "left")
    return j.select(
        a.season,
        a.id.alias("association_id"),
        a.name.alias("association"),
        picks.variety.alias("top_variety"),
        F.coalesce(picks.value, F.lit(0.0)).alias("top_value"),
    )


def variety_listing(variety: DataFrame) -> DataFrame:
    """Variety names in name order per season."""
    return sequence_number(variety.select("season", "id", "name"), ["name", "id"], partition_by=["season"])
