"""Season-over-season comparison of municipalities and associations.

Municipalities are matched on the Python-style key ``name.strip().lower()``: within a
season the row with the highest id wins for equal keys (dict assignment, last wins);
the display name comes from the base season if the key is there, else from the first
(lowest id) current-season row.  Associations are matched on the SQL key
``(LOWER(TRIM(municipality)), LOWER(TRIM(association)))`` with a full outer join that
keeps many-to-many matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricefield.functions.exprs import change_marker, mt, pct_change, py_key, r2, ratio0, ratio_pos, sql_key
from ricefield.operators.ranking import sequence_number
from ricefield.operators.rollups import association_rollup, municipality_rollup
from ricefield.sources.model import Tables


# List order of the comparison: current MT descending, then the merge's insertion
# order (base-season keys first by lowest id, then current-only keys).
def _list_order():
    return [F.desc("current_mt"), F.asc("src_rank"), F.asc("src_id")]


def municipality_comparison(tables: Tables, base: str, current: str) -> DataFrame:
    """One row per municipality key: both seasons' associations, farmers, area, MT,
    the MT difference and percent change, and ``pos`` = rank by current MT descending
    (stable: base-season keys first in id order, then current-only keys)."""
    ranked = sequence_number(municipality_merge(tables, base, current), _list_order())
    return ranked.drop("src_rank", "src_id")


def municipality_merge(tables: Tables, base: str, current: str) -> DataFrame:
    """The comparison rows without positions; ``src_rank``/``src_id`` carry the
    insertion order that breaks ties in the list order.

    The merge is one aggregation by key over both seasons' rollup rows (a pivot, not a
    join): per season the highest-id row's values (last wins), the lowest id, and for
    the current season the lowest-id row's name.
    """
    r = municipality_rollup(tables.season(base, current))
    side = r.select(
        "season",
        "id",
        py_key("name").alias("key"),
        F.struct(
            "name", "associations", "farmers", r2("area").alias("area"), r2(mt("kg")).alias("mt")
        ).alias("vals"),
    )
    in_b = F.col("season") == base
    in_c = F.col("season") == current
    per_key = side.groupBy("key").agg(
        F.max_by("vals", F.when(in_b, F.col("id"))).alias("b"),
        F.max_by("vals", F.when(in_c, F.col("id"))).alias("c"),
        F.min_by("vals.name", F.when(in_c, F.col("id"))).alias("c_first_name"),
        F.min(F.when(in_b, F.col("id"))).alias("b_first_id"),
        F.min(F.when(in_c, F.col("id"))).alias("c_first_id"),
    )
    in_base = F.col("b_first_id").isNotNull()
    zero_l = F.lit(0).cast("long")
    out = per_key.select(
        F.when(in_base, F.col("b.name")).otherwise(F.col("c_first_name")).alias("municipality"),
        F.coalesce(F.col("b.associations"), zero_l).alias("base_associations"),
        F.coalesce(F.col("c.associations"), zero_l).alias("current_associations"),
        F.coalesce(F.col("b.farmers"), zero_l).alias("base_farmers"),
        F.coalesce(F.col("c.farmers"), zero_l).alias("current_farmers"),
        F.coalesce(F.col("b.area"), F.lit(0.0)).alias("base_area"),
        F.coalesce(F.col("c.area"), F.lit(0.0)).alias("current_area"),
        F.coalesce(F.col("b.mt"), F.lit(0.0)).alias("base_mt"),
        F.coalesce(F.col("c.mt"), F.lit(0.0)).alias("current_mt"),
        F.when(in_base, F.lit(0)).otherwise(F.lit(1)).alias("src_rank"),
        F.coalesce(F.col("b_first_id"), F.col("c_first_id")).alias("src_id"),
    )
    return out.select(
        "*",
        r2(F.col("current_mt") - F.col("base_mt")).alias("difference"),
        pct_change("base_mt", "current_mt").alias("change"),
    )


def municipality_yield(comparison: DataFrame) -> DataFrame:
    """Comparison rows with both seasons' yield (MT per hectare of the rounded values,
    0 when no area) and the change marker."""

    def y(m, a):
        return F.when(F.col(a) > 0, r2(F.col(m) / F.col(a))).otherwise(F.lit(0.0))

    return comparison.select(
        "pos",
        "municipality",
        y("base_mt", "base_area").alias("base_yield"),
        y("current_mt", "current_area").alias("current_yield"),
        "change",
        change_marker("change").alias("change_marker"),
    )


# The three highlight metrics, in the reference's order.
HIGHLIGHT_METRICS = ["production", "yield", "area"]


def top_performers(comparison: DataFrame, base: str, current: str) -> DataFrame:
    """Six highlights: highest production, highest yield, largest area, for each season.

    A pick is the first maximum in list order.  ``comparison`` is either the ranked
    comparison (``pos``) or ``municipality_merge`` output, whose list-order keys break
    ties directly (no global ranking needed).  One aggregate over an unpivot of the
    metrics; with no municipalities every pick is '-' with zeros.
    """
    spark = comparison.sparkSession
    sides = []
    for side, season in (("base", base), ("current", current)):
        m, a = F.col(f"{side}_mt"), F.col(f"{side}_area")
        for metric, value in (("production", m), ("yield", ratio_pos(m, a)), ("area", a)):
            sides.append(
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.lit(season).alias("season"),
                    value.cast("double").alias("value"),
                    m.alias("mt"),
                    a.alias("area"),
                )
            )
    if "pos" in comparison.columns:
        tie = [-F.col("pos")]
    else:  # later in list order = smaller current MT, then larger src_rank / src_id
        tie = [F.col("current_mt"), -F.col("src_rank"), -F.col("src_id")]
    keep = ["pos"] if "pos" in comparison.columns else ["current_mt", "src_rank", "src_id"]
    long = comparison.select(*keep, "municipality", F.explode(F.array(*sides)).alias("x")).select(
        *keep, "municipality", "x.*"
    )
    picks = long.groupBy("metric", "season").agg(
        F.max_by(F.struct("municipality", "value", "mt", "area"), F.struct(F.col("value"), *tie)).alias("p")
    )
    slots = spark.createDataFrame(
        [(mt_, s, i * 2 + j) for i, mt_ in enumerate(HIGHLIGHT_METRICS) for j, s in enumerate((base, current))],
        "metric string, season string, slot int",
    )
    j = slots.join(picks, ["metric", "season"], "left")
    return j.select(
        "metric",
        "season",
        F.coalesce(F.col("p.municipality"), F.lit("-")).alias("municipality"),
        F.coalesce(F.col("p.value"), F.lit(0.0)).alias("value"),
        F.coalesce(F.col("p.mt"), F.lit(0.0)).alias("mt"),
        F.coalesce(F.col("p.area"), F.lit(0.0)).alias("area"),
        (F.col("season") == current).alias("headline"),
    )


def _keyed_associations(tables: Tables, seasons: list[str]) -> DataFrame:
    t = tables.season(*seasons)
    ar = association_rollup(t)
    m = t.municipality.select(F.col("season").alias("m_season"), F.col("id").alias("m_id"), F.col("name").alias("municipality"))
    j = ar.join(m, (ar.season == m.m_season) & (ar.municipality_id == m.m_id), "inner")
    return j.select(
        F.col("season"),
        F.col("id"),
        F.col("municipality"),
        sql_key("municipality").alias("mkey"),
        F.col("name").alias("association"),
        sql_key("name").alias("akey"),
        F.col("farmers"),
        F.col("area"),
        mt("kg").alias("mt"),
    )


def association_comparison(tables: Tables, base: str, current: str) -> DataFrame:
    """Associations of both seasons matched on (municipality key, association key).

    Unmatched associations of either season are kept with zeros on the other side.
    ``pos`` orders by municipality, base name, current name (NULLs first), ids.
    Yield = round(unrounded MT / unrounded area, 2), 0 without area.
    """
    keyed = _keyed_associations(tables, [base, current])
    b = keyed.where(F.col("season") == base).alias("b")
    c = keyed.where(F.col("season") == current).alias("c")
    on = (F.col("b.mkey") == F.col("c.mkey")) & (F.col("b.akey") == F.col("c.akey"))
    # a left join and an anti join: AQE can split a hot key in both, not in a full outer join
    matched = b.join(c, on, "left").select(F.struct("b.*").alias("b"), F.when(F.col("c.id").isNotNull(), F.struct("c.*")).alias("c"))
    only_c = c.join(b, on, "left_anti").select(F.struct("c.*").alias("c"))
    j = matched.unionByName(only_c, allowMissingColumns=True)
    out = j.select(
        F.coalesce(F.col("b.municipality"), F.col("c.municipality")).alias("municipality"),
        F.col("b.association").alias("base_association"),
        F.col("c.association").alias("current_association"),
        F.coalesce(F.col("b.farmers"), F.lit(0).cast("long")).alias("base_farmers"),
        F.coalesce(F.col("c.farmers"), F.lit(0).cast("long")).alias("current_farmers"),
        r2(F.coalesce(F.col("b.area"), F.lit(0.0))).alias("base_area"),
        r2(F.coalesce(F.col("c.area"), F.lit(0.0))).alias("current_area"),
        ratio0(F.coalesce(F.col("b.mt"), F.lit(0.0)), F.coalesce(F.col("b.area"), F.lit(0.0))).alias("base_yield"),
        ratio0(F.coalesce(F.col("c.mt"), F.lit(0.0)), F.coalesce(F.col("c.area"), F.lit(0.0))).alias("current_yield"),
        F.col("b.id").alias("base_id"),
        F.col("c.id").alias("current_id"),
    )
    order = [
        F.asc_nulls_first("municipality"),
        F.asc_nulls_first("base_association"),
        F.asc_nulls_first("current_association"),
        F.asc_nulls_first("base_id"),
        F.asc_nulls_first("current_id"),
    ]
    return sequence_number(out, order)


@dataclass
class Dashboard:
    summary: DataFrame
    averages: DataFrame
    change: DataFrame
    overall: DataFrame
    municipalities: DataFrame
    associations: DataFrame
    highlights: DataFrame
    totals: DataFrame

    def close(self) -> None:
        """Give the cached totals back."""
        self.totals.unpersist()


def dashboard(tables: Tables, base: str, current: str) -> Dashboard:
    """Everything the dashboard shows, from one scan of the farmers: their totals per
    association are cached (and recomputed if lost), and all results read these."""
    from ricefield.operators import rollups

    totals = rollups.association_totals(tables.season(base, current).farmer).persist()
    t = tables.season(base, current).with_(totals=totals)
    merged = municipality_merge(t, base, current)
    return Dashboard(
        summary=rollups.season_summary(t, [base, current]),
        averages=rollups.season_averages(t, [base, current]),
        change=rollups.season_change(t, base, current),
        overall=rollups.overall_totals(t, base, current),
        municipalities=municipality_comparison(t, base, current),
        associations=association_comparison(t, base, current),
        highlights=top_performers(merged, base, current),
        totals=totals,
    )
