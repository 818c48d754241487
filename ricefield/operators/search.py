"""Searches, farmer lists and the filtered, paginated report.

Search terms are used as typed inside ``LIKE '%term%'`` (``%`` and ``_`` act as
wildcards), case-insensitive by default like the reference's default SQL backend;
``case_sensitive=True`` gives the other backend's behaviour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ricefield.functions.exprs import contains_any, display_or, full_name
from ricefield.operators.ranking import sequence_number
from ricefield.operators.trigram import FarmerIndex
from ricefield.session import stored
from ricefield.sources.model import FARMER, Tables

FARMER_COLS = [f.name for f in FARMER.fields]
PER_PAGE = 15  # fixed value: report page size
LIST_CAP = 100  # fixed value: farmer list size on the season pages
LIST_PARTS = 64  # parts of a season that are cut to the list size side by side


def _parents(tables: Tables):
    a = tables.association.select(
        F.col("season").alias("a_season"),
        F.col("id").alias("a_id"),
        F.col("municipality_id").alias("a_municipality_id"),
        F.col("name").alias("association"),
    )
    m = tables.municipality.select(
        F.col("season").alias("m_season"), F.col("id").alias("m_id"), F.col("name").alias("municipality")
    )
    return a, m


def _label(labels: dict[str, str]):
    expr = None
    for season, label in labels.items():
        expr = (F.when if expr is None else expr.when)(F.col("season") == season, F.lit(label))
    return expr.otherwise(F.col("season"))


def farmer_search(
    tables: Tables, term: str, labels: dict[str, str], case_sensitive: bool = False, index: FarmerIndex | None = None
) -> DataFrame:
    """Farmers of the labelled seasons whose RSBSA, last or first name contains ``term``,
    with association and municipality names (inner joins) and the season label.
    A blank term searches nothing (empty result).  With a trigram ``index`` of the farmers
    only its candidates are read and confirmed."""
    term = term.strip()
    f = tables.farmer if index is None or not term else index.candidates(term)
    f = f.where(F.col("season").isin(list(labels)))
    if not term:
        f = f.where(F.lit(False))
    else:
        f = f.where(contains_any(["rsbsa", "last_name", "first_name"], term, case_sensitive))
    a, m = _parents(tables)
    j = f.join(a, (f.season == a.a_season) & (f.association_id == a.a_id), "inner")
    j = j.join(m, (j.season == m.m_season) & (j.a_municipality_id == m.m_id), "inner")
    return j.select(*FARMER_COLS, "association", "municipality", _label(labels).alias("season_label"))


def farmer_by_id(tables: Tables, season: str, farmer_id: int) -> DataFrame:
    """The farmer row with this id in this season (none when there is none)."""
    return tables.farmer.where((F.col("season") == season) & (F.col("id") == farmer_id)).select(*FARMER_COLS)


def association_farmers(
    tables: Tables,
    term: str = "",
    case_sensitive: bool = False,
    season: str | None = None,
    association_id: int | None = None,
    with_pos: bool = True,
) -> DataFrame:
    """Farmer list of every existing association (or of one, by ``season`` and
    ``association_id``, which become filters of the scan), optionally filtered by ``term`` on
    RSBSA / last / first name, ordered by last name, first name (NULLs first), id;
    ``pos`` restarts per (season, association).  Adds per-row production
    (``total_kg`` = bags x kg per bag, missing factors as 0; ``total_mt``) and display
    columns with '-' for a blank RSBSA or middle name.  ``with_pos=False`` leaves out the
    position (and the sort and checkpoint that it needs)."""
    term = term.strip()
    f, a = tables.farmer, tables.association
    if season is not None:
        f, a = f.where(F.col("season") == season), a.where(F.col("season") == season)
    if association_id is not None:
        f, a = f.where(F.col("association_id") == association_id), a.where(F.col("id") == association_id)
    if term:
        f = f.where(contains_any(["rsbsa", "last_name", "first_name"], term, case_sensitive))
    a = a.select(F.col("season").alias("a_season"), F.col("id").alias("a_id"))
    f = f.join(a, (f.season == a.a_season) & (f.association_id == a.a_id), "left_semi")
    order = [F.asc_nulls_first("last_name"), F.asc_nulls_first("first_name"), "id"]
    per_row_kg = F.coalesce(F.col("sacks"), F.lit(0.0)) * F.coalesce(F.col("kg"), F.lit(0.0))
    rows = f.select(
        *FARMER_COLS,
        per_row_kg.alias("total_kg"),
        (per_row_kg / 1000.0).alias("total_mt"),
        display_or("rsbsa").alias("rsbsa_display"),
        display_or("middle_name").alias("middle_name_display"),
    )
    return sequence_number(rows, order, partition_by=["season", "association_id"]) if with_pos else rows


def farmer_list(tables: Tables, limit: int = LIST_CAP) -> DataFrame:
    """First ``limit`` farmers per season by last name, first name, id, with association
    and municipality names (left joins keep orphans).  The limit runs before the joins in
    two steps, whatever its size: the first ``limit`` of each of ``LIST_PARTS`` parts of a
    season, then the first ``limit`` of these."""
    order = [F.asc_nulls_first("last_name"), F.asc_nulls_first("first_name"), "id"]
    part = F.pmod(F.xxhash64("id"), F.lit(LIST_PARTS))
    some = tables.farmer.withColumn("_part", part)
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("season", "_part").orderBy(*order)))
    some = some.where(F.col("_rank") <= limit).drop("_part", "_rank")
    top = some.withColumn("pos", F.row_number().over(Window.partitionBy("season").orderBy(*order)).cast("long")).where(F.col("pos") <= limit)
    a, m = _parents(tables)
    j = top.join(a, (top.season == a.a_season) & (top.association_id == a.a_id), "left")
    j = j.join(m, (j.a_season == m.m_season) & (j.a_municipality_id == m.m_id), "left")
    return j.select(
        *FARMER_COLS, F.col("association").alias("association_name"), F.col("municipality").alias("municipality_name"), "pos"
    )


# ------------------------------------------------------------------------ report

REPORT_LABELS = {"wet": "Wet", "dry": "Dry"}


def report_seasons(season: str, labels: dict[str, str]) -> list[str]:
    season = (season or "all").lower()
    if season == "all":
        return list(labels)
    if season in labels:
        return [season]
    raise ValueError(f"unknown season {season!r}: expected 'all' or one of {sorted(labels)}")


def parse_page(page) -> int:
    """``int(page)``; a value that is not an integer gives page 1."""
    try:
        return int(page)
    except (TypeError, ValueError):
        return 1


def report_rows(
    tables: Tables,
    season: str = "all",
    municipality: str = "",
    search: str = "",
    labels: dict[str, str] | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """The report's filtered record set (before paging).

    Columns: season (label), id, farmer_name, municipality, association,
    area_hectares, estimated_yield_tons, status.
    """
    labels = labels or REPORT_LABELS
    seasons = report_seasons(season, labels)
    t = tables.season(*seasons)
    f = t.farmer
    a, m = _parents(t)
    j = f.join(a, (f.season == a.a_season) & (f.association_id == a.a_id), "inner")
    j = j.join(m, (j.season == m.m_season) & (j.a_municipality_id == m.m_id), "inner")
    rows = j.select(
        _label(labels).alias("season"),
        F.col("id"),
        full_name().alias("farmer_name"),
        F.col("municipality"),
        F.col("association"),
        F.coalesce(F.col("area"), F.lit(0.0)).alias("area_hectares"),
        (F.coalesce(F.col("sacks") * F.col("kg"), F.lit(0.0)) / 1000.0).alias("estimated_yield_tons"),
        F.lit("Active").alias("status"),
    )
    municipality = (municipality or "").strip()
    search = (search or "").strip()
    if municipality:
        rows = rows.where(contains_any(["municipality"], municipality, case_sensitive))
    if search:
        rows = rows.where(contains_any(["farmer_name", "association"], search, case_sensitive))
    return rows


def report_stats(rows: DataFrame) -> DataFrame:
    from ricefield.functions.exprs import r2

    return rows.agg(
        F.count(F.lit(1)).alias("total_records"),
        r2(F.coalesce(F.sum("area_hectares"), F.lit(0.0))).alias("total_area"),
        r2(F.coalesce(F.sum("estimated_yield_tons"), F.lit(0.0))).alias("total_yield"),
    )


def report_page(rows: DataFrame, page, per_page: int = PER_PAGE) -> DataFrame:
    """One page in farmer-name order (ties by season label, id); ``pos`` is the absolute
    position.  Plans as a top-(offset+limit) per partition (TakeOrderedAndProject)."""
    page = parse_page(page)
    offset = max(page - 1, 0) * per_page
    order = [F.asc_nulls_first("farmer_name"), "season", "id"]
    top = rows.orderBy(*order).offset(offset).limit(per_page)
    w = Window.orderBy(*order)  # over at most ``per_page`` rows
    return top.withColumn("pos", (F.row_number().over(w) + F.lit(offset)).cast("long"))


# ------------------------------------------------------- pages of a ranked report


@dataclass
class RankedReport:
    """Report rows written once in order, in ranges; ``ranges`` is the histogram of the order:
    (range, rows in it, rows before it), one entry per range partition."""

    rows: DataFrame
    ranges: list[tuple[int, int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.ranges)

    def page(self, page, per_page: int = PER_PAGE) -> DataFrame:
        """The same rows as ``report_page``, at a cost that does not grow with the page's
        number: the histogram says which ranges hold the page and at which places in them,
        so only those folders are opened and only the row groups with these places read."""
        first = max(parse_page(page) - 1, 0) * per_page
        here, pos = F.lit(False), F.lit(None).cast("long")
        for r, n, before in self.ranges:
            low, high = max(first - before, 0), min(first + per_page - before, n) - 1
            if low <= high:
                mine = F.col("order_range") == r
                here = here | (mine & F.col("place").between(low, high))
                pos = F.when(mine, F.col("place") + F.lit(before + 1)).otherwise(pos)
        return self.rows.where(here).withColumn("pos", pos.cast("long")).drop("order_range", "place").orderBy("pos")

    def page_info(self, page, per_page: int = PER_PAGE) -> DataFrame:
        """Paging metadata from the histogram alone."""
        stats = self.rows.sparkSession.createDataFrame([(self.total,)], "total_records long")
        return report_page_info(stats, page, per_page)


def rank_report(rows: DataFrame, ranges: int | None = None) -> RankedReport:
    """Deal report rows out by ranges of their order, sort each range and write it, with its
    number and each row's place in it, below the checkpoint folder."""
    order = [F.asc_nulls_first("farmer_name"), F.col("season"), F.col("id")]
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("order_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place")
    )
    written = stored(placed, "report", partition_by=["order_range"])
    counted = written.groupBy("order_range").agg(F.count(F.lit(1)).alias("n")).orderBy("order_range").collect()
    histogram, before = [], 0
    for r in counted:
        histogram.append((r["order_range"], r["n"], before))
        before += r["n"]
    return RankedReport(written, histogram)


def report_page_info(stats: DataFrame, page, per_page: int = PER_PAGE) -> DataFrame:
    page = parse_page(page)
    n = F.col("total_records")
    total_pages = F.when(n > 0, F.ceil(n / F.lit(per_page))).otherwise(F.lit(1)).cast("long")
    return stats.select(
        F.lit(page).cast("long").alias("page"),
        F.lit(per_page).cast("long").alias("per_page"),
        total_pages.alias("total_pages"),
        n.alias("total_records"),
        (F.lit(page) < total_pages).alias("has_next"),
        (F.lit(page) > 1).alias("has_prev"),
    )


def municipality_names(tables: Tables) -> DataFrame:
    """Distinct non-blank municipality names of all seasons, exact case, by name."""
    names = (
        tables.municipality.select("name")
        .where(F.col("name").isNotNull() & (F.col("name") != ""))
        .distinct()
    )
    return sequence_number(names, ["name"])


def total_pages(n: int, per_page: int = PER_PAGE) -> int:
    return math.ceil(n / per_page) if n > 0 else 1


@dataclass
class ReportView:
    stats: DataFrame
    page: DataFrame
    page_info: DataFrame
    municipalities: DataFrame
    rows: DataFrame

    def close(self) -> None:
        """Give the cached rows back."""
        self.rows.unpersist()


def report(
    tables: Tables,
    season: str = "all",
    municipality: str = "",
    search: str = "",
    page=1,
    labels: dict[str, str] | None = None,
    case_sensitive: bool = False,
) -> ReportView:
    """Everything the report page shows, from one filtered record set: statistics, the
    page, paging metadata and the municipality list.  The filtered set is cached
    (it is recomputed deterministically if lost), so statistics and page do not each
    redo the joins and filters; ``close`` on the result drops the cache."""
    rows = report_rows(tables, season, municipality, search, labels, case_sensitive).persist()
    stats = report_stats(rows)
    return ReportView(
        stats=stats,
        page=report_page(rows, page),
        page_info=report_page_info(stats, page),
        municipalities=municipality_names(tables),
        rows=rows,
    )
