"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query builds the model tables from the driver's tables (``sources.driver_tables``,
a pure re-mapping of columns) and runs one library operator over the whole tables.
Seasons: base = 'wet', current = 'dry'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.operators import changes, compare, ingest, replay, rollups, search, totals, trigram
from ricefield.sinks import exports
from ricefield.sources import driver_tables as dt
from ricefield.sources.model import SEED_VARIETIES

BASE, CURRENT = "wet", "dry"
SEASONS = [BASE, CURRENT]
# Season labels used by the dashboard search.
SEARCH_LABELS = {"wet": "Wet 2026", "dry": "Dry 2027"}

# Parameters of the parameterised queries (also used by the oracle SQL).
FARMER_SEARCH_TERM = "r-4_-"
INDEXED_SEARCH_TERM = "customer#0000001%7"
ASSOCIATION_SEARCH_TERM = "urgent"
REPORT_SEASON = "all"
REPORT_MUNICIPALITY = "nation_1"
REPORT_SEARCH = "customer#00000"
REPORT_PAGE = 3
UPLOAD_SCOPES = {"wet": "season", "dry": "association"}


def _t(spark: SparkSession, sf_dir: str, with_variety: bool = False):
    """The stand-in model tables as lazy DataFrames."""
    return dt.model_tables(spark, sf_dir, with_variety=with_variety)


# ----------------------------------------------------------------- rollups


def season_summary(spark, sf_dir):
    return rollups.season_summary(_t(spark, sf_dir), SEASONS)


def season_dashboard(spark, sf_dir):
    return rollups.season_dashboard(_t(spark, sf_dir), SEASONS)


def season_averages(spark, sf_dir):
    return rollups.season_averages(_t(spark, sf_dir), SEASONS)


def season_change(spark, sf_dir):
    return rollups.season_change(_t(spark, sf_dir), BASE, CURRENT)


def overall_totals(spark, sf_dir):
    return rollups.overall_totals(_t(spark, sf_dir), BASE, CURRENT)


def municipality_rollup(spark, sf_dir):
    return rollups.municipality_summary(_t(spark, sf_dir))


def municipality_listing(spark, sf_dir):
    return rollups.municipality_listing(_t(spark, sf_dir))


def association_listing(spark, sf_dir):
    return rollups.association_listing(_t(spark, sf_dir))


def association_listing_newest(spark, sf_dir):
    return rollups.association_listing(_t(spark, sf_dir), newest_first=True)


def association_rollup(spark, sf_dir):
    return rollups.municipality_associations(_t(spark, sf_dir))


def municipality_totals(spark, sf_dir):
    return rollups.municipality_totals(_t(spark, sf_dir))


def association_kpi(spark, sf_dir):
    return rollups.association_kpi(_t(spark, sf_dir))


def top_variety(spark, sf_dir):
    return rollups.top_variety(_t(spark, sf_dir))


def variety_listing(spark, sf_dir):
    return rollups.variety_listing(_t(spark, sf_dir, with_variety=True).variety)


# -------------------------------------------------------------- comparison


def municipality_comparison(spark, sf_dir):
    return compare.municipality_comparison(_t(spark, sf_dir), BASE, CURRENT)


def municipality_yield(spark, sf_dir):
    return compare.municipality_yield(compare.municipality_comparison(_t(spark, sf_dir), BASE, CURRENT))


def top_performers(spark, sf_dir):
    merged = compare.municipality_merge(_t(spark, sf_dir), BASE, CURRENT)
    return compare.top_performers(merged, BASE, CURRENT)


def association_comparison(spark, sf_dir):
    return compare.association_comparison(_t(spark, sf_dir), BASE, CURRENT)


# ------------------------------------------------------------------ search


def farmer_search(spark, sf_dir):
    return search.farmer_search(_t(spark, sf_dir), FARMER_SEARCH_TERM, SEARCH_LABELS)


def farmer_search_indexed(spark, sf_dir):
    """The same search, and one for a longer term, through a trigram index."""
    t = _t(spark, sf_dir)
    index = trigram.build_index(t.farmer)
    found = [
        search.farmer_search(t, term, SEARCH_LABELS, index=index).withColumn("term", F.lit(term))
        for term in (FARMER_SEARCH_TERM, INDEXED_SEARCH_TERM)
    ]
    return found[0].unionByName(found[1])


def association_farmer_search(spark, sf_dir):
    return search.association_farmers(_t(spark, sf_dir), ASSOCIATION_SEARCH_TERM)


# One association, one municipality and one farmer, by id.
ONE_ASSOCIATION, ONE_MUNICIPALITY, ONE_FARMER = ("wet", 7), ("dry", 3), ("wet", 3)


def association_farmers_one(spark, sf_dir):
    season, i = ONE_ASSOCIATION
    return search.association_farmers(_t(spark, sf_dir), season=season, association_id=i)


def municipality_associations_one(spark, sf_dir):
    season, i = ONE_MUNICIPALITY
    return rollups.municipality_associations(_t(spark, sf_dir), season, i)


def farmer_by_id(spark, sf_dir):
    return search.farmer_by_id(_t(spark, sf_dir), *ONE_FARMER)


def association_sample(spark, sf_dir):
    """The first five associations by season and id."""
    return rollups.first_rows(_t(spark, sf_dir).association, ["season", "id"])


def farmer_top100(spark, sf_dir):
    return search.farmer_list(_t(spark, sf_dir))


def _report_rows(spark, sf_dir):
    return search.report_rows(
        _t(spark, sf_dir), season=REPORT_SEASON, municipality=REPORT_MUNICIPALITY, search=REPORT_SEARCH
    )


def report_stats(spark, sf_dir):
    return search.report_stats(_report_rows(spark, sf_dir))


def report_page(spark, sf_dir):
    return search.report_page(_report_rows(spark, sf_dir), REPORT_PAGE)


def report_pages_ranked(spark, sf_dir):
    """Pages 1 and 3, the last one and the one after it, of a report ranked once."""
    ranked = search.rank_report(_report_rows(spark, sf_dir))
    last = search.total_pages(ranked.total)
    out = None
    for page in sorted({1, 3, last, last + 1}):
        rows = ranked.page(page).withColumn("page", F.lit(page).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_stats_wet(spark, sf_dir):
    """The report of one season."""
    return search.report_stats(search.report_rows(_t(spark, sf_dir), season="wet", search=REPORT_SEARCH))


def report_page_info(spark, sf_dir):
    return search.report_page_info(search.report_stats(_report_rows(spark, sf_dir)), REPORT_PAGE)


def municipality_names(spark, sf_dir):
    return search.municipality_names(_t(spark, sf_dir))


# ------------------------------------------------------------------ upload


def _classified(spark, sf_dir, ids=True):
    raw = dt.upload_rows(spark, sf_dir)
    cleaned = ingest.clean_upload(raw, template="full", keep=["season", "association_id", "line"])
    existing = dt.existing_farmers(spark, sf_dir)
    # wet dedupes RSBSA over the whole season, dry within the target association
    # the cleaned upload is checkpointed once (durable=True): it is read by the key
    # count, the key aggregate and the join, and is small next to the table
    return ingest.classify_upload(cleaned, existing, ["line"], scope=UPLOAD_SCOPES, durable=True, ids=ids)


def upload_classified(spark, sf_dir):
    return _classified(spark, sf_dir).drop("key", "skipped")


def upload_summary(spark, sf_dir):
    return ingest.upload_summary(_classified(spark, sf_dir, ids=False))


def upload_apply(spark, sf_dir):
    """Farmer table after the upload (existing and inserted rows)."""
    table = ingest.apply_upload(dt.existing_farmers(spark, sf_dir), _classified(spark, sf_dir))
    return changes.table_rows({"farmer": table})


def _sheets(spark, sf_dir, root, names):
    """The upload rows as CSV files below a preferred sub-folder: one folder for every value
    of line % 3, each with its columns in another order."""
    raw = dt.upload_rows(spark, sf_dir)
    if names:
        raw = raw.select("season", "association_id", "line", *[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    columns = raw.columns
    for k in range(3):
        out = raw.where(F.col("line") % 3 == k).select(*[F.col(f"`{c}`") for c in columns[k * 5 :] + columns[: k * 5]])
        writer = out.write.option("header", True).option("escape", '"').option("emptyValue", "")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/sheets/NRP DISTRIBUTION/{k}")
    return f"{root}/sheets"


def _read_sheets(spark, sf_dir, template, names=None):
    from ricefield.sinks.tables import work_dir

    raw = ingest.read_upload(spark, _sheets(spark, sf_dir, work_dir(spark), names), template=template)
    cleaned = ingest.clean_upload(raw, template=template, keep=["season", "association_id", "line"])
    return cleaned.withColumn("association_id", F.col("association_id").cast("long")).withColumn("line", F.col("line").cast("long"))


def upload_csv(spark, sf_dir):
    """The upload read from CSV files with different column orders, classified."""
    cleaned = _read_sheets(spark, sf_dir, "full")
    classified = ingest.classify_upload(cleaned, dt.existing_farmers(spark, sf_dir), ["line"], scope=UPLOAD_SCOPES)
    return classified.drop("key", "skipped")


# Headers of the short template and the sheet columns that stand under them here.
SHORT_SHEET = {
    " FFRS RSBSA Number": "RSBSA",
    "Farmer Last Name ": "LastName",
    "FARMER FIRST NAME": " First Name",
    "Farmer Middle Name": "Middle Name",
    "Farmer Ext Name": "Suffix",
    "Seed Variety Claimed": "Variety",
    "Claimed Area (ha)": "Area",
    "Average Weight per Bag (kg) - for all variety(ies)": "KG",
    "Total Production (no. of bags) - for all variety(ies)": "Sacks",
}


def upload_short(spark, sf_dir):
    """The short template, read from CSV files and cleaned."""
    return _read_sheets(spark, sf_dir, "short", SHORT_SHEET).drop("key")


def upload_commit(spark, sf_dir):
    """Run the upload job on written CSV files against a store: the farmer table afterwards."""
    from ricefield.sinks import tables as tj
    from ricefield.sources.model import read_table

    root = tj.work_dir(spark)
    tj.write_staged(spark, _t(spark, sf_dir).with_(farmer=dt.existing_farmers(spark, sf_dir)), f"{root}/live")
    ingest.run_upload(spark, _sheets(spark, sf_dir, root, None), f"{root}/live", scope=UPLOAD_SCOPES)
    # ids follow the order of the files, which writers may name as they like
    farmer = read_table(spark, f"{root}/live", "farmer")
    return farmer.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


# ------------------------------------------------------------- change-sets


def insert_farmers(spark, sf_dir):
    existing = dt.existing_farmers(spark, sf_dir)
    proposals = changes.form_rows(dt.form_inserts(spark, sf_dir))
    _, outcome = changes.insert_farmers(existing, proposals, order=["line"], association=_t(spark, sf_dir).association)
    return outcome


def insert_farmers_table(spark, sf_dir):
    """The farmer table after the insertions."""
    existing = dt.existing_farmers(spark, sf_dir)
    proposals = changes.form_rows(dt.form_inserts(spark, sf_dir))
    table, _ = changes.insert_farmers(existing, proposals, order=["line"], association=_t(spark, sf_dir).association)
    return table


def update_farmers(spark, sf_dir):
    edits = changes.form_rows(dt.edit_rows(spark, sf_dir))
    table, _ = changes.update_farmers(dt.farmer(spark, sf_dir), edits, order=["line"])
    return table


def update_farmer_outcomes(spark, sf_dir):
    edits = changes.form_rows(dt.edit_rows(spark, sf_dir))
    _, outcome = changes.update_farmers(dt.farmer(spark, sf_dir), edits, order=["line"])
    return outcome


def delete_farmers(spark, sf_dir):
    t = _t(spark, sf_dir)
    table, _ = changes.delete_farmers(t.farmer, dt.farmer_deletions(spark, sf_dir))
    return changes.table_rows({"farmer": table})


def delete_association_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    out, _ = changes.delete_associations(t, dt.association_deletions(spark, sf_dir))
    return changes.table_rows(dict(out.items()))


def delete_municipality_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    out, _ = changes.delete_municipalities(t, dt.municipality_deletions(spark, sf_dir))
    return changes.table_rows(dict(out.items()))


def add_associations_unique(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.add_associations(
        t.association, dt.association_proposals(spark, sf_dir), ["src", "line"], unique=True, municipality=t.municipality
    )
    return outcome


def add_associations(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.add_associations(
        t.association, dt.association_proposals(spark, sf_dir), ["src", "line"], unique=False, municipality=t.municipality
    )
    return outcome


def rename_associations_unique(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.rename_associations(t.association, dt.association_renames(spark, sf_dir), ["line"], unique=True)
    return outcome


def rename_associations(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.rename_associations(t.association, dt.association_renames(spark, sf_dir), ["line"], unique=False)
    return outcome


def add_associations_table(spark, sf_dir):
    """The association table after the unique additions."""
    t = _t(spark, sf_dir)
    table, _ = changes.add_associations(
        t.association, dt.association_proposals(spark, sf_dir), ["src", "line"], unique=True, municipality=t.municipality
    )
    return table


def rename_associations_table(spark, sf_dir):
    """The association table after the unique renames."""
    t = _t(spark, sf_dir)
    table, _ = changes.rename_associations(t.association, dt.association_renames(spark, sf_dir), ["line"], unique=True)
    return table


def _association_changes(spark, sf_dir):
    return replay.change_associations(_t(spark, sf_dir), dt.association_requests(spark, sf_dir), ["line"])


def rename_associations_ordered(spark, sf_dir):
    """Outcomes of an ordered batch of additions, renames and deletions: names that a
    request frees or takes count for the next one."""
    return _association_changes(spark, sf_dir)[1]


def rename_associations_ordered_table(spark, sf_dir):
    """Associations and farmers after that batch."""
    out, _ = _association_changes(spark, sf_dir)
    return changes.table_rows({"association": out.association, "farmer": out.farmer})


def add_municipalities(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.add_municipalities(t.municipality, dt.municipality_proposals(spark, sf_dir), ["src", "line"], unique=False)
    return outcome


def add_municipalities_unique(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.add_municipalities(t.municipality, dt.municipality_proposals(spark, sf_dir), ["src", "line"], unique=True)
    return outcome


def rename_municipalities(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, outcome = changes.rename_municipalities(t.municipality, dt.municipality_renames(spark, sf_dir), ["line"])
    return outcome


def seed_varieties(spark, sf_dir):
    t = _t(spark, sf_dir, with_variety=True)
    table, _ = changes.seed_varieties(t.variety, SEED_VARIETIES, SEASONS)
    return table


# ----------------------------------------------------------------- exports


def template_export(spark, sf_dir):
    return exports.template_rows(_t(spark, sf_dir).farmer)


def short_export(spark, sf_dir):
    t = _t(spark, sf_dir)
    return exports.short_rows(t.farmer, t.association)


def template_export_files(spark, sf_dir):
    """The template export as written to files, read back."""
    from ricefield.sinks.tables import work_dir

    path = f"{work_dir(spark)}/template"
    exports.write_template_export(exports.template_rows(_t(spark, sf_dir).farmer, with_pos=False), path)
    return exports.read_written(spark, path, exports.TEMPLATE_EXPORT, "season string, association_id long")


def short_export_files(spark, sf_dir):
    """The short export as written to files, read back; some associations of different
    municipalities share a name."""
    from ricefield.sinks.tables import work_dir

    t, path = _t(spark, sf_dir), f"{work_dir(spark)}/short"
    renamed = t.association.withColumn("name", F.when(F.col("id") % 4 == 0, F.lit("Rice One")).otherwise(F.col("name")))
    exports.write_short_export(exports.short_rows(t.farmer, renamed, with_pos=False), path)
    return exports.read_written(spark, path, exports.SHORT_EXPORT, "season string, association_id long, file_stem string")


# ------------------------------------------------------------ table jobs


def _live(spark, sf_dir):
    """Write the stand-in model tables to a fresh work folder (staged commit)."""
    from ricefield.sinks import tables as tj

    root = tj.work_dir(spark)
    live = f"{root}/live"
    tj.write_staged(spark, _t(spark, sf_dir, with_variety=True), live)
    return tj, root, live


def snapshot_restore(spark, sf_dir):
    """Snapshot the tables, delete region-2 municipalities (cascade), restore the
    snapshot: all rows after the restore."""
    from ricefield.sources.model import read_tables

    tj, root, live = _live(spark, sf_dir)
    ts = tj.snapshot(spark, live, f"{root}/snapshots")
    t = read_tables(spark, live)
    changed, _ = changes.delete_municipalities(t, dt.municipality_deletions(spark, sf_dir))
    tj.write_staged(spark, changed, live, verify=False)
    tj.restore(spark, f"{root}/snapshots", ts, live)
    return changes.table_rows(dict(read_tables(spark, live).items()))


def snapshot_pinned(spark, sf_dir):
    """The same with a snapshot that writes no rows: all rows after the restore."""
    from ricefield.sources.model import read_tables

    tj, root, live = _live(spark, sf_dir)
    ts = tj.snapshot(spark, live, f"{root}/snapshots", copy=False)
    totals.commit_with_totals(spark, live, totals.deleting_municipalities(dt.municipality_deletions(spark, sf_dir)))
    tj.restore(spark, f"{root}/snapshots", ts, live)
    return changes.table_rows(dict(read_tables(spark, live).items()))


def snapshot_names(spark, sf_dir):
    """The snapshot name of every order's moment (its date and time taken as UTC)."""
    from ricefield.sinks.tables import snapshot_name

    orders = dt.orders(spark, sf_dir)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate)")
    return orders.select("o_orderkey", snapshot_name(F.timestamp_micros(micros)).alias("snapshot"))


def update_farmers_committed(spark, sf_dir):
    """Edits of one season committed to a store, which keeps the other season's files: the
    farmer table afterwards."""
    from ricefield.sources.model import read_table

    tj, _, live = _live(spark, sf_dir)
    edits = changes.form_rows(dt.edit_rows(spark, sf_dir).where(F.col("season") == CURRENT))
    totals.commit_with_totals(spark, live, totals.updating(edits, ["line"]))
    return read_table(spark, live, "farmer")


def totals_after_changes(spark, sf_dir):
    """Association KPIs from totals that followed three committed changes: edits, deletions
    of farmers, and deletions of associations with their farmers."""
    _, _, live = _live(spark, sf_dir)
    totals.rebuild(spark, live)
    for change in (
        totals.updating(changes.form_rows(dt.edit_rows(spark, sf_dir)), ["line"]),
        totals.deleting(dt.farmer_deletions(spark, sf_dir)),
        totals.deleting_associations(dt.association_deletions(spark, sf_dir)),
    ):
        totals.commit_with_totals(spark, live, change)
    return rollups.association_kpi(totals.tables_with_totals(spark, live))


def snapshot_list(spark, sf_dir):
    """Two snapshots with fixed names: what the listing says of them (without sizes)."""
    tj, root, live = _live(spark, sf_dir)
    for ts in ("20260101_080000", "20260201_080000"):
        tj.snapshot(spark, live, f"{root}/snapshots", ts=ts)
    return tj.list_snapshots(spark, f"{root}/snapshots").select("ts", "table_name", "rows")


def import_replace(spark, sf_dir):
    """Export the tables as CSV, replace-import them into the live folder: all rows."""
    from ricefield.sources.model import read_tables

    tj, root, live = _live(spark, sf_dir)
    tj.export_tables(read_tables(spark, live), f"{root}/export", fmt="csv")
    tj.import_replace(spark, f"{root}/export", live, fmt="csv")
    return changes.table_rows(dict(read_tables(spark, live).items()))


def table_copy(spark, sf_dir):
    """Copy all tables to a second store: all rows there."""
    from ricefield.sources.model import read_tables

    tj, root, live = _live(spark, sf_dir)
    tj.copy_tables(spark, live, f"{root}/copy")
    return changes.table_rows(dict(read_tables(spark, f"{root}/copy").items()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        "season_summary",
        "season_dashboard",
        "season_averages",
        "season_change",
        "overall_totals",
        "municipality_rollup",
        "municipality_listing",
        "association_listing",
        "association_listing_newest",
        "association_rollup",
        "municipality_totals",
        "association_kpi",
        "top_variety",
        "variety_listing",
        "municipality_comparison",
        "municipality_yield",
        "top_performers",
        "association_comparison",
        "farmer_search",
        "farmer_search_indexed",
        "association_farmer_search",
        "farmer_top100",
        "association_farmers_one",
        "municipality_associations_one",
        "farmer_by_id",
        "association_sample",
        "report_stats",
        "report_stats_wet",
        "report_page",
        "report_page_info",
        "report_pages_ranked",
        "municipality_names",
        "upload_classified",
        "upload_summary",
        "upload_apply",
        "upload_csv",
        "upload_short",
        "upload_commit",
        "insert_farmers",
        "insert_farmers_table",
        "update_farmers",
        "update_farmer_outcomes",
        "update_farmers_committed",
        "totals_after_changes",
        "delete_farmers",
        "delete_association_cascade",
        "delete_municipality_cascade",
        "add_associations",
        "add_associations_unique",
        "add_associations_table",
        "rename_associations",
        "rename_associations_unique",
        "rename_associations_table",
        "rename_associations_ordered",
        "rename_associations_ordered_table",
        "add_municipalities",
        "add_municipalities_unique",
        "rename_municipalities",
        "seed_varieties",
        "template_export",
        "short_export",
        "template_export_files",
        "short_export_files",
        "snapshot_restore",
        "snapshot_pinned",
        "snapshot_list",
        "snapshot_names",
        "import_replace",
        "table_copy",
    ]
    g = globals()
    return {n: g[n] for n in names}
