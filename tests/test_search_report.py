import pytest
from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import search


def _people(spark, n, season="wet"):
    munis = [(season, 1, "Alpha"), (season, 2, "Bravo")]
    assocs = [(season, 1, 1, "Rice One"), (season, 2, 2, "Corn Two")]
    farmers = [
        farmer_row(season, i + 1, 1 + (i % 2), f"R-{i}", f"Name{i:03d}", "Ana", area=1.0, sacks=10.0, kg=50.0)
        for i in range(n)
    ]
    return tables(spark, munis, assocs, farmers)


def test_farmer_search_terms(spark):
    munis = [("wet", 1, "Alpha"), ("dry", 1, "Alpha")]
    assocs = [("wet", 1, 1, "A"), ("dry", 1, 1, "A")]
    farmers = [
        farmer_row("wet", 1, 1, "R-1", "Cruz", "Ana"),
        farmer_row("wet", 2, 1, "a%b", "Reyes", "Ben"),
        farmer_row("dry", 3, 1, "axb", "DELA CRUZ", "Jo"),
        farmer_row("dry", 4, 1, "q\\z", "Ng", "Li"),
        farmer_row("dry", 5, 9, "R-5", "Cruz", "Orphan"),  # association missing: inner join drops it
    ]
    t = tables(spark, munis, assocs, farmers)
    labels = {"wet": "Wet 2026", "dry": "Dry 2027"}

    def ids(term, **kw):
        return sorted(r["id"] for r in search.farmer_search(t, term, labels, **kw).collect())

    assert ids("cruz") == [1, 3]
    assert ids("cruz", case_sensitive=True) == []
    assert ids("a%b") == [2, 3]
    assert ids("_") == [1, 2, 3, 4]
    assert ids("\\") == [4]
    assert ids("   ") == []
    labs = {r["id"]: r["season_label"] for r in search.farmer_search(t, "cruz", labels).collect()}
    assert labs == {1: "Wet 2026", 3: "Dry 2027"}


def test_association_farmers_order(spark):
    t = _people(spark, 6)
    rows = search.association_farmers(t).collect()
    by_assoc = {}
    for r in rows:
        by_assoc.setdefault(r["association_id"], []).append((r["pos"], r["last_name"]))
    for v in by_assoc.values():
        v.sort()
        assert [p for p, _ in v] == list(range(1, len(v) + 1))
        assert [n for _, n in v] == sorted(n for _, n in v)


@pytest.mark.parametrize("n", [0, 15, 16, 31])
def test_report_paging(spark, n):
    t = _people(spark, n)
    rows = search.report_rows(t, season="all")
    stats = search.report_stats(rows).first()
    assert stats["total_records"] == n
    pages = search.total_pages(n)
    for page, want in [(1, min(15, n)), (pages, n - 15 * (pages - 1) if n else 0), (pages + 1, 0), (0, min(15, n)), ("abc", min(15, n))]:
        got = search.report_page(rows, page).collect()
        assert len(got) == want
        info = search.report_page_info(search.report_stats(rows), page).first()
        p = search.parse_page(page)
        assert info["total_pages"] == pages and info["has_next"] == (p < pages) and info["has_prev"] == (p > 1)
    all_rows = sorted(
        [r for p in range(1, pages + 1) for r in search.report_page(rows, p).collect()], key=lambda r: r["pos"]
    )
    assert [r["pos"] for r in all_rows] == list(range(1, n + 1))
    assert [r["farmer_name"] for r in all_rows] == sorted(r["farmer_name"] for r in all_rows)


def test_report_filters_and_seasons(spark):
    t = _people(spark, 10)
    assert search.report_stats(search.report_rows(t, municipality="alp")).first()["total_records"] == 5
    assert search.report_stats(search.report_rows(t, search="corn")).first()["total_records"] == 5
    assert search.report_stats(search.report_rows(t, search="name00")).first()["total_records"] == 10
    assert search.report_stats(search.report_rows(t, season="dry")).first()["total_records"] == 0
    s = search.report_stats(search.report_rows(t, season="WET")).first()
    assert (s["total_records"], s["total_area"], s["total_yield"]) == (10, 10.0, 5.0)
    with pytest.raises(ValueError):
        search.report_rows(t, season="other")


def test_municipality_names_and_list(spark):
    munis = [("wet", 1, "Bravo"), ("dry", 1, "Alpha"), ("dry", 2, "Bravo"), ("wet", 2, "")]
    t = tables(spark, munis, [], [])
    rows = sorted(search.municipality_names(t).collect(), key=lambda r: r["pos"])
    assert [r["name"] for r in rows] == ["Alpha", "Bravo"]


def test_farmer_list_cap(spark):
    t = _people(spark, 130)
    rows = search.farmer_list(t).collect()
    assert len(rows) == 100 and sorted(r["pos"] for r in rows) == list(range(1, 101))
    assert max(r["last_name"] for r in rows) == "Name099"


def test_farmer_list_display_columns(spark):
    t = tables(
        spark,
        [("wet", 1, "M")],
        [("wet", 1, 1, "A")],
        [farmer_row("wet", 1, 1, "", "Cruz", "Ana", None, sacks=10.0, kg=None), farmer_row("wet", 2, 1, "R-2", "Ng", "Li", "B", sacks=2.0, kg=50.0)],
    )
    rows = {r["id"]: r for r in search.association_farmers(t).collect()}
    assert (rows[1]["total_kg"], rows[1]["rsbsa_display"], rows[1]["middle_name_display"]) == (0.0, "-", "-")
    assert (rows[2]["total_kg"], rows[2]["total_mt"], rows[2]["rsbsa_display"]) == (100.0, 0.1, "R-2")


def test_association_listing_newest_first(spark):
    from ricefield.operators import rollups

    t = tables(spark, [("wet", 1, "M")], [("wet", 1, 1, "B"), ("wet", 2, 1, "A"), ("wet", 3, 9, "C")], [])
    rows = sorted(rollups.association_listing(t, newest_first=True).collect(), key=lambda r: r["pos"])
    assert [r["id"] for r in rows] == [3, 2, 1] and rows[0]["municipality_name"] is None


def test_report_view_bundle(spark):
    t = _people(spark, 31)
    v = search.report(t, season="wet", municipality="alp", page=2)
    assert v.stats.first()["total_records"] == 16
    assert [r["pos"] for r in v.page.collect()] == [16]
    info = v.page_info.first()
    assert (info["total_pages"], info["has_next"], info["has_prev"]) == (2, False, True)
    assert [r["name"] for r in v.municipalities.orderBy("pos").collect()] == ["Alpha", "Bravo"]
    v.rows.unpersist()


def _report_rows(spark, n):
    names = [None, "b", "a", "a", "C"]
    return spark.createDataFrame([(names[i * 7 % 5] and f"{names[i * 7 % 5]}{i % 11}", ["Wet", "Dry"][i % 2], i) for i in range(n)], "farmer_name string, season string, id long")


def test_ranked_pages_are_the_report_pages(spark):
    from ricefield.operators import search

    rows = _report_rows(spark, 203)
    ranked = search.rank_report(rows, ranges=5)
    assert ranked.total == 203 and len(ranked.ranges) > 1
    for page in (1, 2, 3, 13, 14, 15, 99, 0, -4, "x"):
        assert ranked.page(page).collect() == search.report_page(rows, page).collect()
    info = search.report_page_info(rows.agg(F.count(F.lit(1)).alias("total_records")), 14)
    assert ranked.page_info(14).collect() == info.collect()
    empty = search.rank_report(_report_rows(spark, 5).where("id < 0"))
    assert empty.page(1).collect() == [] and empty.page_info(1).first()["total_pages"] == 1


def test_a_ranked_page_opens_its_range_only(spark):
    from ricefield.operators import search

    ranked = search.rank_report(_report_rows(spark, 400), ranges=4)
    r, n, before = ranked.ranges[2]
    page = (before + n // 2) // search.PER_PAGE + 1  # well inside the third range
    plan = ranked.page(page)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert f"order_range#" in scan and f"= {r})" in scan and "place" in scan.split("PushedFilters")[1]
    assert len({f for f in ranked.page(page)._jdf.queryExecution().executedPlan().toString().splitlines() if "TakeOrdered" in f}) == 0
