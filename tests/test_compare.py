from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import compare, rollups


def by(rows, key):
    return {r[key]: r.asDict() for r in rows}


def test_f1_municipality_comparison(f1):
    rows = by(compare.municipality_comparison(f1, "wet", "dry").collect(), "municipality")
    assert set(rows) == {"Alpha", "Bravo", "Charlie"}
    a = rows["Alpha"]
    assert (a["base_area"], a["base_mt"], a["base_farmers"], a["base_associations"]) == (3.0, 1.3, 2, 2)
    assert (a["current_area"], a["current_mt"], a["current_farmers"]) == (2.5, 1.5, 2)
    assert (a["difference"], a["change"]) == (0.2, 15.38)
    b = rows["Bravo"]
    assert (b["base_mt"], b["current_mt"], b["change"], b["base_associations"]) == (0.0, 0.0, 0.0, 0)
    c = rows["Charlie"]
    assert (c["base_mt"], c["current_mt"], c["change"]) == (0.0, 0.23, None)
    # order: current MT desc, ties in dict order (base keys first)
    assert [r["municipality"] for r in sorted(rows.values(), key=lambda r: r["pos"])] == ["Alpha", "Charlie", "Bravo"]


def test_f1_yield_and_top_performers(f1):
    cmp_ = compare.municipality_comparison(f1, "wet", "dry")
    y = by(compare.municipality_yield(cmp_).collect(), "municipality")
    assert y["Charlie"]["current_yield"] == 0.0
    assert y["Alpha"]["base_yield"] == round(1.3 / 3.0, 2)
    assert y["Charlie"]["change_marker"] == "N/A"
    top = {(r["metric"], r["season"]): r for r in compare.top_performers(cmp_, "wet", "dry").collect()}
    assert top[("production", "dry")]["municipality"] == "Alpha"
    assert top[("yield", "wet")]["municipality"] == "Alpha"
    assert top[("area", "dry")]["municipality"] == "Alpha"
    assert top[("production", "dry")]["headline"] and not top[("production", "wet")]["headline"]


def test_top_performers_empty_placeholder(spark):
    t = tables(spark, [], [], [])
    cmp_ = compare.municipality_comparison(t, "wet", "dry")
    rows = compare.top_performers(cmp_, "wet", "dry").collect()
    assert len(rows) == 6 and all(r["municipality"] == "-" and r["value"] == 0.0 for r in rows)


def test_f1_association_comparison(f1):
    rows = compare.association_comparison(f1, "wet", "dry").orderBy("pos").collect()
    pairs = [(r["base_association"], r["current_association"]) for r in rows]
    assert ("Rice One", "RICE ONE ") in pairs
    assert ("Empty", None) in pairs
    assert (None, "New") in pairs and (None, "Zero") in pairs
    assert len(rows) == 4
    new = [r for r in rows if r["current_association"] == "New"][0]
    assert (new["current_area"], new["current_yield"], new["base_farmers"]) == (1.0, 0.0, 0)
    # NULL base names sort first within a municipality
    assert [r["municipality"] for r in rows] == [" alpha ", "Alpha", "Alpha", "Charlie"]
    assert [r["base_association"] for r in rows][1:3] == ["Empty", "Rice One"]


def test_f2_duplicate_keys_last_wins(spark):
    munis = [("wet", 1, "Delta"), ("wet", 2, " DELTA"), ("dry", 1, "Echo"), ("dry", 2, "echo")]
    assocs = [("wet", 1, 1, "A"), ("wet", 2, 2, "B"), ("dry", 1, 1, "C"), ("dry", 2, 2, "D")]
    farmers = [
        farmer_row("wet", 1, 1, sacks=20.0, kg=50.0),  # 1.0 MT
        farmer_row("wet", 2, 2, sacks=80.0, kg=50.0),  # 4.0 MT
        farmer_row("dry", 1, 1, sacks=20.0, kg=50.0),  # 1.0 MT
        farmer_row("dry", 2, 2, sacks=40.0, kg=50.0),  # 2.0 MT
    ]
    t = tables(spark, munis, assocs, farmers)
    rows = by(compare.municipality_comparison(t, "wet", "dry").collect(), "municipality")
    assert set(rows) == {" DELTA", "Echo"}
    assert rows[" DELTA"]["base_mt"] == 4.0 and rows[" DELTA"]["current_mt"] == 0.0
    assert rows["Echo"]["current_mt"] == 2.0 and rows["Echo"]["base_mt"] == 0.0


def test_f2_association_many_to_many(spark):
    munis = [("wet", 1, "M"), ("dry", 1, "m")]
    assocs = [("wet", 1, 1, "X"), ("wet", 2, 1, "x "), ("dry", 1, 1, "X"), ("dry", 2, 1, " x")]
    t = tables(spark, munis, assocs, [])
    rows = compare.association_comparison(t, "wet", "dry").collect()
    # 'x ' and ' x' trim to the same key in SQL: four joined rows
    assert len(rows) == 4


def test_full_outer_equals_left_union_anti(f1):
    from ricefield.operators.compare import association_comparison

    rows = association_comparison(f1, "wet", "dry").collect()
    base = [r for r in rows if r["base_association"] is not None]
    only_current = [r for r in rows if r["base_association"] is None]
    assert len(base) == f1.association.where("season = 'wet'").count()
    assert len(only_current) == 2


def test_rollup_sums_agree(f1):
    ar = rollups.association_rollup(f1)
    mr = rollups.municipality_rollup(f1)
    st = rollups.season_totals(f1, ["wet", "dry"])
    for season in ("wet", "dry"):
        a = ar.where(F.col("season") == season).agg(F.sum("farmers"), F.sum("area"), F.sum("kg")).first()
        m = mr.where(F.col("season") == season).agg(F.sum("farmers"), F.sum("area"), F.sum("kg")).first()
        s = st.where(F.col("season") == season).select("farmers", "area", "kg").first()
        assert tuple(a) == tuple(m) == tuple(s)


def test_season_summary_and_change(f1):
    s = by(rollups.season_summary(f1, ["wet", "dry"]).collect(), "season")
    assert (s["wet"]["farmers"], s["wet"]["area"], s["wet"]["mt"]) == (2, 3.0, 1.3)
    assert (s["dry"]["farmers"], s["dry"]["area"], s["dry"]["mt"], s["dry"]["associations"]) == (3, 2.5, 1.73, 3)
    c = rollups.season_change(f1, "wet", "dry").first()
    assert c["farmer_difference"] == 1 and c["production_difference"] == 0.43 and c["production_status"] == "increased"
    assert c["farmer_change"] == 50.0 and c["area_status"] == "decreased"
    o = rollups.overall_totals(f1, "wet", "dry").first()
    assert (o["total_farmers"], o["total_municipalities"], o["total_mt"]) == (5, 2, 3.03)


def test_season_summary_empty_season(spark):
    t = tables(spark, [], [], [])
    rows = rollups.season_summary(t, ["wet", "dry"]).collect()
    assert sorted((r["season"], r["farmers"], r["mt"]) for r in rows) == [("dry", 0, 0.0), ("wet", 0, 0.0)]
    a = rollups.season_averages(t, ["wet", "dry"]).collect()
    assert all(r["avg_yield"] == 0.0 for r in a)


def test_association_kpi_and_municipality_totals(f1):
    k = by(rollups.association_kpi(f1).where("season = 'wet'").collect(), "name")
    assert (k["Rice One"]["total_kg"], k["Rice One"]["total_mt"], k["Rice One"]["average_yield"]) == (1300.0, 1.3, 0.43)
    assert (k["Empty"]["total_farmers"], k["Empty"]["average_yield"]) == (0, 0.0)
    m = by(rollups.municipality_totals(f1).where("season = 'wet'").collect(), "name")
    assert (m["Alpha"]["association_count"], m["Alpha"]["total_farmers"], m["Alpha"]["total_mt"]) == (2, 2, 1.3)
    assert m["Bravo"]["association_count"] == 0


def test_top_variety(spark):
    munis = [("wet", 1, "M")]
    assocs = [("wet", 1, 1, "A"), ("wet", 2, 1, "B"), ("wet", 3, 1, "C")]
    farmers = [
        farmer_row("wet", 1, 1, variety="SL 8", sacks=10.0, kg=10.0),  # 100
        farmer_row("wet", 2, 1, variety="", sacks=10.0, kg=10.0),  # Unknown 100
        farmer_row("wet", 3, 1, variety="TH 82", sacks=5.0, kg=10.0),
        farmer_row("wet", 4, 2, variety="SL 8", sacks=0.0, kg=10.0),  # zero only
        farmer_row("wet", 5, 3, variety=None, sacks=1.0, kg=None),
    ]
    t = tables(spark, munis, assocs, farmers)
    rows = by(rollups.top_variety(t).collect(), "association_id")
    assert (rows[1]["top_variety"], rows[1]["top_value"]) == ("SL 8", 100.0)  # tie: first seen
    assert (rows[2]["top_variety"], rows[2]["top_value"]) == (None, 0.0)
    assert rows[3]["top_variety"] is None


def test_top_performers_ties_follow_list_order(spark):
    munis = [("wet", 2, "B"), ("wet", 1, "A"), ("dry", 2, "b"), ("dry", 1, "a"), ("dry", 3, "C")]
    assocs = [("wet", 1, 1, "x"), ("wet", 2, 2, "y"), ("dry", 1, 1, "x"), ("dry", 2, 2, "y"), ("dry", 3, 3, "z")]
    farmers = [farmer_row(s, i, a, area=1.0, sacks=20.0, kg=50.0) for i, (s, a) in enumerate([("wet", 1), ("wet", 2), ("dry", 1), ("dry", 2), ("dry", 3)], 1)]
    t = tables(spark, munis, assocs, farmers)
    merged = compare.municipality_merge(t, "wet", "dry")
    ranked = compare.municipality_comparison(t, "wet", "dry")
    a = {(r["metric"], r["season"]): r["municipality"] for r in compare.top_performers(merged, "wet", "dry").collect()}
    b = {(r["metric"], r["season"]): r["municipality"] for r in compare.top_performers(ranked, "wet", "dry").collect()}
    assert a == b
    assert set(a.values()) == {"A"}  # all tie; 'A' (lowest id, base season) is first in list order
