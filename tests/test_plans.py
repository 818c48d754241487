"""Plan-shape checks: no Python UDFs, no cartesian products, partition pruning on
season, and no Expand (COUNT DISTINCT) in the municipality rollup."""

import pytest

from fixtures import f1_tables
from ricefield.operators import rollups, search
from ricefield.plans import catalog as E
from ricefield.sinks.tables import work_dir
from ricefield.sources.model import read_tables, write_tables

SF = "/root/testdata/sf0.001"
BAD = ["BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_udf_no_cartesian(spark, name):
    df = E.queries()[name](spark, SF)
    p = plan(df)
    for bad in BAD:
        assert bad not in p, f"{name}: {bad}"


def test_municipality_rollup_has_no_expand(f1):
    p = plan(rollups.municipality_rollup(f1))
    assert "Expand" not in p


def test_season_partition_pruning(spark):
    root = work_dir(spark)
    write_tables(f1_tables(spark), root)
    t = read_tables(spark, root).season("wet")
    rows = search.report_rows(t, season="wet")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in text and "(season#" in text
    assert rows.count() == 2


def test_dashboard_scans_farmers_once(spark):
    from ricefield.operators import compare
    from ricefield.plans.catalog import _t

    t = _t(spark, SF)
    d = compare.dashboard(t, "wet", "dry")
    try:
        for name, alone in (
            ("summary", rollups.season_summary(t, ["wet", "dry"])),
            ("overall", rollups.overall_totals(t, "wet", "dry")),
            ("associations", compare.association_comparison(t, "wet", "dry")),
            ("highlights", compare.top_performers(compare.municipality_merge(t, "wet", "dry"), "wet", "dry")),
        ):
            assert sorted(map(tuple, getattr(d, name).collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
        text = plan(d.summary)
        assert "InMemoryTableScan" in text and "o_orderkey" not in text.split("InMemoryRelation")[0]
    finally:
        d.close()


def test_ids_reach_the_scan(spark):
    root = work_dir(spark)
    write_tables(f1_tables(spark), root)
    t = read_tables(spark, root)
    text = plan(search.farmer_by_id(t, "wet", 1))
    assert "EqualTo(id,1)" in text and "PartitionFilters: [isnotnull(season" in text
    text = plan(search.association_farmers(t, season="wet", association_id=1, with_pos=False))
    assert "EqualTo(association_id,1)" in text and "ExistingRDD" not in text
