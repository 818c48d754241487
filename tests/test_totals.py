"""Totals carried along with changes against totals counted anew."""

import random

import pytest
from pyspark.sql import functions as F

from ricefield.operators import changes, rollups, totals
from ricefield.sinks import store
from ricefield.sinks import tables as tj
from ricefield.sources.model import FARMER, Tables, read_tables


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def made(spark, n=120, seed=1):
    r = random.Random(seed)
    muni = [(s, i, f"m{i}") for s in ("wet", "dry") for i in range(1, 4)]
    assoc = [(s, i, i % 3 + 1, f"a{i}") for s in ("wet", "dry") for i in range(1, 9)]
    farmer = [
        (s, i, r.randrange(1, 9), f"R{i}", "L", "F", None, "", r.choice([None, 0.25, 1.5, 2.0]), "v", r.choice([None, 3.0, 8.0]), r.choice([None, 40.0, 50.5]))
        for s in ("wet", "dry") for i in range(1, n)
    ]
    make = spark.createDataFrame
    return Tables(make(muni, "season string, id long, name string"), make(assoc, "season string, id long, municipality_id long, name string"), make(farmer, FARMER))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def same_as_counted(spark, root):
    kept = totals._kept(spark, root, store.state(spark, root)["version"])
    assert kept is not None
    tables = read_tables(spark, root, with_variety=False)
    assert rows(kept) == rows(totals.totals_of(tables.farmer))
    carried = tables.with_(totals=kept)
    for rollup in (rollups.association_kpi, rollups.municipality_totals, lambda t: rollups.season_dashboard(t, ["wet", "dry"])):
        assert rows(rollup(carried)) == rows(rollup(tables))


def form(spark, rows_, ids="id long"):
    text = "rsbsa string, last_name string, first_name string, middle_name string, suffix string, area string, variety string, sacks string, kg string, line long"
    return changes.form_rows(spark.createDataFrame(rows_, f"season string, {ids}, {text}"))


def test_totals_follow_every_kind_of_change(spark):
    root = tj.work_dir(spark)
    tj.write_staged(spark, made(spark), root)
    totals.rebuild(spark, root)
    text = ("r", "l", "f", "", "")
    edits = form(spark, [("wet", i, *text, "0.5", "v", "4", "x" if i == 3 else "", i) for i in (1, 2, 3, 2, 999)])
    out = totals.commit_with_totals(spark, root, totals.updating(edits, ["line"]))
    assert {r["status"] for r in out.collect()} == {"updated", "invalid", "not found"}
    same_as_counted(spark, root)
    new = form(spark, [("dry", a, *text, "1", "v", "", "2", k) for k, a in enumerate((1, 1, 77))], "association_id long")
    totals.commit_with_totals(spark, root, totals.inserting(new, ["line"]))
    same_as_counted(spark, root)
    ids = read_tables(spark, root).farmer.where("association_id = 4 AND season = 'dry'").select("season", "id")
    totals.commit_with_totals(spark, root, totals.deleting(ids.unionByName(spark.createDataFrame([("wet", 1), ("wet", 888)], ids.schema))))
    same_as_counted(spark, root)
    assert totals.current(spark, root).where("association_id = 4 AND season = 'dry'").isEmpty()
    totals.commit_with_totals(spark, root, totals.deleting_associations(spark.createDataFrame([("wet", 2), ("wet", 99)], "season string, id long")))
    same_as_counted(spark, root)
    totals.commit_with_totals(spark, root, totals.deleting_municipalities(spark.createDataFrame([("dry", 1)], "season string, id long")))
    same_as_counted(spark, root)
    version = store.state(spark, root)["version"]
    totals.commit_with_totals(spark, root, totals.deleting(spark.createDataFrame([("wet", 888)], "season string, id long")))
    assert store.state(spark, root)["version"] == version  # nothing to change


def test_no_farmer_is_read_for_the_new_totals(spark):
    root = tj.work_dir(spark)
    tj.write_staged(spark, made(spark), root)
    old = totals.rebuild(spark, root)
    change = totals.stored(totals.moved(read_tables(spark, root).farmer.where("id < 5")), "moved")
    files = totals.merged(old, change).inputFiles()
    assert files and all("/_totals/" in f or "moved" in f for f in files)


def test_totals_of_a_version_that_another_job_made(spark):
    root = tj.work_dir(spark)
    t = made(spark)
    tj.write_staged(spark, t, root)
    totals.rebuild(spark, root)
    tj.append_rows(spark, "farmer", t.farmer.withColumn("id", F.col("id") + 5000), root, store.state(spark, root))
    assert rows(totals.tables_with_totals(spark, root).totals) == rows(totals.totals_of(read_tables(spark, root).farmer))
    totals.commit_with_totals(spark, root, totals.deleting(spark.createDataFrame([("wet", 1)], "season string, id long")))
    assert rows(totals.current(spark, root)) == rows(totals.totals_of(read_tables(spark, root).farmer))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], FARMER)
    assert rows(totals.totals_of(empty)) == []
    assert rows(totals.merged(totals.totals_of(empty), totals.moved(empty, empty))) == []
    one = spark.createDataFrame([("wet", 1, 1, "", "", "", "", "", None, "", None, 2.0)], FARMER)
    assert rows(totals.merged(totals.totals_of(empty), totals.moved(added=one))) == [("wet", 1, 1, None, None, None, 0, 0, 0)]
    assert rows(totals.merged(totals.totals_of(one), totals.moved(one))) == []
