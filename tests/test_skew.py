"""Hot groups: one association holds a third of all farmers and one RSBSA key a third
of the uploaded rows.  AQE skew handling is forced on tiny partitions so the split
paths run; results must equal brute force."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import ingest, rollups, search
from ricefield.sources.model import FARMER

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_tables(spark, n=3000):
    munis = [("wet", 1, "M")]
    assocs = [("wet", i, 1, f"A{i}") for i in range(1, 21)]
    farmers = []
    for i in range(n):
        assoc = 1 if i % 3 == 0 else 2 + (i % 19)
        farmers.append(farmer_row("wet", i + 1, assoc, f"R-{i}", f"L{i % 97:03d}", f"F{i % 13}", area=0.25, sacks=2.0, kg=10.0))
    return tables(spark, munis, assocs, farmers)


def test_positions_in_hot_association(spark, skew_conf):
    t = _hot_tables(spark)
    got = search.association_farmers(t).select("association_id", "id", "pos")
    w = Window.partitionBy("association_id").orderBy(F.asc_nulls_first("last_name"), F.asc_nulls_first("first_name"), "id")
    want = t.farmer.select("association_id", "id", F.row_number().over(w).alias("want"))
    j = got.join(want, ["association_id", "id"])
    assert j.count() == 3000 and j.where(F.col("pos") != F.col("want")).count() == 0


def test_rollup_with_hot_association(spark, skew_conf):
    t = _hot_tables(spark)
    r = {row["id"]: row for row in rollups.association_rollup(t).collect()}
    assert r[1]["farmers"] == 1000 and r[1]["kg"] == 20000.0
    m = rollups.municipality_rollup(t).first()
    assert (m["farmers"], m["associations"], m["area"]) == (3000, 20, 750.0)


def test_upload_with_hot_key(spark, skew_conf):
    existing = spark.createDataFrame([farmer_row("wet", 1, 1, "X-1", "A", "B")], FARMER)
    rows = []
    for i in range(3000):
        key = [" hot-1 ", "HOT-1", "Hot-1"][i % 3] if i % 3 == 0 else f"K-{i % 700}"
        rows.append(("wet", 1 + i % 5, i + 1, key, "L", "F"))
    up = spark.createDataFrame(rows, "season string, association_id long, line long, rsbsa string, last_name string, first_name string")
    cleaned = up.select(
        "season", "association_id", "line", "rsbsa", "last_name", "first_name",
        F.lit("").alias("middle_name"), F.lit("").alias("suffix"), F.lit(0.0).alias("area"), F.lit("").alias("variety"),
        F.lit(0.0).alias("sacks"), F.lit(0.0).alias("kg"), F.lower(F.trim("rsbsa")).alias("key"), F.lit(False).alias("skipped"),
    )
    out = ingest.classify_upload(cleaned, existing, ["line"], scope="season", durable=False)
    got = {r["line"]: (r["status"], r["id"]) for r in out.collect()}
    # brute force: first occurrence of each key in line order is inserted
    seen, want, next_id = set(), {}, 2
    for season, assoc, line, key, _, _ in rows:
        k = key.strip().lower()
        if k in seen:
            want[line] = ("duplicate", None)
        else:
            seen.add(k)
            want[line] = ("inserted", next_id)
            next_id += 1
    assert got == want
