import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ricefield.operators.ranking import first_by, sequence_number


def _data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 40)}"  # one group holds a third of the rows
        rows.append((i, g, rnd.choice([None, "a", "b", "c"]), rnd.randint(0, 50)))
    return spark.createDataFrame(rows, "id long, g string, s string, v int").repartition(7)


def test_sequence_number_matches_row_number(spark):
    df = _data(spark)
    order = [F.desc("v"), F.asc_nulls_first("s"), "id"]
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = sequence_number(df, order, partition_by=["g"], num_partitions=5)
    j = got.join(want.select("id", "want"), "id")
    assert j.count() == 3000
    assert j.where(F.col("pos") != F.col("want")).count() == 0


def test_sequence_number_default_partitions(spark):
    df = _data(spark)
    order = [F.asc_nulls_first("s"), F.desc("v"), "id"]
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = sequence_number(df, order, partition_by=["g"])
    j = got.join(want.select("id", "want"), "id")
    assert j.count() == 3000 and j.where(F.col("pos") != F.col("want")).count() == 0


def test_sequence_number_global_and_start(spark):
    df = _data(spark)
    want = df.withColumn("want", F.row_number().over(Window.orderBy("v", "id")) + 99)
    got = sequence_number(df, ["v", "id"], start=100, num_partitions=4)
    j = got.join(want.select("id", "want"), "id")
    assert j.where(F.col("pos") != F.col("want")).count() == 0 and j.count() == 3000


def test_result_independent_of_shuffle_partitions(spark):
    from fixtures import f1_tables
    from ricefield.operators import compare

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(tuple(r) for r in compare.association_comparison(f1_tables(spark), "wet", "dry").collect()))
        assert out[0] == out[1] == out[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_first_by_ties(spark):
    df = spark.createDataFrame([("a", 5, 2, "x"), ("a", 5, 1, "y"), ("a", 3, 0, "z"), ("b", 1, 9, "w")], "g string, v int, o int, name string")
    got = {r["g"]: r["name"] for r in first_by(df, ["g"], [F.col("v"), -F.col("o")], ["name"]).collect()}
    assert got == {"a": "y", "b": "w"}
