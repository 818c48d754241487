"""

(a) municipality rollup: the literal plan (municipality LEFT JOIN association LEFT JOIN
    farmer, COUNT(DISTINCT association), COUNT(DISTINCT farmer)) against the library's
    pre-aggregated plan, on the same stand-in tables;
(b) upload classification at the three given scale factors (rows grow 10x per step).

Median of ``REPEAT`` warm runs, results to the ``noop`` sink.  Prints JSON lines.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ricefield.functions.exprs import mt, r2  # noqa: E402
from ricefield.operators import rollups  # noqa: E402
from ricefield.plans import catalog  # noqa: E402
from ricefield.session import local_session  # noqa: E402

REPEAT = int(os.environ.get("REPEAT", "5"))


def literal_rollup(t):
    m, a, f = t.municipality.alias("m"), t.association.alias("a"), t.farmer.alias("f")
    j = m.join(a, (F.col("a.season") == F.col("m.season")) & (F.col("a.municipality_id") == F.col("m.id")), "left").join(
        f, (F.col("f.season") == F.col("a.season")) & (F.col("f.association_id") == F.col("a.id")), "left"
    )
    return j.groupBy("m.season", "m.id", "m.name").agg(
        F.countDistinct("a.id").alias("associations"),
        F.countDistinct("f.id").alias("farmers"),
        r2(F.coalesce(F.sum("f.area"), F.lit(0.0))).alias("area"),
        r2(mt(F.sum(F.col("f.sacks") * F.col("f.kg")))).alias("mt"),
    )


def timed(fn):
    fn()
    runs = []
    for _ in range(REPEAT):
        t0 = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t0)
    return round(statistics.median(runs), 3)


def main():
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    t = catalog._t(spark, sf)
    lit = literal_rollup(t)
    pre = rollups.municipality_summary(t)
    same = sorted(tuple(r) for r in lit.select("season", "id", "name", "associations", "farmers", "area", "mt").collect()) == sorted(
        tuple(r) for r in pre.select("season", "id", "name", "associations", "farmers", "area", "mt").collect()
    )
    plan_lit = lit._jdf.queryExecution().executedPlan().toString()
    plan_pre = pre._jdf.queryExecution().executedPlan().toString()
    print(
        json.dumps(
            {
                "measure": "municipality_rollup",
                "sf": sf,
                "cpus": cpus,
                "literal_sec": timed(lambda: lit.write.format("noop").mode("overwrite").save()),
                "preaggregated_sec": timed(lambda: pre.write.format("noop").mode("overwrite").save()),
                "literal_has_expand": "Expand" in plan_lit,
                "preaggregated_has_expand": "Expand" in plan_pre,
                "literal_exchanges": plan_lit.count("Exchange"),
                "preaggregated_exchanges": plan_pre.count("Exchange"),
                "same_result": same,
            }
        ),
        flush=True,
    )
    for sfx in ("sf0.001", "sf0.01", "sf0.1"):
        d = f"/root/testdata/{sfx}"
        rows = catalog.upload_classified(spark, d).count()
        sec = timed(lambda: catalog.upload_classified(spark, d).write.format("noop").mode("overwrite").save())
        print(json.dumps({"measure": "upload_classified", "sf": sfx, "rows": rows, "sec": sec, "cpus": cpus}), flush=True)


if __name__ == "__main__":
    main()
