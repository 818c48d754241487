"""Randomised checks against straightforward sequential implementations written for the
tests (per-row loop for the upload, dict merge for the municipality comparison)."""

import random

from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import compare, ingest
from ricefield.sources.model import FARMER

KEYS = ["A-1", " a-1", "B-2", "b-2 ", "C-3", "", "  ", "007", "7"]


def sequential_upload(existing, rows, scope):
    """rows: (line, season, assoc, rsbsa, last, first) in file order."""
    table = [(s, a, (r or "").strip().lower()) for s, a, r in existing]
    out, next_id = {}, {}
    for s, _a, _r in existing:
        next_id[s] = max(next_id.get(s, 0), 0)
    ids = {}
    for s, i in [(e[0], n) for n, e in enumerate(existing, 1)]:
        ids[s] = max(ids.get(s, 0), i)
    for line, s, a, rsbsa, last, first in rows:
        if not last.strip() and not first.strip():
            out[line] = ("skipped", None)
            continue
        key = rsbsa.strip().lower()
        if key:
            same_scope = [t for t in table if t[0] == s and (scope == "season" or t[1] == a)]
            if any(t[2] == key for t in same_scope):
                out[line] = ("duplicate", None)
                continue
        ids[s] = ids.get(s, 0) + 1
        table.append((s, a, key))
        out[line] = ("inserted", ids[s])
    return out


def test_upload_matches_sequential_loop(spark):
    rnd = random.Random(11)
    for trial in range(4):
        scope = ["season", "association"][trial % 2]
        existing = [(rnd.choice(["wet", "dry"]), rnd.randint(1, 3), rnd.choice(KEYS)) for _ in range(rnd.randint(0, 8))]
        ex_rows = [farmer_row(s, n, a, r, "X", "Y") for n, (s, a, r) in enumerate(existing, 1)]
        rows = []
        for line in range(1, rnd.randint(5, 40)):
            blank = rnd.random() < 0.15
            rows.append((line * 3, rnd.choice(["wet", "dry"]), rnd.randint(1, 3), rnd.choice(KEYS), "" if blank else "L", " " if blank else "F"))
        up = spark.createDataFrame(rows, "line long, season string, association_id long, rsbsa string, last_name string, first_name string")
        cleaned = up.select(
            "line", "season", "association_id",
            ingest.text_or_blank("rsbsa").alias("rsbsa"), ingest.text_or_blank("last_name").alias("last_name"),
            ingest.text_or_blank("first_name").alias("first_name"),
            F.lit("").alias("middle_name"), F.lit("").alias("suffix"), F.lit(0.0).alias("area"), F.lit("").alias("variety"),
            F.lit(0.0).alias("sacks"), F.lit(0.0).alias("kg"),
        )
        cleaned = cleaned.withColumn("key", ingest.py_key("rsbsa")).withColumn(
            "skipped", (F.col("last_name") == "") & (F.col("first_name") == "")
        )
        ex_df = spark.createDataFrame(ex_rows, FARMER)
        got = {r["line"]: (r["status"], r["id"]) for r in ingest.classify_upload(cleaned, ex_df, ["line"], scope=scope, durable=False).collect()}
        want = sequential_upload(existing, rows, scope)
        assert got == want, (trial, scope)


def dict_merge(rows_b, rows_c):
    """rows_*: (id, name, mt) in id order; returns {display name: (base_mt, cur_mt)} and list order."""
    m = {}
    for _id, name, v in rows_b:
        m[name.strip().lower()] = {"name": name, "b": v, "c": 0.0}
    for _id, name, v in rows_c:
        k = name.strip().lower()
        if k not in m:
            m[k] = {"name": name, "b": 0.0, "c": 0.0}
        m[k]["c"] = v
    ordered = sorted(m.values(), key=lambda r: r["c"], reverse=True)
    return [(r["name"], r["b"], r["c"]) for r in ordered]


def test_municipality_merge_matches_dict_merge(spark):
    rnd = random.Random(5)
    names = ["Alpha", " alpha", "ALPHA ", "Bravo", "bravo", "Charlie", "Delta\t"]
    for _ in range(3):
        munis, assocs, farmers, rows = [], [], [], {"wet": [], "dry": []}
        fid = 0
        for season in ("wet", "dry"):
            for mid in range(1, rnd.randint(2, 6)):
                name = rnd.choice(names)
                munis.append((season, mid, name))
                assocs.append((season, mid, mid, f"A{mid}"))
                bags = float(rnd.randint(0, 3) * 20)
                fid += 1
                farmers.append(farmer_row(season, fid, mid, area=1.0, sacks=bags, kg=50.0))
                rows[season].append((mid, name, round(bags * 50.0 / 1000.0, 2)))
        t = tables(spark, munis, assocs, farmers)
        got = [
            (r["municipality"], r["base_mt"], r["current_mt"])
            for r in sorted(compare.municipality_comparison(t, "wet", "dry").collect(), key=lambda r: r["pos"])
        ]
        assert got == dict_merge(sorted(rows["wet"]), sorted(rows["dry"]))
