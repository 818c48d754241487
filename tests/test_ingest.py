import csv
import os
import uuid

import pytest
from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import ingest
from ricefield.sinks import exports
from ricefield.sources.model import FARMER, write_tables

TEMPLATE = [h for h, _ in exports.TEMPLATE_EXPORT]

# F3 rows: rsbsa, last, first, claimed, planted, area, bags, kg
F3 = [
    (" a-1 ", "Cruz", "Ana", "SL 8", "", "1.5", "10", "50"),
    ("b-2", "Reyes", "Ben", "", "TH 82", "1,200", "x", " 45 "),
    ("C-3", "Luna", "", "S6003", "SL 20", "1", "1e1", "12d"),
    ("c-3", "Luna", "Eva", "", "", "2", "2", "2"),
    ("", "Dela Cruz", "Jo", "", "", "", "", ""),
    ("", "Dela Cruz", "Jo", "", "", "", "", ""),
    ("D-4", "", "", "", "", "1", "1", "1"),
    ("007", "Ng", "Li", "", "", "1", "1", "1"),
]


def sheet_row(r):
    rsbsa, last, first, claimed, planted, area, bags, kg = r
    vals = {h: "" for h in TEMPLATE}
    vals.update(
        {
            "FFRS RSBSA Number": rsbsa,
            "Farmer Last Name": last,
            "Farmer First Name": first,
            "Seed Variety Claimed": claimed,
            "Seed Variety Planted": planted,
            "Claimed Area (ha)": area,
            "Total Production (no. of bags) - for all variety(ies)": bags,
            "Average Weight per Bag (kg) - for all variety(ies)": kg,
        }
    )
    return [vals[h] for h in TEMPLATE]


def existing(spark):
    return spark.createDataFrame(
        [farmer_row("wet", 1, 1, "A-1", "X", "Y"), farmer_row("wet", 2, 2, "B-2", "X", "Y")], FARMER
    )


def upload_df(spark, rows=F3):
    data = [tuple(sheet_row(r)) + ("wet", 1, i + 1) for i, r in enumerate(rows)]
    cols = [" " + h.upper() + " " for h in TEMPLATE] + ["season", "association_id", "line"]
    return spark.createDataFrame(data, cols)


def classify(spark, scope, df=None, order=("line",)):
    cleaned = ingest.clean_upload(df if df is not None else upload_df(spark), keep=["season", "association_id", "line"] if "line" in order else ["season", "association_id", "_file", "_block", "_row"])
    return ingest.classify_upload(cleaned, existing(spark), list(order), scope=scope, durable=False)


def test_f3_season_scope(spark):
    out = {r["line"]: r for r in classify(spark, "season").collect()}
    status = [out[i]["status"] for i in range(1, 9)]
    assert status == ["duplicate", "duplicate", "inserted", "duplicate", "inserted", "inserted", "skipped", "inserted"]
    assert (out[3]["sacks"], out[3]["kg"], out[3]["variety"], out[3]["area"]) == (10.0, 0.0, "S6003", 1.0)
    assert out[5]["variety"] == "" and out[8]["rsbsa"] == "007"
    assert [out[i]["id"] for i in (3, 5, 6, 8)] == [3, 4, 5, 6]
    s = ingest.upload_summary(classify(spark, "season")).first()
    assert (s["inserted"], s["duplicates"], s["skipped"]) == (4, 3, 1)


def test_f3_association_scope(spark):
    out = {r["line"]: r for r in classify(spark, "association").collect()}
    assert out[2]["status"] == "inserted"
    assert (out[2]["area"], out[2]["sacks"], out[2]["kg"], out[2]["variety"]) == (0.0, 0.0, 45.0, "TH 82")
    s = ingest.upload_summary(classify(spark, {"wet": "association"})).first()
    assert (s["inserted"], s["duplicates"], s["skipped"]) == (5, 2, 1)


def test_missing_headers_named(spark):
    df = upload_df(spark).drop(" SEX ", " BIRTHDATE ")
    with pytest.raises(ingest.UploadTemplateError) as e:
        ingest.clean_upload(df)
    assert e.value.missing == ["sex", "birthdate"]


def _write_csv(path, rows):
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow([" " + h + " " for h in TEMPLATE])
        for r in rows:
            w.writerow(sheet_row(r))


def test_split_files_same_result(spark, tmp_path):
    one = tmp_path / "one"
    many = tmp_path / "many"
    one.mkdir()
    many.mkdir()
    _write_csv(one / "sheet.csv", F3)
    for i, chunk in enumerate([F3[:3], F3[3:6], F3[6:]]):
        _write_csv(many / f"part-{i}.csv", chunk)

    def run(path, max_bytes):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
        try:
            raw = ingest.read_upload(spark, str(path))
            cleaned = ingest.clean_upload(raw, keep=["_file", "_block", "_row"])
            cleaned = cleaned.withColumn("season", F.lit("wet")).withColumn("association_id", F.lit(1).cast("long"))
            out = ingest.classify_upload(cleaned, existing(spark), ["_file", "_block", "_row"], scope="season")
            return sorted((r["rsbsa"], r["last_name"], r["first_name"], r["status"], r["id"]) for r in out.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    a = run(one, "128MB")
    b = run(many, "128MB")
    c = run(many, "200b")
    assert a == b == c
    assert sum(1 for r in a if r[3] == "inserted") == 4


def test_reupload_inserts_no_keyed_rows(spark):
    first = classify(spark, "season")
    table = ingest.apply_upload(existing(spark), first)
    again = ingest.classify_upload(
        ingest.clean_upload(upload_df(spark), keep=["season", "association_id", "line"]), table, ["line"], durable=False
    )
    keyed_inserts = again.where((F.col("status") == "inserted") & (F.col("rsbsa") != "")).count()
    assert keyed_inserts == 0


def test_template_export_round_trip(spark, tmp_path):
    t = tables(
        spark,
        [("wet", 1, "M")],
        [("wet", 7, 1, "Rice One")],
        [
            farmer_row("wet", 1, 7, "R-1", "Cruz", "Ana", "B", "", 1.5, "SL 8", 10.0, 50.0),
            farmer_row("wet", 2, 7, "007", "Ng", 'Li "Lee", Sr', "", "Jr.", 2.0, "TH 82", 3.0, 40.0),
        ],
    )
    rows = exports.template_rows(t.farmer, with_pos=False)
    out = str(tmp_path / "export")
    exports.write_template_export(rows, out)
    raw = ingest.read_upload(spark, f"{out}/season=wet/association_id=7")
    cleaned = ingest.clean_upload(raw)
    got = sorted(
        (r["rsbsa"], r["last_name"], r["first_name"], r["middle_name"], r["suffix"], r["area"], r["variety"], r["sacks"], r["kg"])
        for r in cleaned.collect()
    )
    want = sorted((f[3], f[4], f[5], f[6], f[7], f[8], f[9], f[10], f[11]) for f in t.farmer.collect())
    assert got == want


def test_short_export_files(spark, tmp_path):
    t = tables(
        spark,
        [("wet", 1, "M")],
        [("wet", 7, 1, "Rice One"), ("wet", 8, 1, "Empty")],
        [farmer_row("wet", 2, 7, "R-2", "Ng", "Li"), farmer_row("wet", 1, 7, "R-1", "Cruz", "Ana")],
    )
    rows = exports.short_rows(t.farmer, t.association)
    stems = {r["file_stem"] for r in rows.collect()}
    assert stems == {"rice_one_wet_farmers"}
    out = str(tmp_path / "short")
    exports.write_short_export(rows, out)
    back = spark.read.option("header", True).csv(f"{out}/season=wet/association_id=7/file_stem=rice_one_wet_farmers").collect()
    assert [r["Last Name"] for r in back] == ["Cruz", "Ng"]
    assert list(back[0].asDict()) == [h for h, _ in exports.SHORT_EXPORT]


def test_run_upload_commits(spark, tmp_path):
    from ricefield.sinks.tables import work_dir
    from ricefield.sources.model import read_table

    root = work_dir(spark)
    t = tables(spark, [("wet", 1, "M")], [("wet", 1, 1, "A"), ("wet", 2, 1, "B")], [tuple(r) for r in existing(spark).collect()])
    write_tables(t, root)
    sheet = tmp_path / "up"
    sheet.mkdir()
    _write_csv(sheet / "a.csv", F3)
    summary = ingest.run_upload(spark, str(sheet), root, association_id=1, season="wet", scope="season").first()
    assert (summary["inserted"], summary["duplicates"], summary["skipped"]) == (4, 3, 1)
    farmers = read_table(spark, root, "farmer")
    assert farmers.count() == 6
    assert sorted(r["id"] for r in farmers.collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="unknown"):
        ingest.run_upload(spark, str(sheet), root, association_id=99, season="wet")
    assert read_table(spark, root, "farmer").count() == 6


def test_short_template_upload(spark):
    df = spark.createDataFrame(
        [("R-1", "Cruz", "Ana", "2", "SL 8", "10", "50"), ("", "", "", "1", "", "1", "1")],
        "RSBSA string, LastName string, ` First Name ` string, Area string, Variety string, Sacks string, KG string",
    )
    cleaned = ingest.clean_upload(df, template="short")
    rows = cleaned.collect()
    assert (rows[0]["last_name"], rows[0]["first_name"], rows[0]["area"], rows[0]["variety"], rows[0]["kg"]) == ("Cruz", "Ana", 2.0, "SL 8", 50.0)
    assert rows[1]["skipped"] and rows[0]["middle_name"] == ""
    with pytest.raises(ingest.UploadTemplateError) as e:
        ingest.clean_upload(df.drop("LastName"), template="short")
    assert e.value.missing == ["last name | lastname"]


def test_parquet_upload_prefers_named_sheet(spark, tmp_path):
    base = tmp_path / "book"
    good = upload_df(spark).drop("season", "association_id", "line")
    good.write.parquet(str(base / "NRP DISTRIBUTION"))
    raw = ingest.read_upload(spark, str(base), fmt="parquet")
    assert raw.count() == len(F3) and {"_file", "_block", "_row"} <= set(raw.columns)
    cleaned = ingest.clean_upload(raw)
    assert sorted(r["rsbsa"] for r in cleaned.collect()) == sorted(r[0].strip() for r in F3)
    # without the preferred sub-folder the path itself is read
    other = tmp_path / "plain"
    good.write.parquet(str(other))
    assert ingest.read_upload(spark, str(other), fmt="parquet").count() == len(F3)


def test_run_upload_with_target_columns_and_association_scope(spark, tmp_path):
    from ricefield.sinks.tables import work_dir
    from ricefield.sources.model import read_table

    root = work_dir(spark)
    t = tables(
        spark,
        [("dry", 1, "M")],
        [("dry", 1, 1, "A"), ("dry", 2, 1, "B")],
        [farmer_row("dry", 10, 1, "A-1", "X", "Y"), farmer_row("dry", 11, 2, "B-2", "X", "Y")],
    )
    write_tables(t, root)
    sheet = tmp_path / "multi"
    sheet.mkdir()
    with open(sheet / "a.csv", "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(TEMPLATE + ["Season", "Association_ID"])
        for r, assoc in zip(F3, [1, 1, 1, 2, 1, 2, 1, 2]):
            w.writerow(sheet_row(r) + ["dry", str(assoc)])
    s = ingest.run_upload(spark, str(sheet), root, scope={"dry": "association"}).first()
    # line 1 ' a-1 ' -> assoc 1 holds A-1: duplicate; line 2 'b-2' -> assoc 1 has no B-2: inserted;
    # line 4 'c-3' in assoc 2 while line 3 'C-3' went to assoc 1: inserted
    assert (s["season"], s["inserted"], s["duplicates"], s["skipped"]) == ("dry", 6, 1, 1)
    ids = sorted(r["id"] for r in read_table(spark, root, "farmer").collect())
    assert ids == [10, 11, 12, 13, 14, 15, 16, 17]


def test_csv_quoting(spark, tmp_path):
    d = tmp_path / "q"
    d.mkdir()
    rows = [('R-"1"', "Dela Cruz, Jr.", "Ana"), ("R-2", "Ng", 'Li "Lee"')]
    with open(d / "a.csv", "w", newline="") as fh:
        w = csv.writer(fh)  # doubles quotes inside quoted cells
        w.writerow(TEMPLATE)
        for rsbsa, last, first in rows:
            w.writerow(sheet_row((rsbsa, last, first, "", "", "1", "1", "1")))
    cleaned = ingest.clean_upload(ingest.read_upload(spark, str(d)))
    got = sorted((r["rsbsa"], r["last_name"], r["first_name"]) for r in cleaned.collect())
    assert got == sorted(rows)


def test_classification_independent_of_shuffle_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r["line"], r["status"], r["id"]) for r in classify(spark, {"wet": "association"}).collect()))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    base = tmp_path / "book" / "NRP DISTRIBUTION"
    base.mkdir(parents=True)
    orders = [list(range(23)), list(reversed(range(23))), [*range(5, 23), *range(5)]]
    for k, order in enumerate(orders):
        with open(base / f"{k}.csv", "w", newline="") as fh:
            w = csv.writer(fh)
            w.writerow([TEMPLATE[i].upper() + " " for i in order])
            for r in F3[k::3]:
                w.writerow([sheet_row(r)[i] for i in order])
    cleaned = ingest.clean_upload(ingest.read_upload(spark, str(tmp_path / "book"), template="full"))
    got = sorted((r["rsbsa"], r["last_name"], r["first_name"]) for r in cleaned.collect())
    assert got == sorted((r[0].strip(), r[1], r[2]) for r in F3)


def test_a_bad_file_among_good_ones_is_named(spark, tmp_path):
    d = tmp_path / "up"
    d.mkdir()
    _write_csv(d / "a.csv", F3)
    with open(d / "b.csv", "w", newline="") as fh:
        csv.writer(fh).writerow(TEMPLATE[3:])
    with pytest.raises(ingest.UploadTemplateError) as e:
        ingest.read_upload(spark, str(d), template="full")
    assert e.value.file.endswith("b.csv") and e.value.missing == ingest.REQUIRED_COLUMNS[:3]


def test_upload_writes_only_new_files(spark, tmp_path):
    from ricefield.sinks import store, tables as tj
    from ricefield.sources.model import read_table

    root = tj.work_dir(spark)
    t = tables(spark, [("wet", 1, "M")], [("wet", 1, 1, "A"), ("wet", 2, 1, "B")], [tuple(r) for r in existing(spark).collect()])
    tj.write_staged(spark, t, root)
    before = store.state(spark, root)
    d = tmp_path / "up"
    d.mkdir()
    _write_csv(d / "a.csv", F3)
    ingest.run_upload(spark, str(d), root, association_id=1, season="wet")
    after = store.state(spark, root)
    assert after["tables"]["farmer"][:1] == before["tables"]["farmer"] and len(after["tables"]["farmer"]) == 2
    assert after["tables"]["association"] == before["tables"]["association"]
    assert read_table(spark, root, "farmer").count() == 6
    with pytest.raises(ingest.UploadRefused) as e:
        ingest.run_upload(spark, str(d), root, association_id=99, season="wet")
    assert [tuple(r) for r in e.value.targets.collect()] == [("wet", 99)]


def test_short_export_of_equal_names(spark, tmp_path):
    t = tables(
        spark, [("wet", 1, "M"), ("wet", 2, "N")], [("wet", 7, 1, "Rice One"), ("wet", 8, 2, "Rice One")],
        [farmer_row("wet", 1, 7, "R-1", "Ng", "Li"), farmer_row("wet", 2, 8, "R-2", "Cruz", "Ana")],
    )
    out = str(tmp_path / "short")
    exports.write_short_export(exports.short_rows(t.farmer, t.association, with_pos=False), out)
    rows = exports.read_written(spark, out, exports.SHORT_EXPORT, "season string, association_id long, file_stem string").collect()
    assert sorted((r["association_id"], r["last_name"]) for r in rows) == [(7, "Ng"), (8, "Cruz")]


def test_headers_of_many_files_come_from_one_job(spark, tmp_path, monkeypatch):
    d = tmp_path / "many files"
    d.mkdir()
    columns = list(ingest.REQUIRED_COLUMNS)
    want = {}
    for k in range(300):
        own = columns[k % 3 :] + columns[: k % 3]
        own = [c.upper() + " " if k % 2 else c for c in own]
        with open(d / f"part {k:03}%41.csv", "w", newline="", encoding="utf-8-sig" if k % 7 == 0 else "utf-8") as fh:
            csv.writer(fh).writerows([own, ["1"] * len(own)])
        want[k] = tuple(c.strip().lower() for c in own)
    (d / "part 300.csv").write_text("")
    (d / "part 301.csv").write_text('"a\nb",c\n1,2\n')
    opened, one = [], ingest._header
    monkeypatch.setattr(ingest, "_header", lambda s, f: opened.append(f) or one(s, f))
    files = ingest._csv_files(spark, str(d))
    got = ingest.headers(spark, files)
    assert list(got) == files and list(got.values()) == [*want.values(), (), ("a\nb", "c")]
    assert len(opened) == 2  # the file without a line and the header of two lines
    assert ingest.headers(spark, files[:5]) == {f: got[f] for f in files[:5]} and len(opened) == 7
    with pytest.raises(ingest.UploadTemplateError, match="part 300"):  # the first bad file
        ingest.read_upload(spark, str(d), template="full")


def test_an_export_makes_one_file_for_each_association(spark, tmp_path):
    t = tables(
        spark, [("wet", 1, "M")], [("wet", k, 1, f"A {k}") for k in range(40)],
        [farmer_row("wet", k, k % 40, f"R-{k}", "Ng", "Li") for k in range(80)],
    )
    out, key = tmp_path / "template", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    exports.write_template_export(exports.template_rows(t.farmer, with_pos=False), str(out))
    files = [p.name for p in out.rglob("*") if p.is_file()]
    assert "_SUCCESS" in files and len(files) < 2 * 40  # no second file beside each one
    rows = exports.read_written(spark, str(out), exports.TEMPLATE_EXPORT, "season string, association_id long")
    assert rows.count() == 80 and spark.conf.get(key) == before


ODD = ["", None, 'a "b", c', " pad ", "\\", "x\\", "#h", "é%41/:=?*[]{}^'", "\t", "ü ", "a\x85b", "\x1c", "0", "''", '"']


def test_export_files_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    t = tables(
        spark, [("wet", 1, "M")], [("wet", k, 1, v or "") for k, v in enumerate(ODD[:-2])],
        [farmer_row("wet", 100 * j + k, k, v or "", ODD[(k + j) % len(ODD)] or "", ODD[j] or "", v, v or "", 0.1, v or "", 1e10 * j, 50.0) for k, v in enumerate(ODD) for j in range(3)],
    )
    short = exports.short_rows(t.farmer, t.association, with_pos=False)
    short = short.withColumn("file_stem", F.when(F.col("association_id") > 1, F.col("file_stem")))
    made = [
        ("template", exports.template_rows(t.farmer, with_pos=False), exports.write_template_export, exports.TEMPLATE_EXPORT, ""),
        ("short", short, exports.write_short_export, exports.SHORT_EXPORT, ", file_stem string"),
    ]
    for name, rows, write, spec, more in made:
        folders = "season string, association_id long" + more
        tops = tmp_path / f"{name}-tasks", tmp_path / f"{name}-spark"
        write(rows, str(tops[0]))
        write(rows, str(tops[0]))  # takes the place of the first
        with monkeypatch.context() as m:
            m.setattr(exports, "_local", lambda s, p: None)
            write(rows, str(tops[1]))
            want = sorted(map(repr, exports.read_written(spark, str(tops[1]), spec, folders).collect()))
        files = [
            sorted((str(p.parent.relative_to(top)), p.read_bytes()) for p in top.rglob("*") if p.is_file() and p.name[0] not in "._")
            for top in tops
        ]
        assert files[0] == files[1] and len(files[0]) >= len(ODD)
        assert not [p for p in tops[0].rglob("_*") if p.name != "_SUCCESS"]
        assert sorted(map(repr, exports.read_written(spark, str(tops[0]), spec, folders).collect())) == want and len(want) > 40
        write(rows, str(tops[0]), mode="append")
        assert len([p for p in tops[0].rglob("part-*")]) == 2 * len(files[0])


def test_folders_of_an_export_are_named_as_spark_names_them(spark):
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    values = [chr(c) for c in range(1, 300)] + ["", "a b%20", "100%"]
    for v in values:
        assert exports.folder_name("k", v) == escape.getPartitionPathString("k", v), repr(v)
        assert exports.folder_value(exports.folder_name("k", v)) == (v or None)
    assert exports.folder_value(exports.folder_name("k", None)) is None


def test_no_process_is_started_for_a_file_of_an_export(spark, tmp_path):
    t = tables(spark, [("wet", 1, "M")], [("wet", 1, 1, "A")], [farmer_row("wet", k, 1, f"R-{k}", "Ng", "Li") for k in range(9)])
    exports.write_template_export(exports.template_rows(t.farmer, with_pos=False), str(tmp_path / "out"))
    rows = exports.read_written(spark, str(tmp_path / "out"), exports.TEMPLATE_EXPORT, "season string, association_id long")
    # the files are opened by the tasks' workers, not one by one through Hadoop's local file system
    assert "MapInArrow" in rows._jdf.queryExecution().toString() and rows.count() == 9
