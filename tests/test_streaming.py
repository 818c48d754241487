import csv

from fixtures import farmer_row, tables
from ricefield.sinks.tables import work_dir
from ricefield.sources.model import read_table, write_tables
from ricefield.streaming.uploads import start_upload_stream
from test_ingest import F3, TEMPLATE, sheet_row


def test_upload_stream_available_now(spark, tmp_path):
    root = work_dir(spark)
    t = tables(
        spark,
        [("wet", 1, "M")],
        [("wet", 1, 1, "A"), ("wet", 2, 1, "B")],
        [farmer_row("wet", 1, 1, "A-1", "X", "Y"), farmer_row("wet", 2, 2, "B-2", "X", "Y")],
    )
    write_tables(t, root)
    landing = tmp_path / "landing" / "season=wet" / "association_id=1"
    landing.mkdir(parents=True)
    with open(landing / "a.csv", "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(TEMPLATE)
        for r in F3:
            w.writerow(sheet_row(r))
    q = start_upload_stream(
        spark, str(tmp_path / "landing"), root, f"{root}/_stream_ckpt", scope="season", summaries_path=f"{root}/_summaries"
    )
    q.awaitTermination(300)
    farmers = read_table(spark, root, "farmer")
    assert farmers.count() == 6
    s = spark.read.parquet(f"{root}/_summaries").first()
    assert (s["inserted"], s["duplicates"], s["skipped"]) == (4, 3, 1)


def _landing(tmp_path, name, association=1, header=TEMPLATE, rows=F3):
    d = tmp_path / name / "season=wet" / f"association_id={association}"
    d.mkdir(parents=True, exist_ok=True)
    with open(d / "a.csv", "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for r in rows:
            w.writerow([sheet_row(r)[TEMPLATE.index(h)] for h in header])
    return str(d / "a.csv")


def _store(spark):
    root = work_dir(spark)
    write_tables(tables(spark, [("wet", 1, "M")], [("wet", 1, 1, "A")], [farmer_row("wet", 1, 1, "A-1", "X", "Y")]), root)
    return root


def test_replay_after_another_commit_is_not_applied_twice(spark, tmp_path):
    from ricefield.sinks.tables import write_staged
    from ricefield.streaming.uploads import commit_files

    root, file = _store(spark), _landing(tmp_path, "in")
    commit_files(spark, [file], root, "season", "q1", 7)
    assert read_table(spark, root, "farmer").count() == 6  # 1 existing + 5 inserted once
    write_staged(spark, {"farmer": read_table(spark, root, "farmer")}, root)
    commit_files(spark, [file], root, "season", "q1", 7)  # replay of the same batch
    assert read_table(spark, root, "farmer").count() == 6


def test_two_streams_on_one_table_do_not_mix(spark, tmp_path):
    root = _store(spark)
    for k in (1, 2):
        _landing(tmp_path, f"in{k}", rows=[(f"N-{k}", "Last", "First", "", "", "1", "1", "1")])
        start_upload_stream(spark, str(tmp_path / f"in{k}"), root, f"{root}/_ckpt{k}").awaitTermination(300)
    assert sorted(r["rsbsa"] for r in read_table(spark, root, "farmer").collect()) == ["A-1", "N-1", "N-2"]


def test_stream_reads_any_column_order_and_rejects_what_it_cannot_use(spark, tmp_path):
    root = _store(spark)
    _landing(tmp_path, "in", 1, header=list(reversed(TEMPLATE)), rows=F3[:1] + F3[7:])
    _landing(tmp_path, "in", 99, rows=F3[1:2])  # no such association
    bad = tmp_path / "in" / "season=wet" / "association_id=1" / "bad.csv"
    bad.write_text("one,two\n1,2\n")
    start_upload_stream(spark, str(tmp_path / "in"), root, f"{root}/_ckpt", rejects_path=f"{root}/_rejects").awaitTermination(300)
    assert sorted(r["rsbsa"] for r in read_table(spark, root, "farmer").collect()) == ["007", "A-1"]
    assert [r["rsbsa"] for r in spark.read.parquet(f"{root}/_rejects/rows").collect()] == ["b-2"]
    assert spark.read.parquet(f"{root}/_rejects/files").first()["file"].endswith("bad.csv")
