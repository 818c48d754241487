import pytest

from fixtures import f1_tables
from ricefield.sinks import tables as tj
from ricefield.sources.model import read_tables, write_tables


def _rows(t):
    return {name: sorted(tuple(r) for r in df.collect()) for name, df in t.items()}


def test_snapshot_restore_identity(spark):
    root = tj.work_dir(spark)
    live = f"{root}/live"
    t = f1_tables(spark)
    tj.write_staged(spark, t, live)
    before = _rows(read_tables(spark, live))
    ts = tj.snapshot(spark, live, f"{root}/snaps", ts="20260101_000000")
    t2 = read_tables(spark, live)
    tj.write_staged(spark, t2.with_(farmer=t2.farmer.limit(0)), live, verify=False)
    assert read_tables(spark, live).farmer.count() == 0
    tj.restore(spark, f"{root}/snaps", ts, live)
    assert _rows(read_tables(spark, live)) == before
    listing = tj.list_snapshots(spark, f"{root}/snaps").collect()
    assert {r["table_name"]: r["rows"] for r in listing}["farmer"] == 5
    assert all(r["bytes"] > 0 for r in listing if r["rows"]) and listing[0]["ts"] == "20260101_000000"


def test_import_rejects_missing_table(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.export_tables(t.with_(variety=None), f"{root}/export", fmt="csv")
    with pytest.raises(tj.ImportError_):
        tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt="csv")
    assert not tj.path_exists(spark, f"{root}/live/farmer")


def test_import_and_copy(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.export_tables(t, f"{root}/export", fmt="csv")
    counts = {(r["table_name"], r["season"]): r["rows"] for r in tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt="csv").collect()}
    assert counts[("farmer", "dry")] == 3 and counts[("association", "wet")] == 2
    assert _rows(read_tables(spark, f"{root}/live")) == _rows(t)
    out = tj.copy_tables(spark, f"{root}/live", f"{root}/copy").collect()
    assert sum(r["rows"] for r in out) == 14
    assert _rows(read_tables(spark, f"{root}/copy")) == _rows(t)


def test_import_rejects_missing_column(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.export_tables(t.with_(farmer=None), f"{root}/export")
    t.farmer.drop("kg").write.partitionBy("season").parquet(f"{root}/export/farmer")  # an export missing a column
    with pytest.raises(tj.ImportError_) as e:
        tj.import_replace(spark, f"{root}/export", f"{root}/live")
    assert "farmer: missing columns ['kg']" in str(e.value)


def test_failed_staged_write_leaves_tables_unchanged(spark):
    from pyspark.sql import functions as F

    root = tj.work_dir(spark)
    live = f"{root}/live"
    t = f1_tables(spark)
    tj.write_staged(spark, t, live)
    before = _rows(read_tables(spark, live))
    t2 = read_tables(spark, live)
    broken = t2.farmer.withColumn("kg", F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("kg")))
    with pytest.raises(Exception):
        tj.write_staged(spark, t2.with_(association=t2.association.limit(1), farmer=broken), live)
    assert _rows(read_tables(spark, live)) == before  # association not swapped either
    fs, p = tj._fs(spark, f"{live}/association")
    assert len(list(fs.listStatus(p))) == 1  # the folder of the failed write is gone


def test_incomplete_snapshot_is_refused(spark):
    root = tj.work_dir(spark)
    tj.write_staged(spark, f1_tables(spark), f"{root}/live")
    tj.snapshot(spark, f"{root}/live", f"{root}/snaps", ts="20260101_000000")
    before = _rows(read_tables(spark, f"{root}/live"))
    tj.store.delete(spark, f"{root}/snaps/farmer/ts=20260101_000000")
    with pytest.raises(FileNotFoundError, match="farmer"):
        tj.restore(spark, f"{root}/snaps", "20260101_000000", f"{root}/live")
    read_tables(spark, f"{root}/live").farmer.write.parquet(f"{root}/snaps/farmer/ts=20260102_000000")
    with pytest.raises(FileNotFoundError):  # no manifest: the snapshot was never finished
        tj.restore(spark, f"{root}/snaps", "20260102_000000", f"{root}/live")
    assert _rows(read_tables(spark, f"{root}/live")) == before


def test_failed_first_copy_leaves_nothing(spark):
    from pyspark.sql import functions as F

    root = tj.work_dir(spark)
    t = f1_tables(spark)
    broken = t.with_(farmer=t.farmer.withColumn("kg", F.when(F.col("id") > 0, F.raise_error(F.lit("boom"))).otherwise(F.col("kg"))))
    with pytest.raises(Exception):
        tj.write_staged(spark, broken, f"{root}/new")
    assert tj.store.state(spark, f"{root}/new")["tables"] == {}


def test_the_second_of_two_writers_is_refused(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    seen = tj.store.state(spark, root)
    tj.append_rows(spark, "farmer", t.farmer, root, seen)
    with pytest.raises(tj.store.ConcurrentCommit):
        tj.append_rows(spark, "farmer", t.farmer, root, seen)
    assert read_tables(spark, root).farmer.count() == 2 * t.farmer.count()


def test_csv_export_keeps_line_breaks(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    odd = spark.createDataFrame([("wet", 1, "a\nb\r\\n c"), ("wet", 2, "\\N"), ("dry", 1, "plain")], t.municipality.schema)
    tj.export_tables(t.with_(municipality=odd), f"{root}/export", fmt="csv")
    tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt="csv")
    assert _rows(read_tables(spark, f"{root}/live"))["municipality"] == sorted(tuple(r) for r in odd.collect())


def test_import_without_varieties(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.export_tables(t.with_(variety=None), f"{root}/export")
    tj.import_replace(spark, f"{root}/export", f"{root}/live", tables=["municipality", "association", "farmer"])
    assert read_tables(spark, f"{root}/live", with_variety=False).farmer.count() == t.farmer.count()


def test_vacuum_keeps_the_last_versions(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    for _ in range(4):
        tj.write_staged(spark, {"farmer": t.farmer}, root)
    tj.store.vacuum(spark, root, older_than=0)
    fs, p = tj._fs(spark, f"{root}/farmer")
    assert len([s for s in fs.listStatus(p) if s.getPath().getName().startswith("part=")]) == 2
    assert tj.store.read(spark, root, "farmer").count() == t.farmer.count()


def _files(spark, root, table="farmer"):
    """Data files of a table with their times."""
    fs, p = tj._fs(spark, f"{root}/{table}")
    found, out = fs.listFiles(p, True), set()
    while found.hasNext():
        st = found.next()
        if st.getPath().getName().endswith(".parquet"):
            out.add((st.getPath().toUri().getPath(), st.getModificationTime()))
    return out


def test_versions_in_use_outlive_the_next_commits(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    lazy = read_tables(spark, root).farmer
    for _ in range(3):
        tj.write_staged(spark, {"farmer": t.farmer}, root)
    assert lazy.count() == t.farmer.count()


def test_a_change_decided_on_older_tables_is_refused(spark):
    """A delete planned before an upload must not take the uploaded row away."""
    from ricefield.operators import changes

    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    stale = read_tables(spark, root)
    new = t.farmer.limit(1).selectExpr("season", "id + 1000 AS id", *[c for c in t.farmer.columns if c not in ("season", "id")])
    tj.append_rows(spark, "farmer", new, root, tj.store.state(spark, root))
    ids = t.farmer.select("season", "id").limit(1)
    with pytest.raises(tj.store.ConcurrentCommit):
        tj.write_staged(spark, stale.with_(farmer=changes.delete_farmers(stale.farmer, ids)[0]), root)
    assert read_tables(spark, root).farmer.where("id > 1000").count() == 1

    calls = []

    def change(tables):  # another writer commits while the first attempt is decided
        if not calls:
            tj.append_rows(spark, "farmer", new.withColumn("id", new.id + 1), root, tj.store.state(spark, root))
        calls.append(1)
        farmer, outcome = changes.delete_farmers(tables.farmer, ids)
        return {"farmer": farmer}, outcome

    tj.commit_change(spark, root, change)
    assert len(calls) == 2
    got = read_tables(spark, root).farmer
    assert got.count() == t.farmer.count() + 1 and got.join(ids, ["season", "id"]).isEmpty()


def test_a_change_leaves_the_files_of_other_seasons(spark):
    from ricefield.operators import changes

    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    before = _files(spark, root)
    ids = t.farmer.where("season = 'wet'").select("season", "id").limit(1)
    asked = ids.unionByName(ids.withColumn("id", ids.id + 999).withColumn("season", tj.F.lit("dry")))  # one without effect
    out = tj.commit_change(spark, root, lambda x: (lambda r: ({"farmer": r[0]}, r[1]))(changes.delete_farmers(x.farmer, asked)))
    assert sorted(r["status"] for r in out.collect()) == ["deleted", "not found"]
    new = {f for f in _files(spark, root) if f not in before}
    assert before <= _files(spark, root) and new and all("season=wet" in f for f, _ in new)
    assert _rows(read_tables(spark, root))["farmer"] == sorted(tuple(r) for r in t.farmer.join(ids, ["season", "id"], "left_anti").select(t.farmer.columns).collect())
    tables = tj.store.state(spark, root)
    assert [e for e in tables["tables"]["farmer"] if "season=dry" in e][0].split("/")[0] != [e for e in tables["tables"]["farmer"] if "season=wet" in e][0].split("/")[0]
    same = tj.commit_change(spark, root, lambda x: (lambda r: ({"farmer": r[0]}, r[1]))(changes.delete_farmers(x.farmer, asked.where("season = 'dry'"))))
    assert same.count() == 1 and tj.store.state(spark, root)["version"] == tables["version"]
    # old seasons of a part that is still named in others go alone
    tj.store.vacuum(spark, root, keep=1, older_than=0)
    assert _rows(read_tables(spark, root))["farmer"] and len(_files(spark, root)) < len(before | new)


def test_half_made_commit_files_are_harmless(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    fs, p = tj._fs(spark, tj.store.commit_path(root, 2))
    fs.create(p, False).close()  # an older writer was killed here
    assert _rows(read_tables(spark, root)) == _rows(t)
    tj.append_rows(spark, "farmer", t.farmer, root, tj.store.state(spark, root))
    assert read_tables(spark, root).farmer.count() == 2 * t.farmer.count()
    assert tj.store.versions(spark, root) == [1, 2, 3]


def test_commit_files_appear_whole_and_once(spark):
    """Many writers of one version: one wins, and whoever reads meanwhile reads it whole."""
    import json
    from concurrent.futures import ThreadPoolExecutor

    root = tj.work_dir(spark)
    path, text = f"{root}/_commits/000000000001.json", json.dumps({"x": "y" * 200_000})

    def write(k):
        try:
            tj.store.create_text(spark, path, text)
            return 1
        except FileExistsError:
            return 0

    def read(k):
        return all(tj.store._load(spark, root, v) is not None for v in tj.store.versions(spark, root) for _ in range(3))

    with ThreadPoolExecutor(8) as pool:
        wins, reads = [pool.submit(write, k) for k in range(16)], [pool.submit(read, k) for k in range(40)]
        assert sum(w.result() for w in wins) == 1 and all(r.result() for r in reads)


def test_a_changed_cell_is_refused(spark, monkeypatch):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.write_staged(spark, t, root)
    before = _rows(read_tables(spark, root))
    real = tj.store.add_folder

    def broken(df, where, table):  # same rows in number, one other cell
        return real(df.withColumn("name", tj.F.when(df.id == 1, "x").otherwise(df.name)) if table == "association" else df, where, table)

    monkeypatch.setattr(tj.store, "add_folder", broken)
    with pytest.raises(tj.WrittenRowsDiffer, match="association"):
        tj.write_staged(spark, t, root)
    monkeypatch.undo()
    assert _rows(read_tables(spark, root)) == before and tj.verify_store(spark, root) == []
    # a file exchanged later is found by the recorded checksums
    entry = [e for e in tj.store.state(spark, root)["tables"]["municipality"] if "wet" in e][0]
    t.municipality.where("season = 'wet'").withColumn("name", tj.F.lit("other")).drop("season").write.mode("overwrite").parquet(f"{root}/municipality/{entry}")
    assert tj.verify_store(spark, root) == ["municipality wet"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_an_export_that_is_not_its_manifest_is_refused(spark, fmt):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    tj.export_tables(t, f"{root}/export", fmt=fmt)
    tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt=fmt, complete=True)
    assert _rows(read_tables(spark, f"{root}/live")) == _rows(t)
    other = t.farmer.withColumn("area", tj.F.when(t.farmer.id == 1, 99.0).otherwise(t.farmer.area))
    if fmt == "csv":
        tj.csv_writer(tj._escape(other).write.mode("overwrite")).csv(f"{root}/export/farmer")
    else:
        tj.write_table(other, f"{root}/export", "farmer")
    with pytest.raises(tj.WrittenRowsDiffer, match="farmer"):
        tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt=fmt)
    assert _rows(read_tables(spark, f"{root}/live")) == _rows(t)
    tj.store.delete(spark, f"{root}/export/{tj.EXPORT_MANIFEST}")  # as if the export had not come to its end
    with pytest.raises(tj.ImportError_, match="manifest"):
        tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt=fmt, complete=True)


def test_pinned_snapshot_writes_no_rows_and_outlives_commits(spark):
    root = tj.work_dir(spark)
    live, t = f"{root}/live", f1_tables(spark)
    tj.write_staged(spark, t, live)
    before = _files(spark, live)
    tj.snapshot(spark, live, f"{root}/snaps", ts="20260101_000000", copy=False)
    tj.snapshot(spark, live, f"{root}/snaps", ts="20260102_000000")
    assert _files(spark, live) == before
    for _ in range(3):
        now = read_tables(spark, live)
        tj.write_staged(spark, now.with_(farmer=now.farmer.limit(1)), live)
    tj.store.vacuum(spark, live, keep=1, older_than=0)
    listing = {(r["ts"], r["table_name"]): r["rows"] for r in tj.list_snapshots(spark, f"{root}/snaps").collect()}
    assert listing["20260101_000000", "farmer"] == listing["20260102_000000", "farmer"] == t.farmer.count()
    written = _files(spark, live)
    tj.restore(spark, f"{root}/snaps", "20260101_000000", live)
    assert _rows(read_tables(spark, live)) == _rows(t) and _files(spark, live) == written
    tj.restore(spark, f"{root}/snaps", "20260101_000000", f"{root}/elsewhere")
    assert _rows(read_tables(spark, f"{root}/elsewhere")) == _rows(t)
    now = read_tables(spark, live)
    tj.write_staged(spark, now.with_(farmer=now.farmer.limit(1)), live)
    tj.drop_snapshot(spark, f"{root}/snaps", "20260101_000000")
    tj.write_staged(spark, read_tables(spark, live), live)
    tj.store.vacuum(spark, live, keep=1, older_than=0)
    assert not before & _files(spark, live)
    with pytest.raises(FileNotFoundError):
        tj.restore(spark, f"{root}/snaps", "20260101_000000", live)


def test_snapshot_names_are_in_their_zone(spark):
    at = tj.F.expr("TIMESTAMP '2026-03-04 20:30:59.9 UTC'")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(tj.snapshot_name(at)).first()[0] == "20260305_043059"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_odd_cells_survive_the_csv_export(spark):
    root = tj.work_dir(spark)
    t = f1_tables(spark)
    cells = ["a\x00b", "\\\\n", "\\\n", "\\", "x\\\\", "\\r\r", "\x00\\", ""]
    odd = spark.createDataFrame([("wet", k, c) for k, c in enumerate(cells)], t.municipality.schema)
    tj.export_tables(t.with_(municipality=odd), f"{root}/export", fmt="csv")
    tj.import_replace(spark, f"{root}/export", f"{root}/live", fmt="csv")
    assert _rows(read_tables(spark, f"{root}/live"))["municipality"] == sorted(tuple(r) for r in odd.collect())
