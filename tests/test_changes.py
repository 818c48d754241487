from pyspark.sql import functions as F

from fixtures import farmer_row, tables
from ricefield.operators import changes
from ricefield.sources.model import SEED_VARIETIES


def _t(spark):
    munis = [("wet", 1, "Alpha"), ("wet", 2, "Bravo"), ("dry", 1, "Alpha")]
    assocs = [("wet", 1, 1, "Rice One"), ("wet", 2, 1, "Corn"), ("wet", 3, 2, "Other"), ("dry", 1, 1, "Rice One")]
    farmers = [
        farmer_row("wet", 1, 1, "A"),
        farmer_row("wet", 2, 1, "B"),
        farmer_row("wet", 3, 2, "C"),
        farmer_row("wet", 4, 3, "D"),
        farmer_row("dry", 1, 1, "E"),
    ]
    return tables(spark, munis, assocs, farmers)


def test_insert_and_update_farmers(spark):
    t = _t(spark)
    props = spark.createDataFrame(
        [("wet", 1, 1, " R-9 ", "Cruz", "Ana", None, "", "1.5", "SL 8", "", "50"), ("wet", 1, 2, "", "Ng", "", "", "", "x", "", "1", "1")],
        "season string, association_id long, line long, rsbsa string, last_name string, first_name string, middle_name string, suffix string, area string, variety string, sacks string, kg string",
    )
    table, out = changes.insert_farmers(t.farmer, changes.form_rows(props), ["line"], association=t.association)
    o = {r["line"]: r for r in out.collect()}
    assert (o[1]["status"], o[1]["id"], o[1]["rsbsa"], o[1]["sacks"], o[1]["middle_name"]) == ("inserted", 5, "R-9", 0.0, "")
    assert o[2]["status"] == "invalid" and o[2]["id"] is None
    assert table.count() == 6
    orphan = spark.createDataFrame(
        [("wet", 99, 1, "R-9", "Cruz", "Ana", "", "", "1", "", "1", "1")],
        "season string, association_id long, line long, rsbsa string, last_name string, first_name string, middle_name string, suffix string, area string, variety string, sacks string, kg string",
    )
    _, out = changes.insert_farmers(t.farmer, changes.form_rows(orphan), ["line"], association=t.association)
    assert [(r["status"], r["id"]) for r in out.collect()] == [("no association", None)]
    edits = spark.createDataFrame(
        [("wet", 1, 1, "Z", "New", "N", "", "", "2", "SL 8", "3", "4"), ("wet", 1, 2, "Z2", "Newer", "N", "", "", "2", "", "3", "4"), ("wet", 99, 3, "Q", "", "", "", "", "", "", "", "")],
        "season string, id long, line long, rsbsa string, last_name string, first_name string, middle_name string, suffix string, area string, variety string, sacks string, kg string",
    )
    table, out = changes.update_farmers(t.farmer, changes.form_rows(edits), ["line"])
    st = {r["line"]: r["status"] for r in out.collect()}
    assert st == {1: "superseded", 2: "updated", 3: "not found"}
    row = table.where("season = 'wet' AND id = 1").first()
    assert (row["last_name"], row["association_id"], row["area"]) == ("Newer", 1, 2.0)


def test_delete_municipality_cascade(spark):
    t = _t(spark)
    out, _ = changes.delete_municipalities(t, spark.createDataFrame([("wet", 1), ("wet", 42)], "season string, id long"))
    assert sorted(r["name"] for r in out.municipality.collect()) == ["Alpha", "Bravo"]  # dry Alpha untouched
    assert sorted((r["season"], r["id"]) for r in out.association.collect()) == [("dry", 1), ("wet", 3)]
    assert sorted((r["season"], r["id"]) for r in out.farmer.collect()) == [("dry", 1), ("wet", 4)]


def test_delete_association_and_farmers(spark):
    t = _t(spark)
    out, _ = changes.delete_associations(t, spark.createDataFrame([("wet", 1)], "season string, id long"))
    assert sorted(r["id"] for r in out.farmer.where("season='wet'").collect()) == [3, 4]
    table, res = changes.delete_farmers(t.farmer, spark.createDataFrame([("wet", 3), ("wet", 77)], "season string, id long"))
    assert {r["id"]: r["status"] for r in res.collect()} == {3: "deleted", 77: "not found"}
    assert table.count() == 4


def test_add_associations_unique(spark):
    t = _t(spark)
    props = spark.createDataFrame(
        [
            ("wet", 1, " rice one ", 1),  # duplicate of existing (other case, padding)
            ("wet", 1, "Wheat", 2),
            ("wet", 1, "WHEAT", 3),  # duplicate inside the batch
            ("wet", 1, "  ", 4),  # blank
            ("wet", 2, "Rice One", 5),  # other municipality: fine
        ],
        "season string, municipality_id long, name string, line long",
    )
    _, out = changes.add_associations(t.association, props, ["line"], unique=True, municipality=t.municipality)
    st = {r["line"]: (r["status"], r["new_id"]) for r in out.collect()}
    assert st == {1: ("duplicate", None), 2: ("inserted", 4), 3: ("duplicate", None), 4: ("blank", None), 5: ("inserted", 5)}
    table, out = changes.add_associations(t.association, props, ["line"], unique=False)
    assert sorted(r["status"] for r in out.collect()) == ["blank", "inserted", "inserted", "inserted", "inserted"]
    assert table.where("season = 'wet'").count() == 7
    orphan = spark.createDataFrame([("dry", 2, "Corn", 1)], "season string, municipality_id long, name string, line long")
    _, out = changes.add_associations(t.association, orphan, ["line"], unique=True, municipality=t.municipality)
    assert [r["status"] for r in out.collect()] == ["no municipality"]


def test_rename_associations(spark):
    t = _t(spark)
    ren = spark.createDataFrame(
        [
            ("wet", 1, "RICE ONE", 1),  # own name, other case: allowed
            ("wet", 2, "rice one", 2),  # taken by id 1
            ("wet", 3, " ", 3),  # blank
            ("wet", 9, "X", 4),  # unknown
            ("wet", 2, "Barley", 5),
        ],
        "season string, id long, name string, line long",
    )
    table, out = changes.rename_associations(t.association, ren, ["line"], unique=True)
    st = {r["line"]: r["status"] for r in out.collect()}
    assert st == {1: "renamed", 2: "duplicate", 3: "blank", 4: "not found", 5: "renamed"}
    names = {r["id"]: r["name"] for r in table.where("season='wet'").collect()}
    assert names == {1: "RICE ONE", 2: "Barley", 3: "Other"}
    _, out = changes.rename_associations(t.association, ren, ["line"], unique=False)
    assert {r["line"]: r["status"] for r in out.collect()}[2] == "renamed"


def test_add_and_rename_municipalities(spark):
    t = _t(spark)
    props = spark.createDataFrame([("dry", " ALPHA", 1), ("dry", "Delta", 2), ("wet", "alpha", 3)], "season string, name string, line long")
    _, out = changes.add_municipalities(t.municipality, props, ["line"], unique=True)
    assert {r["line"]: r["status"] for r in out.collect()} == {1: "duplicate", 2: "inserted", 3: "duplicate"}
    _, out = changes.add_municipalities(t.municipality, props, ["line"], unique=False)
    assert {r["line"]: r["new_id"] for r in out.collect()} == {1: 2, 2: 3, 3: 3}
    table, out = changes.rename_municipalities(t.municipality, spark.createDataFrame([("wet", 2, "Alpha", 1)], "season string, id long, name string, line long"), ["line"])
    assert out.first()["status"] == "renamed"  # no duplicate check for municipalities
    assert sorted(r["name"] for r in table.where("season='wet'").collect()) == ["Alpha", "Alpha"]


def test_seed_varieties(spark):
    v = spark.createDataFrame([("wet", 1, "SL 8"), ("wet", 2, "jackpot")], "season string, id long, name string")
    table, added = changes.seed_varieties(v, SEED_VARIETIES, ["wet", "dry"])
    got = {(r["season"], r["name"]): r["id"] for r in added.collect()}
    assert len([k for k in got if k[0] == "wet"]) == 8 and ("wet", "SL 8") not in got
    assert got[("wet", "Bigante")] == 3 and got[("dry", "Bigante")] == 1 and got[("dry", "TH 82")] == 9
    again, added2 = changes.seed_varieties(table, SEED_VARIETIES, ["wet", "dry"])
    assert added2.count() == 0


def test_form_numbers_as_python_reads_them(spark):
    from ricefield.functions.exprs import form_number

    cells = ["12d", "3f", "   ", "1_0", "", None, " 1.5e1 ", ".5", "5.", "1,200", "_1", "1__0", "-inf", "+2", "\x1c7\x1f", "0x1", "\t\x0b8\r\n ", "\xa09\u2003", "\xa0\x1c6"]

    def python(x):
        try:
            return float(x or 0)
        except ValueError:
            return None

    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", form_number("c").alias("v")).collect()
    assert [r["v"] for r in sorted(got)] == [python(c) for c in cells]


def test_unknown_ids_come_before_other_faults(spark):
    t = _t(spark)
    columns = "season string, id long, line long, rsbsa string, last_name string, first_name string, middle_name string, suffix string, area string, variety string, sacks string, kg string"
    edits = spark.createDataFrame([("wet", 99, 1, "", "", "", "", "", "x", "", "", ""), ("wet", 1, 2, "", "", "", "", "", "x", "", "", "")], columns)
    _, out = changes.update_farmers(t.farmer, changes.form_rows(edits), ["line"])
    assert {r["line"]: r["status"] for r in out.collect()} == {1: "not found", 2: "invalid"}
    ren = spark.createDataFrame([("wet", 9, " ", 1)], "season string, id long, name string, line long")
    _, out = changes.rename_associations(t.association, ren, ["line"], unique=True)
    assert out.first()["status"] == "not found"
