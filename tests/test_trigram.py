"""Indexed substring search against the scan."""

import random

import pytest

from fixtures import farmer_row, tables
from ricefield.operators import search, trigram
from ricefield.sources.model import FARMER

LABELS = {"wet": "Wet", "dry": "Dry"}


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(6)
    syllables = ["ra", "Mon", "del", "Cruz", "ñe", "İz", "-", " ", "03", "_", "%", "\\", "O'"]

    def name():
        return r.choice([None, "", "ab", "".join(r.choice(syllables) for _ in range(r.randrange(1, 6)))])

    muni = spark.createDataFrame([("wet", 1, "m"), ("dry", 1, "m")], "season string, id long, name string")
    assoc = spark.createDataFrame([("wet", 1, 1, "a"), ("dry", 1, 1, "a")], "season string, id long, municipality_id long, name string")
    rows = [(s, i, 1, name(), name(), name(), "", "", 1.0, "v", 1.0, 1.0) for s in ("wet", "dry") for i in range(150)]
    from ricefield.sources.model import Tables

    t = Tables(muni, assoc, spark.createDataFrame(rows, FARMER))
    return t, trigram.build_index(t.farmer, parts=4)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_rows_as_the_scan(made):
    t, index = made
    r = random.Random(2)
    terms = ["mon", "CRUZ", "ra", "r", "", "  ", "delCr", "ñera", "izra", "03_0", "mon%cruz", "%%%", "zzzz", "O'del", "raMonra", "-03", "\\\\ra"]
    values = [v for row in t.farmer.select("rsbsa", "last_name").collect() for v in row if v and "\\" not in v]
    for _ in range(4):
        v = r.choice(values)
        k = r.randrange(len(v))
        terms.append(v[k : k + r.randrange(1, 7)])
    hits = 0
    for term in terms:
        for sensitive in (False, True) if term in ("CRUZ", "mon%cruz") else (False,):
            want = found(search.farmer_search(t, term, LABELS, sensitive))
            assert found(search.farmer_search(t, term, LABELS, sensitive, index=index)) == want, term
            hits += len(want)
    assert hits > 50


def test_a_search_reads_its_lists_only(made):
    _, index = made
    assert index.candidates("delCruz").count() < index.rows.count() / 3
    plan = index.candidates("delCruz")._jdf.queryExecution().toString()
    assert "In(gram, [" in plan.split("PushedFilters")[-1] + plan
    assert trigram.grams_of(index.rows, "aB_cDEf%gh") == ["cde", "def"]


def test_empty_table(spark):
    t = tables(spark, [("wet", 1, "m")], [("wet", 1, 1, "a")], [farmer_row("wet", 1, 1)])
    index = trigram.build_index(t.farmer.where("id < 0"))
    assert index.candidates("abc").collect() == [] == index.candidates("a").collect()


def test_lists_of_a_piece_that_all_share_stay_short(spark, monkeypatch):
    rows = [farmer_row("wet" if k % 3 else "dry", k, 1, f"R-{k}", "Santos", f"Ana {k % 7}") for k in range(600)]
    t = tables(spark, [("wet", 1, "m"), ("dry", 1, "m")], [("wet", 1, 1, "a"), ("dry", 1, 1, "a")], rows)
    monkeypatch.setattr(trigram, "LIST", 10)
    index = trigram.build_index(t.farmer, parts=4)
    longest = index.postings.selectExpr("max(size(ids))").first()[0]
    assert 5 < longest < 30  # about 150 before
    for term in ("santos", "ana 3", "san%tos", "r-59"):
        want = found(search.farmer_search(t, term, LABELS))
        assert found(search.farmer_search(t, term, LABELS, index=index)) == want and want
