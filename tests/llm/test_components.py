import random

import pytest

from ricefield.llm import components as cc


def brute(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return {x: r for x, r in root.items() if x != r}


def graph():
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    loose = [(r.randrange(-300, 0), r.randrange(-300, 0)) for _ in range(200)]
    pairs = [*chain, *star, *loose, (5, 5), (7, 8), (8, 7), (2**62, -(2**62))]
    r.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("local", [7, 50_000])
def test_components_match_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(cc, "LOCAL", local)
    pairs = graph()
    rows = cc.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    assert len(rows) == len({r["id"] for r in rows})
    assert {r["id"]: r["root"] for r in rows} == brute(pairs)


def test_few_links_need_no_rounds(spark, monkeypatch):
    def star(links, large):
        raise AssertionError("a round of joins for links that fit one task")

    monkeypatch.setattr(cc, "_star", star)
    rows = cc.components(spark.createDataFrame(graph(), "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in rows} == brute(graph())
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
