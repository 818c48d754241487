import random

from llm.conftest import odd_rows, prose

from ricefield.llm import decontaminate


def item_frame(spark, items):
    return spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, hash int")


def substituted(text, every):
    return " ".join(f"sub{k}" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_finds_what_holds_an_item(spark, documents):
    r = random.Random(1)
    items = [(k, prose(1000 + k, r.randrange(8, 70))) for k in range(40)]
    clean = [(k, prose(k, 150)) for k in range(100)]
    # a quarter of an item is too little
    clean += [(100 + k, prose(k, 60) + " " + " ".join(t.split()[: len(t.split()) // 4]) + " " + prose(k + 500, 60)) for k, t in items]
    held = [(200 + k, f"{prose(k, 40)}\n{t.upper()}, {prose(k + 300, 40)}") for k, t in items]
    held += [(300 + k, prose(k, 40) + " " + substituted(t, 7) + " " + prose(k, 9)) for k, t in items if len(t.split()) >= 21]
    held += [(400 + k, substituted(t, 10)) for k, t in items if len(t.split()) >= 30]
    docs = documents(clean + held, clashing=True)
    got = decontaminate.overlaps(docs, item_frame(spark, items)).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == sorted((d, d % 100) for d, _ in held)
    left = decontaminate.remove_contaminated(docs, item_frame(spark, items))
    assert left.schema == docs.schema and sorted(x.doc_id for x in left.collect()) == sorted(d for d, _ in clean)
    one = next(x for x in got if x.doc_id == 200)
    assert one.doc_start == 40 and one.n_equal == one.item_tokens == one.n_tokens


def test_an_insertion_splits_the_diagonal(spark, documents):
    t = prose(77, 60).split()
    docs = documents([(1, " ".join(t[:30] + ["new", "words"] + t[30:]))])
    (got,) = decontaminate.overlaps(docs, item_frame(spark, [(5, " ".join(t))])).collect()
    assert got.n_equal == 60


def test_odd_rows(spark, documents):
    rows = odd_rows()
    items = [(None, "x"), (1, None), (2, ""), (3, "too short"), (4, prose(2, 200)), (4, prose(2, 200)), (5, prose(3, 40))]
    docs = documents(rows + [(None, prose(3, 40)), (20, prose(3, 40)), (20, "another text of the same id")])
    got = decontaminate.overlaps(docs, item_frame(spark, items)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == [(-1, 5), (9, 4), (10, 4), (20, 5)]
    left = decontaminate.remove_contaminated(docs, item_frame(spark, items)).collect()
    assert len(left) == len(rows) + 3 - 2 - 3
    empty = documents([])
    assert decontaminate.overlaps(empty, item_frame(spark, items)).collect() == []
    assert decontaminate.overlaps(docs, item_frame(spark, [])).collect() == []
    assert len(decontaminate.remove_contaminated(docs, item_frame(spark, [])).collect()) == len(rows) + 3


def test_best_segment():
    import numpy as np

    assert decontaminate.best_segment(np.array([0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1], bool)) == (1, 8)
    assert decontaminate.best_segment(np.zeros(4, bool))[1] == 0


def test_a_rewritten_stretch_leaves_both_sides(spark, documents):
    docs, items = [], []
    for k, (n, gap) in enumerate([(30, 20), (40, 20), (20, 19)]):
        t = prose(800 + k, 2 * n + gap).split()
        items.append((k, " ".join(t)))
        docs.append((k, " ".join(t[:n] + prose(900 + k, gap, 3000).upper().replace("W", "q").split() + t[n + gap :])))
    got = decontaminate.overlaps(documents(docs), item_frame(spark, items)).collect()
    assert sorted((x.doc_id, x.item_id, x.n_equal) for x in got) == [(0, 0, 60), (1, 1, 80), (2, 2, 40)]


def test_segments():
    import numpy as np

    runs = np.array(([True] * 6 + [False] * 2) * 8)  # alike enough only one by one
    assert sum(runs[a:b].sum() for a, b in decontaminate.segments(runs)) == 48
    assert decontaminate.segments(np.array([True] * 5 + [False] * 9 + [True] * 5)) == []


def test_short_items(spark, documents):
    """Items shorter than the masks are found whole, and with one token of five or more changed."""
    items = [(n, prose(1200 + n, n)) for n in range(1, 13)]
    held, clean = [], []
    for n, t in items:
        held.append((100 * n, f"{prose(n, 30)} {t} {prose(n + 50, 30)}"))
        held.append((100 * n + 1, t.upper()))
        for k in range(n):
            words = t.split()
            words[k] = "other"
            (held if 5 <= n < 12 else clean if n < 5 else []).append((100 * n + 10 + k, f"{prose(n, 9)} {' '.join(words)} {prose(n, 9)}"))
        if 1 < n < 6:
            clean.append((100 * n + 2, " ".join(t.split()[1:])))
    got = decontaminate.overlaps(documents(held + clean), item_frame(spark, items)).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert {(d, d // 100) for d, _ in held} <= found
    assert not {(d, d // 100) for d, _ in clean} & found
    one = next(x for x in got if (x.doc_id, x.item_id) == (700, 7))
    assert (one.doc_start, one.n_tokens, one.n_equal, one.item_tokens) == (30, 7, 7, 7)
