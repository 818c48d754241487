import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import odd_rows, prose

from ricefield.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXT = st.one_of(st.none(), st.text(st.sampled_from("ab \n\t\x0b#|é"), max_size=80), st.text(max_size=20))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_counts(texts):
    batch = quality.Texts(pa.array(texts, pa.string()))
    got = list(zip(*(getattr(batch, c).tolist() for c in quality.COUNTS)))
    assert got == [counts(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8), st.randoms())
def test_order_does_not_change_the_verdict(texts, r):
    batch = pa.array(texts, pa.string())
    rules = list(quality.RULES)
    alone = [any(rule.fails(quality.Texts(pa.array([t], pa.string())))[0] for rule in rules) for t in texts]
    r.shuffle(rules)
    assert (quality.cascade(quality.Texts(batch), tuple(rules)) >= 0).tolist() == alone


def test_later_rules_see_only_what_is_left():
    seen = []

    def rule(name, fails):
        def run(t):
            seen.append((name, len(t)))
            return fails(t)

        return quality.Rule(name, run)

    rules = (rule("a", lambda t: t.n_words < 2), rule("b", lambda t: t.n_words < 3), rule("c", lambda t: t.n_words < 0))
    verdict = quality.cascade(quality.Texts(pa.array(["x", "x y", "x y z", None])), rules)
    assert verdict.tolist() == [0, 1, -1, 0] and seen == [("a", 4), ("b", 2), ("c", 1)]


def test_rules_are_ordered_by_rejections_per_cost():
    rules = tuple(quality.Rule(n, None) for n in "abc")
    figures = [("a", 1000, 10, 1), ("b", 10, 10, 1), ("c", 1, 10, 0)]
    assert [r.name for r in quality.ordered(rules, figures)] == ["b", "a", "c"]


def test_judged_and_kept(documents):
    rows = odd_rows() + [(50, prose(5, 60)), (51, "BUY NOW!! " * 30), (52, " | ".join(prose(6, 40).split()))]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words): r for r in quality.judged(documents(rows, clashing=True)).collect()}
    assert set(got) == {(i, *counts(t)) for i, t in rows}
    for r in got.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    docs = documents(rows, clashing=True)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r.doc_id for r in quality.judged(docs).collect() if r.kept) and 50 in ids and 51 not in ids and 52 not in ids
    assert quality.keep_good(documents([])).collect() == [] == quality.judged(documents([])).collect()
