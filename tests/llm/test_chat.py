import itertools
from collections import defaultdict

import pytest

from ricefield.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, cost int, chunk int"


def legal(states):
    return all(b in chat.NEXT[a] for a, b in zip([0, *states], states)) and (states[-1] if states else 0) in chat.FINAL


def brute(roles):
    """Least cost over all ways to label, merge and insert."""
    best = chat.INF
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            cost, state, ok = 0, 0, True
            for role, to, merge in zip(roles, labels, merges):
                known = role in chat.ROLES
                cost += 0 if known and chat.ROLES[to - 1] == role else chat.RELABEL if known else chat.RELABEL_UNKNOWN
                if merge:
                    ok &= state == to
                    cost += chat.MERGE
                else:
                    for n in range(4):  # empty turns put in before it
                        if any(legal_path(state, mid, to) for mid in itertools.product((1, 2, 3), repeat=n)):
                            cost += chat.INSERT * n
                            break
                    else:
                        ok = False
                state = to
            if ok and state in chat.FINAL or not roles:
                best = min(best, cost)
    return best


def legal_path(state, middle, to):
    path = [state, *middle, to]
    return all(b in chat.NEXT[a] for a, b in zip(path, path[1:]))


def frame(spark, convs):
    rows = [(c, t, role, text, 9, 9) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA)


def check(convs, rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    for c, turns in convs.items():
        own = sorted(by[c], key=lambda r: (r.chunk, r.place))
        assert [r.role for r in own] == [t[0] for t in turns]
        text = "".join(r.rendered for r in own)
        states = [chat.ROLES.index(p.split("\n", 1)[0]) + 1 for p in text.split("<|im_start|>")[1:]]
        assert legal(states), (c, text)
        assert text.count("<|im_end|>\n") == len(states) and text.endswith("<|im_end|>\n")
        for _, body in turns:
            assert (body or "") in text
        if len(turns) <= 5:
            assert sum(r.cost for r in own) == brute([t[0] for t in turns])
    assert len(rows) == sum(map(len, convs.values()))


ROLES = ("user", "assistant", "system", None, "tool")


@pytest.mark.parametrize("chunk", [1024, 2])
def test_all_short_conversations(spark, chunk):
    convs, n = {}, 0
    for size in (1, 2, 3):
        for roles in itertools.product(ROLES, repeat=size):
            convs[n] = [(r, f"t{n}.{k}") for k, r in enumerate(roles)]
            n += 1
    for k, roles in enumerate(itertools.product(ROLES, repeat=5)):
        if k % 97 == 0:
            convs[n] = [(r, f"t{n}.{k}") for k, r in enumerate(roles)]
            n += 1
    check(convs, chat.repair(frame(spark, convs), chunk).collect())


def test_chunks_cost_what_one_run_costs(spark):
    import random

    r = random.Random(3)
    convs = {0: [(r.choice(ROLES), f"turn {k}") for k in range(3000)], 1: [("user", "a"), ("assistant", "b")]}
    whole = chat.repair(frame(spark, convs), 10_000).collect()
    parts = chat.repair(frame(spark, convs), 64).collect()
    check(convs, parts)
    assert sum(x.cost for x in whole) == sum(x.cost for x in parts) > 0


def test_odd_rows(spark):
    rows = [(None, 0, "assistant", None, 1, 1), (None, None, "user", "x", 1, 1), (5, 1, "user", "same", 1, 1), (5, 1, "user", "same", 1, 1), (6, 3, None, "", 1, 1)]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    five = sorted((r for r in got if r.conv_id == 5), key=lambda r: r.place)
    assert "".join(r.rendered for r in five) == "<|im_start|>user\nsame\nsame<|im_end|>\n"
    assert chat.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_legal_conversations_stay(spark):
    convs = {0: [("system", "s"), ("user", "u"), ("assistant", "a")], 1: [("user", "u")], 2: [("user", "q"), ("assistant", "a")] * 4}
    rows = chat.repair(frame(spark, convs)).collect()
    assert all(r.cost == 0 and not r.merged and not r.n_inserted for r in rows)
