import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm.conftest import odd_rows, prose
from pyspark.sql import functions as F

from ricefield.llm import merkle, sha256


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], Counter()
    for j, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now, proof = leaf(*r[:4], lower(r[4])) if tampered else own, ""
            for levels, at in ((trees[s], i), (top, j)):
                for level in levels[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    now, at = h(*run[:slot], now, *run[slot + 1 :]), at // 16
            out[r[0], own, trees[s][-1][0], root, h(proof), now, now == root] += 1
    return out


def run(spark, tmp_path, rows, more=""):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    frame = spark.createDataFrame(rows, schema)
    if more:
        frame = frame.selectExpr("*", *[f"1 AS {c}" for c in more.split()])
    folder = str(tmp_path / f"t{random.random()}")
    frame.write.parquet(f"{folder}/documents.parquet")
    got = merkle.op13_merkle_midstates(spark, folder)
    return Counter(tuple(r) for r in got.collect())


def test_lanes_hash_as_the_library_does():
    texts = [prose(k, 10 + k)[:64].ljust(64, "x") for k in range(60)]
    blocks = sha256.words_of_text("".join(texts).encode())
    states = sha256.absorb(sha256.absorb(sha256.fresh(60), blocks), blocks[::-1].copy())
    digests = sha256.text_of_words(sha256.hex_words(sha256.finish(states, np.full(60, 2)))).decode()
    for k in range(60):
        assert digests[64 * k : 64 * k + 64] == h(texts[k], texts[59 - k])


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    names = [None, "", "é", "Z", "a", *(f"s{k}" for k in range(14))]
    rows = [(k, "hot", "en", 3, prose(k, 3).title()) for k in range(5000)]  # four levels, two passes
    rows += [(5000 + k, r.choice(names), r.choice(["en", None]), r.choice([None, 7]), prose(k, 4).title()) for k in range(700)]
    r.shuffle(rows)
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert not all(k[-1] for k in got)


def test_odd_rows_clashing_columns_and_a_lone_leaf(spark, tmp_path):
    rows = [(i, s, None, 1, t) for i, t in odd_rows() for s in (None, "src0")]
    assert run(spark, tmp_path, rows, "idx n leaf level kind block digest states path new_leaf subroot of") == brute(rows)
    assert run(spark, tmp_path, rows[2:3]) == brute(rows[2:3])
    assert run(spark, tmp_path, [(10, "a", "b", 1, "ABC"), (0, "b", "b", 1, "ABC")]) == brute([(10, "a", "b", 1, "ABC"), (0, "b", "b", 1, "ABC")])
    assert not run(spark, tmp_path, [])


def test_a_stored_manifest_takes_a_change(spark):
    rows = [(k, f"s{k % 3}", "en", 1, f"text {k}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.when(F.col("doc_id") == 77, merkle.leaf_of(docs, text=F.lit("changed"))).otherwise(merkle.leaf_of(docs))
    folded = merkle.fold(merkle.build(docs, new=changed), "new").where("doc_id = 77").first()
    rows[77] = (*rows[77][:4], "changed")
    docs = spark.createDataFrame(rows, docs.schema)
    assert folded["folded_root"] == merkle.build(docs).root != folded["root"]
