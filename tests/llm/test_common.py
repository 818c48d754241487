import os
import re
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from llm.conftest import prose

from ricefield.llm.common import ragged_take, sized, words_of


def test_batches_are_split_by_bytes_and_hold_the_same_rows():
    texts = [prose(k, k % 40) for k in range(200)] + [None, "", "x" * 5000]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["k", "text"])
    parts = list(sized(iter([batch]), "text", 2000))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(sized(iter([batch.slice(0, 0)]), "text")) == []


def test_words_of_parts_and_slices():
    texts = ["Ab  cD\x0b", None, "", " É e ", "\n", "LAST One"] * 30
    array = pa.array(texts)
    for part, own in ((array, texts), (array.slice(7, 50), texts[7:57])):
        flat, ends = words_of(part, lower=True)
        flat = flat.to_pylist()
        for k, t in enumerate(own):
            want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            assert flat[ends[k] : ends[k + 1]] == want


def test_ragged_take():
    values = np.arange(20)
    got = ragged_take(values, np.array([3, 0, 10]), np.array([2, 0, 3]))
    assert got.tolist() == [3, 4, 10, 11, 12]


def test_only_the_last_result_stays(spark):
    from ricefield.llm.common import only_last_kept, written

    def folder(df):
        return df.inputFiles()[0].rsplit("/", 1)[0]

    kept = written(spark.range(2), "outside")
    with only_last_kept(spark):
        first = folder(written(spark.range(3), "first"))
        with only_last_kept(spark):
            inner = folder(written(spark.range(4), "inner"))
            written(spark.range(5), "inner-last")
        last = written(spark.range(6), "last")
    after = folder(written(spark.range(7), "after"))
    there = [os.path.exists(unquote(urlparse(x).path)) for x in (first, inner, after)]
    assert there == [False, False, True] and kept.count() == 2 and last.count() == 6


def test_near_and_line_duplicates_leave_what_is_read_later_only(spark, tmp_path, monkeypatch):
    from ricefield.llm import common, line_dedup, lsh_forest

    monkeypatch.setattr(common, "shared_folder", lambda s, name: f"{tmp_path}/{name}-{len(os.listdir(tmp_path))}")
    docs = spark.createDataFrame([(k, prose(k // 2, 60)) for k in range(40)], "doc_id long, text string").repartition(3)
    lines = line_dedup.dedupe_lines(docs, every_line=True)
    assert [x.split("-")[:2] for x in os.listdir(tmp_path)] == [["lines", "gone"]]
    assert lines.where("text <> ''").count() == 20
    one = lsh_forest.keep_one(docs)
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)) == ["forest-again", "forest-gone", "forest-left", "lines-gone"]
    assert sorted(r["doc_id"] for r in one.collect()) == list(range(0, 40, 2))
