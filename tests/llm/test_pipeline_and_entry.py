import pathlib
import shutil
import subprocess
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.conftest import prose

from ricefield.llm import decontaminate, packing, token_ids
from ricefield.llm.common import shared_folder
from ricefield.llm.quality import judged

ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def planted(spark, documents):
    """A folder with documents and benchmark, and which documents may stay."""
    item = prose(9000, 30)
    clean = [(k, "\n".join(prose(100 * k + j, 40) for j in range(4))) for k in range(30)]
    junk = [(100, "BUY NOW!! " * 50), (101, "one two three"), (102, None), (103, "")]
    copies = [(200 + k, clean[k][1]) for k in range(10)]
    near = [(300 + k, clean[k][1].replace(" wb", " wc", 2)) for k in range(10)]
    leaks = [(400 + k, prose(5000 + k, 30) + "\n" + item + " " + prose(6000 + k, 30)) for k in range(5)]
    folder = shared_folder(spark, "planted").replace("file:", "")
    docs = documents(clean + junk + copies + near + leaks)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i for i, _ in clean}, docs.columns


def test_stages_take_effect(spark, planted):
    folder, clean, columns = planted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    assert all(clean <= ids for ids in left)
    assert not left[0] & {100, 101, 102, 103}
    assert left[3] == clean


def test_run_packs_what_is_left(spark, planted):
    folder, clean, _ = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == clean
    assert sum(r.length for r in rows) > 0


def test_quality_stage_keeps_what_the_query_keeps(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in judged(docs).collect() if r.kept}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, folder).collect()} == kept


def test_entry_works_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "ricefield"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_line_stage_keeps_one_of_each_line(spark, documents):
    """A document of repeated lines does not take the lines down that it alone keeps."""
    a, b, c, d, e = (prose(7000 + k, 40) for k in range(5))
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}\n{c}\n{d}"), (3, f"{d}\n{e}"), (4, f"{a}\n--\n{b}"), (5, None), (6, "")]
    got = corpus_pipeline.line_dedup(spark, documents(rows), None).collect()
    assert {r.doc_id: r.text for r in got} == {1: f"{a}\n{b}\n{c}", 2: d, 3: e, 5: None, 6: ""}
    assert next(r.n_chars for r in got if r.doc_id == 2) == len(d)


class NoTask:
    @staticmethod
    def get():
        return NoTask()

    def partitionId(self):
        return 0


def test_packing_and_decontamination_work_on_a_bounded_part_at_once(monkeypatch):
    texts, seen = [prose(k, 5000) for k in range(250)], []
    batch = pa.record_batch([pa.array(range(250)), pa.array(range(250)), pa.array(texts)], ["doc_id", "text_hash", "text"])
    for module in (packing, decontaminate):
        monkeypatch.setattr(module, "TaskContext", NoTask)
    encode, hashes = token_ids.TokenIds.encode, decontaminate.token_hashes
    monkeypatch.setattr(token_ids.TokenIds, "encode", lambda self, x: seen.append(x.nbytes) or encode(self, x))
    monkeypatch.setattr(decontaminate, "token_hashes", lambda x: seen.append(x.nbytes) or hashes(x))
    pieces = packing.pack_partition(public_tokenizers.path(packing.VOCABULARY), 4096, 1)(iter([batch]))
    assert {i for b in pieces for i in b.column("doc_id").to_pylist()} == set(range(250))

    class Nothing:
        value = np.zeros(1 << decontaminate.BITS - 3, np.uint8)

    list(decontaminate._regions(Nothing, 20, decontaminate.MASKS)(iter([batch])))
    assert sum(map(len, texts)) > 6_000_000 and len(seen) >= 4 and max(seen) < 4_100_000
