"""The operators' registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ricefield.llm.chat import op2_role_repair
from ricefield.llm.decontaminate import op5_spaced_seeds
from ricefield.llm.hard_negatives import ORACLE as NEGATIVES_SQL
from ricefield.llm.hard_negatives import op12_inverted_multi_index
from ricefield.llm.html_text import op3_tree_scoring
from ricefield.llm.line_dedup import op8_fuzzy_lines
from ricefield.llm.lsh_forest import op7_lsh_forest
from ricefield.llm.merkle import ORACLE as MERKLE_SQL
from ricefield.llm.merkle import op13_merkle_midstates
from ricefield.llm.packing import op6_best_fit_packing
from ricefield.llm.quality import op4_quality_cascade
from ricefield.llm.records import op9_binary_records
from ricefield.llm.repeated_spans import op10_bwt_merge
from ricefield.llm.sharding import op1_virtual_slots
from ricefield.llm.toxicity import op11_toxic_segments


QUERIES = (
    op1_virtual_slots,
    op2_role_repair,
    op3_tree_scoring,
    op4_quality_cascade,
    op5_spaced_seeds,
    op6_best_fit_packing,
    op7_lsh_forest,
    op8_fuzzy_lines,
    op9_binary_records,
    op10_bwt_merge,
    op11_toxic_segments,
    op12_inverted_multi_index,
    op13_merkle_midstates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op12_inverted_multi_index": NEGATIVES_SQL, "op13_merkle_midstates": MERKLE_SQL}
