"""Quality rules as a short-circuit cascade.

A rule says of each text whether it fails.  Before the run, every rule is timed alone on a
bounded sample (``SAMPLE_ROWS``, a documented parameter), together with the share of texts
that it rejects; the rules then run in order of rejections per second.  A text that fails a
rule is not shown to later ones.  The order decides only the cost: a text is kept when no
rule fails, whatever the order.

Counts, over the whole text: words are ``[^\\x20\\x09-\\x0D]+``; ``n_dup_lines`` counts
lines with a word that equal an earlier line; ``n_repeat_words`` counts words that lie in
a window of five words which the text has twice or more.

Cases: a null or empty text has no words and fails ``few_words``; a text of any length is
one row and batches are split by bytes; repeated rows are judged each for itself; an empty
table gives an empty result; other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.llm.common import released, sized, table, words_of

WINDOW, SAMPLE_ROWS = 5, 2000
BATCH = 1_000_000  # bytes of text worked on at once; a rule's arrays are several times as large
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"


class Texts:
    """A batch of texts; each count is made when a rule first asks for it."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "").cast(pa.large_string())

    def __len__(self) -> int:
        return len(self.texts)

    def _count(self, pattern: str) -> np.ndarray:
        return pc.count_substring_regex(self.texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def words(self) -> tuple[pa.Array, np.ndarray]:
        return words_of(self.texts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[1])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return pc.utf8_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64) - self._count(SPACE)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line with a word: its text's number, and a code that equal lines share."""
        lists = pc.split_pattern(self.texts, "\n")
        flat = lists.flatten().dictionary_encode()
        wordy = pc.match_substring_regex(flat.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(self)), np.diff(np.asarray(lists.offsets, np.int64)))
        codes = flat.indices.to_numpy().astype(np.int64)
        keep = wordy[codes] if len(codes) else np.zeros(0, bool)
        return owner[keep], codes[keep]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        owner, codes = self.lines
        pairs = np.unique(owner * (codes.max(initial=0) + 1) + codes)
        return self.n_lines - np.bincount(pairs // (codes.max(initial=0) + 1), minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        flat, ends = self.words
        n = len(flat)
        if n < WINDOW:
            return np.zeros(len(self), np.int64)
        owner = np.repeat(np.arange(len(self), dtype=np.uint64), np.diff(ends))
        code = flat.dictionary_encode().indices.to_numpy().astype(np.uint64)
        with np.errstate(over="ignore"):
            code = mixed(code + np.uint64(1))
            key = owner[: n - WINDOW + 1].copy()
            for k in range(WINDOW):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + code[k : n - WINDOW + 1 + k])
        inside = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
        again = np.zeros(n, bool)
        at = np.flatnonzero(inside)
        again[at] = pd.Series(key[at]).duplicated(keep=False).to_numpy()
        covered = again.copy()
        for k in range(1, WINDOW):
            covered[k:] |= again[:-k]
        total = np.concatenate([[0], np.cumsum(covered)])
        return np.diff(total[ends])

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words that equal the word before."""
        flat, ends = self.words
        code = flat.dictionary_encode().indices.to_numpy()
        same = np.zeros(len(code), bool)
        same[1:] = code[1:] == code[:-1]
        same[ends[:-1][np.diff(ends) > 0]] = False  # a text's first word has none before it
        return np.diff(np.concatenate([[0], np.cumsum(same)])[ends])

    @cached_property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def where(self, rows: np.ndarray) -> Texts:
        """The texts of ``rows``, with the counts made so far."""
        out = Texts(self.texts.filter(pa.array(rows)))
        for name, made in self.__dict__.items():
            if isinstance(made, np.ndarray):
                out.__dict__[name] = made[rows]
        if "words" in self.__dict__:
            flat, ends = self.words
            sizes = np.diff(ends)
            out.__dict__["words"] = (flat.filter(pa.array(np.repeat(rows, sizes))), np.concatenate([[0], np.cumsum(sizes[rows])]))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Texts], np.ndarray]


def _of(pattern: str):
    return lambda t: t._count(pattern)


RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * t.n_lines),
    Rule("stutter", lambda t: 100 * t.n_stutter > 30 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("letters", lambda t: 2 * _of(r"\p{L}")(t) < t.word_chars),
    Rule("capitals", lambda t: 2 * _of(r"\p{Lu}")(t) > _of(r"\p{L}")(t)),
    Rule("exclamations", lambda t: 10 * _of(r"!")(t) > 3 * t.n_words),
    Rule("ellipses", lambda t: 100 * _of(r"(?m)(\.\.\.|…)\s*$")(t) > 30 * t.n_lines),
    Rule("bullets", lambda t: 100 * _of(r"(?m)^\s*[-•*‣]\s")(t) > 90 * np.maximum(t.n_lines, 1)),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, int]]:
    """(rule, nanoseconds, texts, rejected) of each rule alone, on a sample of about
    ``sample_rows`` texts."""
    n = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(sized(batches, "text", BATCH)):
            rows = []
            for rule in rules:
                texts, began = Texts(batch.column("text")), time.perf_counter_ns()
                failed = int(rule.fails(texts).sum())
                rows.append((rule.name, time.perf_counter_ns() - began, len(texts), failed))
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["rule", "ns", "n", "failed"])

    runs = sample.mapInArrow(run, "rule string, ns long, n long, failed long")
    # one row a rule
    return [tuple(r) for r in runs.groupBy("rule").agg(F.sum("ns"), F.sum("n"), F.sum("failed")).collect()]


def ordered(rules: tuple[Rule, ...], figures: list[tuple[str, int, int, int]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; a rule that no sample row met keeps its
    place among equals."""
    gain = {name: failed / max(1, ns) for name, ns, _, failed in figures}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The number of the first rule that each text fails, or -1; later rules see only the
    texts that are left."""
    verdict, left = np.full(len(texts), -1), np.arange(len(texts))
    for k, rule in enumerate(rules):
        if not len(left):
            break
        failed = rule.fails(texts)
        if failed.any():
            verdict[left[failed]] = k
            left, texts = left[~failed], texts.where(~failed)
    return verdict


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text fails no rule, all columns as they are."""
    order = ordered(rules, measured(docs, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(sized(batches, "text", BATCH)):
            yield batch.filter(pa.array(cascade(Texts(batch.column("text")), order) < 0))

    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts of every text, ``base_failed`` and ``kept``; the cascade runs on
    the texts that pass the base."""
    order = ordered(rules, measured(docs, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(sized(batches, "text", BATCH)):
            texts = Texts(batch.column("text"))
            counts = [pa.array(getattr(texts, c).astype(np.int64)) for c in COUNTS]
            kept = ~texts.base_failed
            kept[kept] = cascade(texts.where(kept), order) < 0
            yield pa.record_batch(
                [batch.column("doc_id"), *counts, pa.array(texts.base_failed), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"))
