"""Operator 4: quality rules by repetition coverage.

Texts are measured in numpy, a megabyte of them at once: words become 64-bit hashes, an n-gram's hash is rolled from its
words' and mixed with its text, and one sort for each length finds n-grams that a text holds at least twice. Characters
(code points of words) that lie inside these, or inside a line equal to an earlier one, are counted once each. There is
no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch, pick, slices, table
from .shingles import MULTIPLIER, Words, chunks, mixed, rolled, words_of

#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@dataclass(frozen=True)
class RepetitionRules:
    """n_words below min_words, or words in repeated windows of `window` words over max_repeat_pct of all: base_failed.

    The method's own verdict, in shares of word characters: those inside duplicated n-grams for each length of
    `max_coverage`, those inside duplicated lines, and symbols for each word.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    max_coverage: tuple[tuple[int, float], ...] = ((5, 0.40), (6, 0.38), (8, 0.34), (10, 0.30))
    max_line_coverage: float = 0.30
    max_symbol_ratio: float = 0.25


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def in_repeated_windows(words: Words, owner: np.ndarray, n: int) -> np.ndarray:
    """For each word of some texts, whether it lies in a window of n words that its text holds at least twice."""
    covered = np.zeros(len(owner) + 1, np.int64)
    windows = rolled(words.hashes, n)
    if len(windows):
        at = np.flatnonzero(owner[: len(windows)] == owner[n - 1 :])  # windows inside one text
        keys = mixed(windows[at] + owner[at].astype(np.uint64) * MULTIPLIER)
        order = np.argsort(keys)
        ranked = keys[order]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        twice = at[np.unique(np.concatenate((order[same], order[same + 1])))]
        covered[twice] += 1
        covered[twice + n] -= 1
    return np.cumsum(covered[:-1]) > 0


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and the code points of their words."""
    seen: set[bytes] = set()
    lines = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line and not line.isspace():
            seen.add(line)
    return lines, chars


def measure(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of repetition_coverage for some texts."""
    found: list[dict[str, np.ndarray]] = []
    for part in chunks(texts, lower=False):
        words = words_of(part)
        owner = np.repeat(np.arange(len(part)), words.counts)
        points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        chars = points[words.ends] - points[words.starts]
        per_text = lambda x: np.bincount(owner, weights=x, minlength=len(part)).astype(np.int64)
        symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[words.data])))
        lines = np.array([repeated_lines(t) if b"\n" in t else (0, 0) for t in part], np.int64).reshape(-1, 2)
        inside = {k: in_repeated_windows(words, owner, k) for k in {rules.window, *(k for k, _ in rules.max_coverage)}}
        total = per_text(chars)
        out = {"n_words": words.counts.astype(np.int64), "word_chars": total, "n_symbols": symbols[words.at[1:]] - symbols[words.at[:-1]], "n_dup_lines": lines[:, 0], "n_repeat_words": per_text(inside[rules.window])}
        out |= {f"coverage_{k}": per_text(chars * inside[k]) / np.maximum(1, total) for k, _ in rules.max_coverage}
        found.append(out | {"coverage_lines": lines[:, 1] / np.maximum(1, total)})
    both = {c: np.concatenate([x[c] for x in found]) for c in found[0]}
    both["base_failed"] = (both["n_words"] < rules.min_words) | (100 * both["n_repeat_words"] > rules.max_repeat_pct * both["n_words"])
    fine = (both["coverage_lines"] <= rules.max_line_coverage) & (both["n_symbols"] <= rules.max_symbol_ratio * both["n_words"])
    for k, most in rules.max_coverage:
        fine &= both[f"coverage_{k}"] <= most
    return both | {"kept": ~both["base_failed"] & fine}


def repetition_coverage(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, COLUMNS (long), coverage_<n> and coverage_lines (double), base_failed, kept.

    A null or empty text has no words and fails the base rule; a blank line is no duplicate; repeated rows are measured
    each; an empty table gives an empty one; other columns aren't read, so that their names can't clash. Texts are measured
    by the megabyte; a longer one costs a few arrays of its own length.
    """
    names = [f"coverage_{k}" for k, _ in rules.max_coverage] + ["coverage_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield batch(key=part.column(0), **{c: pa.array(v) for c, v in measure(part.column(1).to_pylist(), rules).items()})

    slim = pick(docs, id_col, text_col)
    kinds = [f"{c} long" for c in COLUMNS] + [f"{c} double" for c in names] + ["base_failed boolean", "kept boolean"]
    out = arrow_map(slim, run, f"key {slim.schema[0].dataType.simpleString()}, {', '.join(kinds)}")
    return out.withColumnRenamed("key", id_col)


def keep_by_coverage(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that repetition_coverage keeps, with all their columns, whatever their names: rows go to Python once."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield part.filter(pa.array(measure(part.column(at).to_pylist(), rules)["kept"]))

    return arrow_map(plain, run, plain.schema).toDF(*docs.columns)


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts, what fails at once, and the verdict of repetition coverage."""
    found = repetition_coverage(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COLUMNS, "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns; null or empty texts go, rows with null or repeated ids are
    judged each by their text, an empty table stays empty."""
    return keep_by_coverage(docs)
