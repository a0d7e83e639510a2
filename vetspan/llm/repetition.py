"""Quality rules on repetition: characters inside repeated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import small_batches, split_words, text_slices

#: Multiplier of the rolling hash, an odd 64-bit number.
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares of a text's word characters inside repeated n-grams, by n, and of its characters inside repeated lines."""

    ngram_share: tuple[tuple[int, float], ...] = ((5, 0.40), (8, 0.28), (10, 0.20))
    line_share: float = 0.30
    base_window: int = 8
    min_words: int = 20
    base_percent: int = 30


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n the hashes of codes[i : i + n] for every i with n codes left; wider ones are put together from narrower ones."""
    powers = {1: _mix(codes.astype(np.uint64) + np.uint64(1))}

    def of(n: int) -> np.ndarray:
        if n not in powers:
            half = n // 2
            a, b = of(n - half), of(half)
            size = max(len(codes) - n + 1, 0)
            with np.errstate(over="ignore"):
                factor = np.uint64(pow(int(BASE), n - half, 1 << 64))
                powers[n] = a[:size] + factor * b[n - half : n - half + size]
        return powers[n]

    return {n: of(n) for n in lengths}


def repeated_cover(codes: np.ndarray, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word whether it lies in an n-gram that its own text holds twice or more.

    Windows are sorted by hash with their position in the low bits; neighbours that agree are compared
    word by word, and if hashes ever agree without the words, the windows are sorted by their words.
    """
    size = len(codes)
    cover = np.zeros(size, bool)
    inside = np.flatnonzero(rows[: size - n + 1] == rows[n - 1 :]) if size >= n else np.zeros(0, np.int64)
    if not len(inside):
        return cover
    bits = np.uint64(int(size).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mix(hashes[inside] + rows[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    keys = np.sort((keys & ~low) | inside.astype(np.uint64))
    same = (keys[1:] >> bits) == (keys[:-1] >> bits)
    pair = np.flatnonzero(same)
    if not len(pair):
        return cover
    at = (keys & low).astype(np.int64)
    left, right = at[pair], at[pair + 1]
    equal = rows[left] == rows[right]
    for k in range(n):
        equal &= codes[left + k] == codes[right + k]
    if equal.all():
        found = np.concatenate((left, right))
    else:
        windows = np.column_stack([rows[inside], *[codes[inside + k] for k in range(n)]])
        _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        found = inside[counts[which.ravel()] > 1]
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, np.unique(found), 1)
    np.add.at(edges, np.unique(found) + n, -1)
    return np.cumsum(edges[:-1]) > 0


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n).astype(np.int64)


def measure(texts: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    n = len(texts)
    codes, bounds, names = split_words(texts)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    chars = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    out = {"n_words": np.diff(bounds).astype(np.int64), "word_chars": _sum_by(rows, chars, n)}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    worded = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_codes = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    line_chars = pc.utf8_length(lines.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    full = worded[line_codes] if len(line_codes) else np.zeros(0, bool)
    line_codes, line_rows = line_codes[full], line_rows[full]
    first = np.unique(line_rows * max(len(worded), 1) + line_codes)
    first_rows, first_codes = np.divmod(first, max(len(worded), 1))
    count = lambda r: np.bincount(r, minlength=n).astype(np.int64)
    out["n_dup_lines"] = count(line_rows) - count(first_rows)
    dup_line_chars = _sum_by(line_rows, line_chars[line_codes], n) - _sum_by(first_rows, line_chars[first_codes], n)
    widths = [k for k, _ in rules.ngram_share]
    hashes = rolling(codes, sorted({*widths, rules.base_window}))
    covers = {k: repeated_cover(codes, rows, hashes[k], k) for k in hashes}
    out["n_repeat_words"] = _sum_by(rows, covers[rules.base_window], n)
    whole = np.maximum(out["word_chars"], 1)
    worst = np.zeros(n, bool)
    for k, most in rules.ngram_share:
        out[f"dup_{k}gram_chars"] = _sum_by(rows, chars * covers[k], n)
        worst |= out[f"dup_{k}gram_chars"] > most * whole
    out["dup_line_chars"] = dup_line_chars
    line_total = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    worst |= dup_line_chars > rules.line_share * line_total
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~worst
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:  # noqa: B008
    """One row per input row: id_col, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the characters
    dup_<n>gram_chars and dup_line_chars, and the verdicts base_failed and kept.

    Words are runs of other characters than \\x20 and \\x09-\\x0D. Null text counts as empty (no words, so
    base_failed). Repeated rows and null ids give a row each; other columns are not read. Nothing is shuffled.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"dup_{k}gram_chars" for k, _ in rules.ngram_share], "dup_line_chars"]
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text_col):
            found = measure(texts, rules)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(found[c]) for c in schema.names[1:]]], schema.names)

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
