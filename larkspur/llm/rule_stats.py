"""Statistics of whole texts that quality rules and classifiers use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from larkspur.llm import _kernels as k

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "variety", "same_next", "line_words", "exclaims")


def _equal_before(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Marks the elements whose key occurs at least twice in their row."""
    with np.errstate(over="ignore"):
        keys = k.mix(keys ^ (rows.astype(k.U64) * k.U64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    marks = np.zeros(len(keys), bool)
    marks[order[1:]] |= same
    marks[order[:-1]] |= same
    return marks


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys in each row."""
    with np.errstate(over="ignore"):
        keys = k.mix(keys ^ (rows.astype(k.U64) * k.U64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return np.bincount(rows[order][new], minlength=n)


def _piece(texts: pa.StringArray) -> dict[str, np.ndarray]:
    raw, offsets = k.buffers(texts)
    n = len(offsets) - 1
    starts, ends, counts = k.words(raw, offsets)
    hasher = k.Hasher(raw)
    hashes, rows = hasher(starts, ends), k.owners(counts)
    inside = ~k.SPACE[raw]
    points = (raw & 0xC0) != 0x80
    out = {"n_words": np.diff(counts), "word_chars": k.totals(inside & points, offsets), "n_symbols": k.totals(SYMBOLS[raw], offsets)}

    line_starts, line_ends, line_counts = k.runs(raw != 10, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_rows = k.owners(line_counts)[worded]
    lines = hasher(line_starts[worded], line_ends[worded])
    n_lines = np.bincount(line_rows, minlength=n)
    out["n_dup_lines"] = n_lines - _distinct(line_rows, lines, n)

    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = rows[2:] == rows[:-2]
        at = np.flatnonzero(whole)
        with np.errstate(over="ignore"):
            windows = k.mix(hashes[at] * k.U64(3) + hashes[at + 1] * k.U64(0xD6E8FEB86659FD93) + k.mix(hashes[at + 2]))
        twice = at[_equal_before(rows[at], windows)]
        for step in range(3):
            covered[twice + step] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)

    upper = (raw >= 65) & (raw <= 90)
    digits = (raw >= 48) & (raw <= 57)
    letters = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    some_words, some_chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    out["features"] = np.stack(
        [
            np.log1p(out["n_words"]),
            out["word_chars"] / some_words,
            out["n_symbols"] / some_words,
            out["n_dup_lines"] / np.maximum(n_lines, 1),
            out["n_repeat_words"] / some_words,
            k.totals(upper, offsets) / some_chars,
            k.totals(digits, offsets) / some_chars,
            k.totals(inside & points & ~letters & ~digits, offsets) / some_chars,
            _distinct(rows, hashes, n) / np.sqrt(some_words),
            np.bincount(rows[follows], minlength=n) / some_words,
            np.log1p(out["n_words"] / np.maximum(n_lines, 1)),
            k.totals(raw == 33, offsets) / some_words,
        ],
        axis=1,
    ).astype(np.float32)
    return out


def rule_stats(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """BASE counts as long arrays, and ``features``, a row of FEATURES for each text.

    An empty text has 0 everywhere. Lines are split at ``\\n``; one without a word is no line.
    """
    parts = [_piece(texts.slice(a, b - a)) for a, b in k.pieces(texts)]
    if not parts:
        return {x: np.zeros(0, np.int64) for x in BASE} | {"features": np.zeros((0, len(FEATURES)), np.float32)}
    return {x: np.concatenate([p[x] for p in parts]) for x in parts[0]}
