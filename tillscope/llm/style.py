"""Surface marks of words and lines that quality operators share."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillscope.llm.texts import Words, mix

SYMBOLS = r"[#*$%&|<>]"


class Marks(NamedTuple):
    """Per vocabulary word: code points, symbols, all upper case, letters. Per position: repeats."""

    points: np.ndarray
    symbols: np.ndarray
    upper: np.ndarray
    letters: np.ndarray
    repeated: np.ndarray
    same_as_last: np.ndarray


def row_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))


def in_repeated_windows(words: Words, width: int = 3) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that its text holds twice or more.

    Windows are compared by 64-bit hashes of word numbers.
    """
    codes, rows = words.codes, row_of(words)
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    key = mix(rows[: n - width + 1].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - width + 1 + k].astype(np.uint64))
    whole = rows[width - 1 :] == rows[: n - width + 1]
    places = np.flatnonzero(whole)
    key = key[places]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hits = places[twice[at] == key]
        for k in range(width):
            covered[hits + k] = True
    return covered


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    full = pc.match_substring_regex(lines, r"[^ \t\n\x0B\f\r]").to_numpy(zero_copy_only=False)
    encoded = lines.dictionary_encode()
    code = encoded.indices.to_numpy().astype(np.int64)
    size = max(1, len(encoded.dictionary))
    key = (rows * size + code)[full]
    total = np.bincount(rows[full], minlength=len(texts))
    different = np.bincount(np.unique(key) // size, minlength=len(texts))
    return total - different


def marks(words: Words) -> Marks:
    text = pa.array(words.vocabulary, pa.string())
    points = pc.utf8_length(text).to_numpy().astype(np.int64)
    symbols = pc.count_substring_regex(text, SYMBOLS).to_numpy().astype(np.int64)
    upper = pc.utf8_is_upper(text).to_numpy(zero_copy_only=False) & (points > 1)
    letters = pc.count_substring_regex(text, r"\pL").to_numpy().astype(np.int64)
    rows = row_of(words)
    same = np.zeros(len(words.codes), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (rows[1:] == rows[:-1])
    return Marks(points, symbols, upper, letters, in_repeated_windows(words), same)
