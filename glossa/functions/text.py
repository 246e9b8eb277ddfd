"""Tokenisation and n-gram Column builders (F1, F2, A3, A6); n-grams are counted in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.clean import NON_SPACE_PATTERN, WORD_CLASS

# Token patterns.
# Vectorizer default token pattern ("\b\w\w+\b") = maximal word runs of >= 2 chars.
TERM_PATTERN = rf"[{WORD_CLASS}]{{2,}}"
# EDA vocabulary pattern, applied to lower-cased text.
EDA_WORD_PATTERN = r"[A-Za-z']+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_tokens(col: Column | str, max_length: int | None = None) -> Column:
    """F1 (+F7 truncation): array of word tokens of >= 2 word characters."""
    toks = F.regexp_extract_all(_c(col), F.lit(TERM_PATTERN), 0)
    if max_length is not None:
        toks = F.slice(toks, 1, max_length)
    return toks


# A distinct n-gram of a text travels as one long: the place of its first occurrence (0-based), n and
# its count, 27, 8 and 27 bits.  A row holds less than 2 GB, so an array has less than 2 ** 27 strings.
PLACE_SHIFT, N_SHIFT = 35, 27
SLICE_TOKENS = 1 << 18  # tokens that a task counts at a time, about: its memory does not grow with the batch


def _distinct_in_rows(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the distinct codes (below ``size``) of every row; ``row`` ascends."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (int(row[-1]) + 1) * size < 1 << 62:
        key = row * size + code
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort((code, row))
        new = (np.diff(row[order], prepend=-1) != 0) | (np.diff(code[order], prepend=-1) != 0)
    starts = np.flatnonzero(new)
    return order[starts], np.diff(starts, append=len(row))


def count_slice(tokens: pa.Array, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed counts of the distinct n-grams of every row of ``tokens`` (lists of strings), and how many each row has."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = tokens.flatten().dictionary_encode()
    word, v = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    left = np.repeat(offsets[1:], sizes) - np.arange(len(row))  # tokens from here to the end of the text
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, code, size = np.arange(len(row)), word, v
    for n in range(1, n_max + 1):
        if n > 1:
            fits = left[at] >= n
            at, code = at[fits], code[fits]
            if size * v >= 1 << 62:
                known, code = np.unique(code, return_inverse=True)
                size = max(1, len(known))
            code, size = code * v + word[at + n - 1], size * v
        if n >= n_min:
            first, tf = _distinct_in_rows(row[at], code, size)
            place = at[first] - offsets[row[at[first]]]
            rows.append(row[at[first]])
            codes.append((place << PLACE_SHIFT) | (n << N_SHIFT) | tf)
    all_rows = np.concatenate(rows)
    return np.concatenate(codes)[np.argsort(all_rows, kind="stable")], np.bincount(all_rows, minlength=len(sizes))


def gram_counts(tokens: Column | str, n_min: int = 1, n_max: int = 2) -> Column:
    """``struct<tokens, grams>`` of a token array: its tokens, and its distinct n-grams, n in [n_min, n_max],
    as packed longs, counted inside the row in Arrow batches; ``gram_term`` gives their terms.  NULL tokens are none.

    The tokens come back with their counts because a plan would compute a column that goes into a Python
    step and is used behind it twice."""

    @F.arrow_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("grams", T.ArrayType(T.LongType()))]))
    def count(tokens: pa.Array) -> pa.Array:
        ends = tokens.offsets.to_numpy()
        codes, sizes, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while start < len(tokens):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_TOKENS, "right")) - 1)
            found, size = count_slice(tokens.slice(start, stop - start), n_min, n_max)
            codes.append(found)
            sizes.append(size)
            start = stop
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.StructArray.from_arrays([tokens, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes)))],
                                          names=["tokens", "grams"])

    return count(F.coalesce(_c(tokens), F.array().cast("array<string>")))


def gram_term(tokens: Column | str, gram: Column | str, n_min: int = 1, n_max: int = 2) -> Column:
    """The term of a packed n-gram of ``tokens``: its tokens joined by one space."""
    t, g = _c(tokens), _c(gram)
    place = F.shiftrightunsigned(g, PLACE_SHIFT).cast("int")
    n = F.shiftrightunsigned(g, N_SHIFT).bitwiseAND(F.lit(0xFF))
    out = F
    for k in range(n_min, n_max + 1):
        out = out.when(n == k, F.concat_ws(" ", *[F.get(t, place + i) for i in range(k)]) if k > 1 else F.get(t, place))
    return out


def gram_frequency(gram: Column | str) -> Column:
    """The count of a packed n-gram in its text."""
    return _c(gram).bitwiseAND(F.lit((1 << N_SHIFT) - 1))


def whitespace_token_count(col: Column | str) -> Column:
    """A3: number of whitespace-separated tokens (Python ``len(s.split())``)."""
    return F.regexp_count(_c(col), F.lit(NON_SPACE_PATTERN + "+")).cast("bigint")


def char_count(col: Column | str) -> Column:
    """A3: length in code points."""
    return F.length(_c(col)).cast("bigint")


def eda_words(col: Column | str) -> Column:
    """Lower-cased ``[A-Za-z']+`` tokens."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(EDA_WORD_PATTERN), 0)
