"""Substring dedup by bundles of windows, in place of a depth-limited radix sort of suffixes.

The windows are the first ``threshold`` bytes of all suffixes of all texts (as UTF-8
bytes).  They are grouped, not put in order, in passes by ever longer grams: a window's
key is a gram inside it, chosen by content (the leftmost smallest gram hash), and one
alone under its key is unique and leaves.  Neighbouring windows with the same gram pass
as one bundle, so a pass moves one row for many, where a sort by the suffix's own first
bytes would move one for each.
After the last pass, at the threshold, groups are exactly the repeated windows.

Every byte covered by a window that starts anywhere else too goes, all copies
included; windows are judged on the input.  Null counts as empty.  Repeated rows
are copies of each other.  Texts shorter than the threshold keep all bytes.  Empty
tables give empty results; other columns are ignored, whatever their names.
Windows are told apart by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm import repeats as R

THRESHOLD = 200


def _pass(threshold: int, depth: int) -> R.Kernel:
    """The digits of one pass: bundles of suffix starts by their gram of ``depth`` bytes."""

    def kernel(texts: pa.Array, full: bool):
        data, at = K.flat(texts)
        n = len(data) - threshold + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none, none
        row = K.row_of(at)
        p = np.flatnonzero(row[:n] == row[threshold - 1:])
        if not len(p):
            return none, none, none, none, none
        if depth == threshold:
            key = K.span_hashes(data, p, p + threshold)
            hull = K.span_hashes(data, p, p + threshold, seed=1) if full else key
            return key, hull, row[p], p - at[row[p]], np.ones(len(p), np.int64)
        grams = K.gram_hashes(data, depth)
        place = K.sliding_first_min(grams, threshold - depth + 1)[p]
        new = np.ones(len(p), bool)
        new[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(new)
        lo, size = p[head], np.diff(np.append(head, len(p)))
        key = grams[place[head]]
        hull = K.span_hashes(data, lo, lo + size - 1 + threshold, seed=1) if full else key
        return key, hull, row[lo], lo - at[row[lo]], size

    return kernel


def _depths(threshold: int) -> list[int]:
    return sorted({max(1, threshold * 8 // 25), max(1, threshold * 4 // 5), threshold})


def _cutter(threshold: int) -> Callable:
    def cut(texts: pa.Array, row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[bytes]:
        data, at = K.flat(texts)
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip((at[row] + lo).tolist(), (at[row] + end - 1 + threshold).tolist())]

    return cut


def _kept(docs: DataFrame, key: str, text: str, threshold: int, name: str) -> tuple[DataFrame, DataFrame]:
    texts = R.identified(docs, key, text)
    spans = R.found_spans(texts, [_pass(threshold, d) for d in _depths(threshold)], _cutter(threshold), "binary",
                          False, name)
    return texts, spans


def _remove(batch: pa.RecordBatch, body: int, spans: int, threshold: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Per row: its bytes, those that stay, how many go, in how many runs."""
    data, at = K.flat(batch.column(body))
    rows, lo, n = R.span_arrays(batch.column(spans))
    start = at[K.row_of(rows)] + lo
    gone = K.covered(start, start + n - 1 + threshold, len(data))
    for i in range(batch.num_rows):
        own = gone[at[i]:at[i + 1]]
        runs = int((own & ~np.concatenate([[False], own[:-1]])).sum()) if len(own) else 0
        yield len(own), data[at[i]:at[i + 1]][~own].tobytes(), int(own.sum()), runs


def removed_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every text."""
    texts, spans = _kept(docs, key, text, threshold, "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            got = list(_remove(batch, 1, 2, threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array([g[3] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.binary())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(spans, ["k", "s"], "left").select(R.key_back(F.col("k")).alias("k"), "body", "spans")
    return joined.mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
