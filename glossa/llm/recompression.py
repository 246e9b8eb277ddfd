"""Substring dedup by recompression.

A text is a sequence of words ``[^\\x20\\x09-\\x0D]+``.  Rounds rename it, runs of equal
symbols first, then pairs: a coin (a bit of the symbol's hash) marks each symbol
left or right, and a left symbol followed by a right one becomes one symbol.  Names
are 64-bit hashes of what they stand for, so all tasks give equal runs and pairs the
same name in every round without exchanging them.

Inside a window, symbols that could reach across its edge are unsafe; the others
depend on the window's words alone, so equal windows hold the same safe symbols at
the same places.  Each window is represented by the smallest-named safe symbol of
the highest round that has one (in round 0 every word is safe).  Spark groups the
windows by this shared symbol and compares the text around it by its hash.  Where a
symbol has several surroundings, it is extended to a stretch of four fifths of the
window, and what is still open is compared window by window.

A word goes when a window of ``window`` words covers it whose words also start in a
document with a smaller key; windows are judged on the input.  Null has no words.
Rows with equal keys do not count as earlier than each other.  Texts with fewer
words than a window keep all.  Empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossa.llm import kernels as K
from glossa.llm import repeats as R

WINDOW, ROUNDS = 50, 4
_U = K.U


def _salt(turn: int, by: int) -> np.uint64:
    return _U(turn * by & 0xFFFFFFFFFFFFFFFF)


def _renamed_runs(sym: np.ndarray, start: np.ndarray, row: np.ndarray):
    """Each run of equal symbols of a row as one symbol; the new index of every old one."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(sym)))
    named = np.where(size > 1, K.mix(sym[head] + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), sym[head])
    return named, start[head], row[head], np.cumsum(new) - 1


def _coins(sym: np.ndarray, turn: int) -> np.ndarray:
    """Whether a symbol is a right one in this round."""
    return (K.mix(sym + _salt(turn + 1, 0x165667B19E3779F9)) >> _U(63)).astype(bool)


def _renamed_pairs(sym: np.ndarray, start: np.ndarray, row: np.ndarray, right: np.ndarray, turn: int):
    """Each left symbol followed by a right one of its row, and that one, as one symbol."""
    second = np.zeros(len(sym), bool)
    second[1:] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    head = np.flatnonzero(~second)
    paired = np.zeros(len(sym) + 1, bool)
    paired[:-1] = second
    first = paired[head + 1]
    after = np.minimum(head + 1, len(sym) - 1)
    named = np.where(first, K.mix(sym[head] * _U(0x27D4EB2F165667C5) + K.mix(sym[after] + _U(turn + 1))), sym[head])
    return named, start[head], row[head], np.cumsum(~second) - 1


def _smallest(sym: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest symbol of every range ``a:b`` (none is empty)."""
    bits = _U(max(22, int(len(sym)).bit_length()))
    low = (_U(1) << bits) - _U(1)
    table = (K.mix(sym) & ~low) | np.arange(len(sym), dtype=_U)
    width = b - a
    power = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(a), _U)
    span = 1
    for j in range(int(power.max()) + 1 if len(power) else 0):
        if j:
            table = np.minimum(table[:-(span // 2)], table[span // 2:]) if span // 2 < len(table) else table
        at = np.flatnonzero(power == j)
        out[at] = np.minimum(table[a[at]], table[b[at] - span])
        span *= 2
    return (out & low).astype(np.int64)


def anchors(words: np.ndarray, row: np.ndarray, p: np.ndarray, window: int, rounds: int):
    """For every window start ``p``: the name of its representing symbol and where that begins."""
    sym, start = words, np.arange(len(words))
    a, b = p.copy(), p + window
    name, at = np.empty(len(p), _U), np.empty(len(p), np.int64)
    safe = np.arange(len(p))  # windows that still have safe symbols
    for turn in range(rounds + 1):
        if turn:
            right = None
            for step in ("runs", "pairs"):
                if step == "runs":
                    sym, start, row, to = _renamed_runs(sym, start, row)
                    na, nb = to[a] + 1, to[b - 1]
                else:
                    right = _coins(sym, turn)
                    na, nb = right[a], right[b - 1]
                    sym, start, row, to = _renamed_pairs(sym, start, row, right, turn)
                    na, nb = to[a] + na, to[b - 1] + nb
                live = na < nb
                # the windows that fall out here keep the symbol of the round before
                a, b, safe = na[live], nb[live], safe[live]
                if not len(safe):
                    return name, at
        best = _smallest(sym, a, b)
        name[safe] = K.mix(sym[best] + _salt(turn, 0x85EBCA77C2B2AE63))
        at[safe] = start[best]
    return name, at


def _kernel(window: int, rounds: int | None) -> R.Kernel:
    """Bundles of window starts by representing symbol; ``rounds`` None: single windows."""

    def kernel(texts: pa.Array, full: bool):
        data, at = K.flat(texts)
        s, e, rows = K.words(data, at, K.NONSPACE)
        row = K.row_of(rows)
        none = np.zeros(0, np.int64)
        if len(s) < window:
            return none, none, none, none, none
        p = np.flatnonzero(row[:len(s) - window + 1] == row[window - 1:])
        if not len(p):
            return none, none, none, none, none
        words = K.span_hashes(data, s, e)
        if rounds is None:
            key = K.span_hashes(words, p, p + window)
            hull = K.span_hashes(words, p, p + window, seed=1) if full else key
            return key, hull, row[p], p - rows[row[p]], np.ones(len(p), np.int64)
        name, begin = anchors(words, row, p, window, rounds)
        new = np.ones(len(p), bool)
        new[1:] = (begin[1:] != begin[:-1]) | (name[1:] != name[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(new)
        lo, size = p[head], np.diff(np.append(head, len(p)))
        hull = K.span_hashes(words, lo, lo + size - 1 + window, seed=1) if full else name[head]
        return name[head], hull, row[lo], lo - rows[row[lo]], size

    return kernel


def _stretches(window: int, reach: int) -> R.Kernel:
    """Bundles by a long stretch: of the windows' stretches of ``reach`` words the smallest-named.
    A window whose stretch holds a word of its own is alone under it and leaves."""

    def kernel(texts: pa.Array, full: bool):
        data, at = K.flat(texts)
        s, e, rows = K.words(data, at, K.NONSPACE)
        row = K.row_of(rows)
        none = np.zeros(0, np.int64)
        p = np.flatnonzero(row[:max(0, len(s) - window + 1)] == row[window - 1:]) if len(s) >= window else none
        if not len(p):
            return none, none, none, none, none
        words = K.span_hashes(data, s, e)
        grams = K.gram_hashes(words, reach)
        begin = K.sliding_first_min(grams, window - reach + 1)[p]
        new = np.ones(len(p), bool)
        new[1:] = (begin[1:] != begin[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(new)
        lo, size = p[head], np.diff(np.append(head, len(p)))
        key = grams[begin[head]]
        hull = K.span_hashes(words, lo, lo + size - 1 + window, seed=1) if full else key
        return key, hull, row[lo], lo - rows[row[lo]], size

    return kernel


def _passes(window: int, rounds: int) -> list[R.Kernel]:
    return [_kernel(window, rounds), _stretches(window, max(1, window * 4 // 5)), _kernel(window, None)]


def _cutter(window: int):
    def cut(texts: pa.Array, row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[str]:
        data, at = K.flat(texts)
        s, e, rows = K.words(data, at, K.NONSPACE)
        raw = data.tobytes()
        first, last = s[rows[row] + lo].tolist(), e[rows[row] + end - 2 + window].tolist()
        return [raw[a:b].decode("utf-8") for a, b in zip(first, last)]

    return cut


def _without(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Per batch (body in column 2, spans in column 3): words, removed words and kept text of each row."""
    for batch in K.slices(batches, text=2):
        data, at = K.flat(batch.column(2))
        s, e, rows = K.words(data, at, K.NONSPACE)
        of, lo, n = R.span_arrays(batch.column(3))
        start = rows[K.row_of(of)] + lo
        keep = ~K.covered(start, start + n - 1 + window, len(s))
        size = (e - s)[keep] + 1
        out_at = np.concatenate([[0], np.cumsum(size)])
        joined = np.full(int(out_at[-1]), 32, np.uint8)
        joined[K.ragged(out_at[:-1], size - 1)] = data[K.ragged(s[keep], size - 1)]
        raw = joined.tobytes()
        kept_rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        edge = out_at[kept_rows].tolist()
        kept = [raw[x:max(x, y - 1)].decode("utf-8") for x, y in zip(edge[:-1], edge[1:])]
        n_words = np.diff(rows)
        yield batch, [pa.array(n_words), pa.array(n_words - np.diff(kept_rows)), pa.array(kept, pa.string())]


def _spanned(docs: DataFrame, key: str, text: str, window: int, rounds: int) -> tuple[DataFrame, list[str]]:
    """Texts beside their spans; the document's other columns travel in ``rest``."""
    others = [c for c in docs.columns if c not in (key, text)]
    packed = docs.select(F.col(key).alias(key), F.col(text).alias(text),
                         F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("rest"))
    texts = R.identified(packed, key, text, "rest")
    spans = R.found_spans(texts, _passes(window, rounds), _cutter(window), "string", True, "recompression", store=True)
    joined = texts.join(spans, ["k", "s"], "left").select(R.key_back(F.col("k")).alias("k"), "rest", "body", "spans")
    return joined, others


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                 rounds: int = ROUNDS) -> DataFrame:
    """(key, n_words, n_removed, kept): every text without its later copies of long passages,
    the words that stay joined by one space."""
    joined, _ = _spanned(docs.select(key, text), key, text, window, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cols in _without(batches, window):
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the same columns and rows, texts cleared of later copies of long passages.
    Texts that lose nothing stay as they are."""
    joined, others = _spanned(docs, key, text, window, rounds)
    rest = joined.schema["rest"]
    schema = StructType([StructField("k", LongType()), rest, StructField("body", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (_, removed, kept) in _without(batches, window):
            body = pc.if_else(pc.equal(removed, 0), batch.column(2), kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], names=["k", "rest", "body"])

    kind = dict(docs.dtypes)
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col("k").cast(kind[key]).alias(key) if c == key else F.col("body").alias(text) if c == text
                        else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
