"""Token counts: batches of texts are encoded in Arrow functions that return lengths only.

Batches are balanced by bytes (``kernels.slices``).  Texts are split at safe
boundaries: where a tokenizer drops white space (probed, not assumed), no token
crosses a space, tab or line break, so a text's ids are those of its
space-separated pieces one after the other.  Equal pieces of a batch are then
encoded once, and a bounded cache keeps the pieces met most recently.  Other
``.json`` tokenizers encode whole texts, long ones cut before single spaces
between letters where the probe shows that to be neutral; ``.model`` files
(sentencepiece) encode whole texts.

Null texts count as empty (0 tokens); an empty table gives an empty result;
repeated rows are counted one by one; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K

CACHE = 2_000_000
JOINED = 20_000
LONG_TEXT = 1 << 20
_SPACES = np.ones(256, dtype=bool)
_SPACES[[9, 10, 13, 32]] = False
_LOADED: dict[str, object] = {}
_PROBE = ("ab", "cd")


def load(path: str):
    """The tokenizer of a file, once per worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = tok
    return _LOADED[path]


def _ids(tok, text: str) -> list[int]:
    return tok.encode(text, add_special_tokens=False).ids


def drops_spaces(tok) -> bool:
    a, b = _PROBE
    return all(_ids(tok, a + gap + b) == _ids(tok, a) + _ids(tok, b) for gap in (" ", "\n", "\t", "\r", "  \r\n\t "))


class PieceIds:
    """Ids of space-separated pieces.  Pieces not met before are encoded many at a time, as one
    text with spaces between, and told apart by the tokens' offsets; the others come from a
    bounded table of sorted piece hashes."""

    def __init__(self, tok, size: int = CACHE):
        self.tok, self.size = tok, size
        self.tiers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, offsets, ids; smaller and smaller

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the distinct pieces: offsets and ids, one after the other; and which one each piece is."""
        keys, first, which = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size, parts = np.zeros(len(keys), np.int64), []
        todo = np.arange(len(keys))
        for hashes, at, ids in self.tiers:
            place = np.minimum(np.searchsorted(hashes, keys[todo]), len(hashes) - 1)
            hit = hashes[place] == keys[todo]
            size[todo[hit]] = np.diff(at)[place[hit]]
            parts.append((todo[hit], at[place[hit]], ids))
            todo = todo[~hit]
        if len(todo):
            at, ids = self._encode(data, starts[first[todo]], ends[first[todo]])
            size[todo] = np.diff(at)
            parts.append((todo, at[:-1], ids))
            self._keep(keys[todo], at, ids)
        out_at = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(out_at[-1]), "<u4")
        for rows, source, ids in parts:
            out[K.ragged(out_at[rows], size[rows])] = ids[K.ragged(source, size[rows])]
        return out_at, out, which

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for i in range(0, len(starts), JOINED):
            s, e = starts[i:i + JOINED], ends[i:i + JOINED]
            at = np.concatenate([[0], np.cumsum(e - s + 1)])
            joined = np.full(int(at[-1]), 32, np.uint8)
            joined[K.ragged(at[:-1], e - s)] = data[K.ragged(s, e - s)]
            begins = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])[at[:-1]]  # in code points
            got = self.tok.encode(joined.tobytes().decode("utf-8"), add_special_tokens=False)
            piece = np.searchsorted(begins, [x for x, _ in got.offsets], side="right") - 1
            ids.append(np.array(got.ids, "<u4"))
            counts.append(np.bincount(piece, minlength=len(s)) if len(piece) else np.zeros(len(s), np.int64))
        return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(ids)

    def _keep(self, hashes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        tiers = [*self.tiers, (hashes, at, ids)]
        while len(tiers) > 1 and 2 * len(tiers[-1][0]) > len(tiers[-2][0]):
            (h1, a1, i1), (h2, a2, i2) = tiers[-2:]
            h, source = np.concatenate([h1, h2]), np.concatenate([a1[:-1], a2[:-1] + len(i1)])
            size, pool = np.concatenate([np.diff(a1), np.diff(a2)]), np.concatenate([i1, i2])
            order = np.argsort(h)
            tiers[-2:] = [(h[order], np.concatenate([[0], np.cumsum(size[order])]),
                           pool[K.ragged(source[order], size[order])])]
        self.tiers = tiers if sum(len(t[0]) for t in tiers) <= self.size else []


def _long_parts(tok, text: str) -> list[str]:
    if len(text) <= LONG_TEXT or _ids(tok, "ab cd") != _ids(tok, "ab") + _ids(tok, " cd"):
        return [text]
    out, i = [], 0
    cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
    while len(text) - i > LONG_TEXT:
        m = cut.search(text, i + LONG_TEXT)
        if not m:
            break
        out.append(text[i:m.start()])
        i = m.start()
    return [*out, text[i:]]


def _counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    tok = load(path)
    if path.endswith(".model"):
        return lambda texts: np.array([len(x) for x in tok.encode(texts.fill_null("").to_pylist(), num_threads=1)],
                                      np.int64)
    if not drops_spaces(tok):
        def whole(texts: pa.Array) -> np.ndarray:
            parts = [_long_parts(tok, t or "") for t in texts.to_pylist()]
            got = iter(tok.encode_batch([p for ps in parts for p in ps], add_special_tokens=False))
            return np.array([sum(len(next(got).ids) for _ in ps) for ps in parts], np.int64)
        return whole
    pieces = PieceIds(tok)

    def by_piece(texts: pa.Array) -> np.ndarray:
        data, at = K.flat(texts)
        starts, ends, rows = K.words(data, at, _SPACES)
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        of_piece, _, which = pieces.of(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(np.diff(of_piece)[which])])
        return sums[rows[1:]] - sums[rows[:-1]]

    return by_piece


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text by the tokenizer file ``tokenizer``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(tokenizer)
        for batch in K.slices(batches, max_bytes=2 * K.SLICE_BYTES):
            size = np.diff(K.flat(batch.column(1))[1])
            n = of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias(key), _text(text).alias("_text"))
    return own.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _text(text: str) -> Column:
    return F.col(text).cast("string")
