"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.  An
unknown word falls back to its character 5-grams (with word-edge marks), and to
4-, 3-, 2- and 1-grams where it has no known longer one; the known n-grams of the
first order that has any are averaged.  A text gets the language with the
largest sum over its words (ties: the first in alphabetical order).

Words are runs of letters of the lower-cased text (``str.isalpha``).  The model
is fitted on about ``per_language`` distinct training texts per language (a documented
bound, chosen by a hash of the text; copies count once).  Words and the n-grams of the
counted words are counted in Spark; only those seen at least ``min_count`` times in the
sample come to the driver.  Rarer words are left to the n-grams.

A null text, or one without a letter, gets ``und`` and score 0, as does every text
when nothing could be learned.  Rows with a null language train nothing; a language
whose texts hold no letter is not learned.
Repeated rows are predicted alike.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.repeats import settled

PER_LANGUAGE = 3_000
MIN_COUNT = 2
ORDERS = (5, 4, 3, 2, 1)
EDGE = 0  # code point that marks a word's edges
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, the words' starts and ends, the rows' offsets among the words."""
    low = [(t or "").lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return (data, *K.words(data, at, _letters()))


def _edged(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each between edge marks, and their offsets."""
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), EDGE, np.uint32)
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = data[np.repeat(s - (at[:-1] - 2 * np.arange(len(s))), e - s) + np.arange(int((e - s).sum()))]
    return out, at


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside the edged words, and the word of each."""
    h = K.gram_hashes(data, order)
    word = K.row_of(at)[:len(h)]
    inside = np.arange(len(h)) + order <= at[1:][word]
    if order == 1:
        inside &= data[:len(h)] != EDGE
    return h[inside], word[inside]


@dataclass
class Model:
    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]  # sorted hashes; log frequencies by language
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = table
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros((len(h), logs.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, logs[at]

    def scores(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A row of scores by language for every word."""
        known, out = self._look(self.words, K.span_hashes(data, s, e))
        out = np.where(known[:, None], out, 0.0)
        todo = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(todo):
                break
            chars, at = _edged(data, s[todo], e[todo])
            h, word = _grams(chars, at, order)
            known, logs = self._look(self.grams[order], h)
            n = np.bincount(word[known], minlength=len(todo))
            got = n > 0
            for j in range(out.shape[1]):
                total = np.bincount(word[known], weights=logs[known, j], minlength=len(todo))
                out[todo[got], j] = total[got] / n[got]
            todo = todo[~got]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        data, s, e, rows = letter_words(texts)
        n = np.diff(rows)
        if not self.languages or not len(s):
            return ["und"] * len(texts), np.zeros(len(texts))
        _, first, which = np.unique(K.span_hashes(data, s, e), return_index=True, return_inverse=True)
        of_word = self.scores(data, s[first], e[first])
        row = K.row_of(rows)
        total = np.stack([np.bincount(row, weights=of_word[which, j], minlength=len(texts))
                          for j in range(len(self.languages))], axis=1)
        best = total.argmax(axis=1)
        soft = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(1, n / 20)[:, None])
        score = np.where(n > 0, soft.max(axis=1) / soft.sum(axis=1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())], score


def _table(names: np.ndarray, which: np.ndarray, lang: np.ndarray, count: np.ndarray, totals: np.ndarray,
           distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log frequencies by language of ``names``, from (which name, lang, count) and the sums over
    all ``distinct`` names."""
    counts = np.zeros((len(names), len(totals)))
    counts[which, lang] = count
    return names, np.log((counts + 0.5) / (totals + 0.5 * max(1, distinct))).astype(np.float32)


def _sample(train: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` distinct texts of each language, chosen by a hash of the text."""
    marked = train.withColumn("_h", F.xxhash64("_text"))
    sizes = {r["_lang"]: r["count"] for r in marked.select("_lang", "_h").distinct().groupBy("_lang").count().collect()}
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("_lang") == lang, F.lit(int(min(1.0, per_language / n) * (1 << 20)))).otherwise(share)
    chosen = marked.where(F.pmod("_h", F.lit(1 << 20)) < share)
    return chosen.groupBy("_lang", "_h").agg(F.any_value("_text").alias("_text")).select("_text", "_lang"), sorted(sizes)


def _counted_words(texts: DataFrame, langs: list[str]) -> DataFrame:
    """(word, lang, n): ``lang`` is the place in ``langs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=0, max_bytes=4 * K.SLICE_BYTES):
            data, s, e, rows = letter_words(batch.column(0).to_pylist())
            if not len(s):
                continue
            code = np.searchsorted(langs, batch.column(1).to_pylist())
            key = K.span_hashes(data, s, e) ^ K.mix(code[K.row_of(rows)].astype(K.U))
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            text = ["".join(map(chr, data[a:b])) for a, b in zip(s[first].tolist(), e[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(text, pa.string()), pa.array(code[K.row_of(rows)[first]].astype(np.int32)), pa.array(n)],
                names=["word", "lang", "n"])

    found = texts.mapInArrow(count, "word string, lang int, n long")
    return found.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _counted_names(words: DataFrame) -> DataFrame:
    """(size, h, lang, n): hashed words (size 0) and n-grams of every size, with their counts."""
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=0, max_bytes=K.SLICE_BYTES >> 2):
            found = batch.column(0).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(w) for w in found], dtype=np.int64)]).astype(np.int64)
            data = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
            lang, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            chars, edged = _edged(data, at[:-1], at[1:])
            for size in (0, *ORDERS):
                h, word = _grams(chars, edged, size) if size else (K.span_hashes(data, at[:-1], at[1:]), np.arange(len(found)))
                key = h ^ K.mix(lang[word].astype(K.U))
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                sums = np.bincount(which, weights=n[word], minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sums), size, np.int32)), K.as_long(h[first]), pa.array(lang[word[first]]), pa.array(sums)],
                    names=["size", "h", "lang", "n"])

    return words.mapInArrow(names, "size int, h long, lang int, n long").groupBy("size", "h", "lang").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
        min_count: int = MIN_COUNT) -> Model:
    """Count words and n-grams by language in Spark, then build the bounded tables."""
    own = train.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    own, langs = _sample(own.where("_lang is not null and _text is not null"), per_language)
    counts = settled(_counted_names(_counted_words(own, langs)), "language-names")
    sums = counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()  # sizes x languages
    present = sorted({r["lang"] for r in sums})
    by_name = counts.groupBy("size", "h").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("each"))
    distinct = {r["size"]: r["count"] for r in by_name.groupBy("size").count().collect()}
    kept = by_name.where(F.col("total") >= min_count).select("size", "h", F.explode("each").alias("e")).select(
        "size", "h", "e.lang", "e.n").toArrow()
    size, code, n = (kept.column(c).to_numpy() for c in ("size", "lang", "n"))
    h = kept.column("h").to_numpy().astype(np.int64).view(K.U)
    tables = {}
    for s in (0, *ORDERS):
        totals = np.array([sum(r["n"] for r in sums if r["size"] == s and r["lang"] == p) for p in present], float)
        names, which = np.unique(h[size == s], return_inverse=True)
        tables[s] = _table(names, which, np.searchsorted(present, code[size == s]), n[size == s], totals, distinct.get(s, 0))
    return Model([langs[p] for p in present], tables.pop(0), tables)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            langs, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)],
                                             names=[key, "lang_pred", "score"])

    own = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return own.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds
