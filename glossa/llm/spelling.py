"""Spelling variants by a reduced alphabet.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased.  Two words are near if
they differ by exactly one inserted, deleted or replaced code point.

1. Words are counted over all texts: per Arrow slice first, then by Spark.
2. Every letter is hashed to one of ``SYMBOLS`` symbols.  Words that are near have reduced
   words that are equal or one edit apart.  Of each distinct reduced word the whole one-edit
   neighbourhood counts; as it is symmetric, each pair of reduced words is generated from
   one side only: a deletion from the longer, a replacement by a greater symbol from the
   one with the smaller symbol.  A neighbour is a 64-bit hash, got from the word's own in
   one step, so that long words cost no quadratic memory.
3. Neighbours join the reduced vocabulary.  What stays joins the words on both sides, and
   ``levenshtein`` decides on the original strings.  Collisions of the hashes only add
   candidates.
4. A word's form is its near word of largest count if that is large enough; roots follow
   forms by pointer jumping.  Counts grow by ``ratio`` at each step, so chains are short.

Nulls and texts without a letter have no words; a null key reads as an empty one.  Repeated
rows and repeated keys count as often as they stand.  Empty tables give empty results; other
columns are ignored, whatever their names.  Work memory follows ``CHUNK`` bytes of words, or
the longest word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.repeats import settled

SYMBOLS = 8  # a power of two
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
CHUNK = 1 << 20
LONG_WORD = 64
_SPREAD = 0x85EBCA6B
_BASE = 0x9E3779B97F4A7C15


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the letter runs of all rows, and each run's row.  U+00C0 to U+00FF
    are the code points with lead byte C3."""
    inside = K.ALNUM[data] & ((data < 48) | (data > 57)) & (data < 128) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:] | edge[1:-1]
    return starts, np.flatnonzero(last & after) + 1, np.searchsorted(at, starts, side="right") - 1


def _crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word for every word, from the prefixes' own crc32."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes(), int(state[i]))
    order = np.flatnonzero(sizes <= LONG_WORD)
    order = order[np.argsort(-sizes[order], kind="stable")]
    own, begin = ~state[order], starts[order]
    count = np.searchsorted(-sizes[order], -np.arange(LONG_WORD + 1), side="left")  # words longer than j
    for j in range(LONG_WORD):
        m = int(count[j])
        if not m:
            break
        crc = own[:m]
        own[:m] = CRC_TABLE[(crc ^ data[begin[:m] + j]) & 0xFF] ^ (crc >> np.uint32(8))
    out[order] = ~own
    return out


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray, lead: np.ndarray,
             thin: int | None, least: int) -> pa.Array:
    """The words as strings; where ``thin`` divides a word's crc32, without one code point."""
    before = np.concatenate([[0], np.cumsum(lead)])
    chars = before[ends] - before[starts]
    sizes = ends - starts
    keep_byte = np.ones(int(sizes.sum()), bool)
    at = np.cumsum(sizes) - sizes
    if thin:
        h = _crc32(data, starts, sizes, state).astype(np.int64)
        hit = np.flatnonzero(h % thin == 0)
        place = np.flatnonzero(lead)[before[starts[hit]] + h[hit] % chars[hit]]
        one = at[hit] + place - starts[hit]
        keep_byte[one] = False
        keep_byte[one[data[place] >= 0xC0] + 1] = False
        chars = chars.copy()
        chars[hit] -= 1
        sizes = sizes.copy()
        sizes[hit] -= 1 + (data[place] >= 0xC0)
    whole = data[K.ragged(starts, ends - starts)][keep_byte]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(whole))
    return text.filter(pa.array(chars >= least))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", thin: int | None = None,
                least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_chars`` code points and ``least_count`` occurrences.

    With ``thin``, a word of a row loses the code point ``h % length`` if ``thin`` divides
    ``h``, the crc32 of ``<key>:<word>``: seeded noise to test the grouping with."""
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=1):
            data, at = K.flat(batch.column(1))
            data = K.LOWER[data]
            starts, ends, row = _runs(data, at)
            lead = (data & 0xC0) != 0x80
            long = ends - starts >= least_chars  # at least as many bytes as code points
            starts, ends, row = starts[long], ends[long], row[long]
            prefix = np.array([zlib.crc32(k.encode() + b":") for k in batch.column(0).to_pylist()], np.uint32)
            total = np.cumsum(ends - starts)
            i = 0
            while i < len(starts):  # bounded runs of words
                done = int(total[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
                lo, hi = int(starts[i]), int(ends[j - 1])
                found = _spelled(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo, prefix[row[i:j]], lead[lo:hi],
                                 thin, least_chars)
                counts = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])
                i = j

    found = own.where("body is not null").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _symbols(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all code points of the words, and the words' offsets among them."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    joined = "".join(words.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy())]).astype(np.int64)
    shift = np.uint32(33 - symbols.bit_length())
    return ((points * np.uint32(_SPREAD)) >> shift).astype(np.uint64), at


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(max(1, n), base, K.U)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced_hashes(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of every reduced word: sum of (symbol + 1) * base^place, finished with its length."""
    place = np.arange(len(sym)) - np.repeat(at[:-1], np.diff(at))
    up = _powers(int(np.diff(at).max(initial=1)))
    sums = np.concatenate([np.zeros(1, K.U), np.cumsum((sym + K.U(1)) * up[place])])
    return K.mix((sums[at[1:]] - sums[at[:-1]]) ^ K.mix(np.diff(at).astype(K.U)))


def neighbours(sym: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the one-edit neighbours of the reduced words that are generated from
    their side: every deletion, every replacement by a greater symbol."""
    n = np.diff(at)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(sym)) - at[word]
    most = int(n.max(initial=1))
    up, down = _powers(most + 1), _powers(2, inverse=True)[1]
    terms = (sym + K.U(1)) * up[place]
    sums = np.concatenate([np.zeros(1, K.U), np.cumsum(terms)])
    whole = sums[at[1:]] - sums[at[:-1]]
    same, shorter = K.mix(n.astype(K.U)), K.mix((n - 1).astype(K.U))
    rest = sums[at[1:]][word] - sums[1:]  # after this place
    distinct = np.ones(len(sym), bool)  # deletions inside a run of one symbol are equal
    distinct[1:] = (sym[1:] != sym[:-1]) | (place[1:] == 0)
    gone = (sums[:-1] - sums[at[:-1]][word] + rest * down)[distinct]
    out_word = [word[distinct]]
    out = [K.mix(gone ^ shorter[word[distinct]])]
    for step in range(1, symbols):
        can = np.flatnonzero(sym + K.U(step) < symbols)
        out_word.append(word[can])
        out.append(K.mix((whole[word[can]] + K.U(step) * up[place[can]]) ^ same[word[can]]))
    return np.concatenate(out_word), np.concatenate(out)


def _with_reduced(words: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=0, max_bytes=CHUNK):
            h = reduced_hashes(*_symbols(batch.column(0), symbols))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), K.as_long(h)], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _edges(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(code, other): pairs of reduced words of the vocabulary one edit apart, each once, and
    each reduced word of several words with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=1, max_bytes=CHUNK >> 4):
            sym, at = _symbols(batch.column(1), symbols)
            word, h = neighbours(sym, at, symbols)
            own = batch.column(0).to_numpy()[word]
            yield pa.RecordBatch.from_arrays([pa.array(own), K.as_long(h)], names=["code", "other"])

    # one word spells each reduced word; two reduced words with one code both stay
    spelled = vocabulary.groupBy("code", F.xxhash64(_reduced_text("word", symbols)).alias("spelling")).agg(
        F.min("word").alias("word"), F.count("*").alias("m"))
    spelled = settled(spelled, "spelling-reduced")
    known = spelled.select(F.col("code").alias("other")).distinct()
    apart = spelled.select("code", "word").mapInArrow(run, "code long, other long").join(
        known.hint("merge"), "other", "left_semi").distinct()
    inside = spelled.groupBy("code").agg(F.sum("m").alias("m")).where("m > 1")
    return apart.select("code", "other").unionByName(inside.select("code", F.col("code").alias("other")))


def _reduced_text(word: str, symbols: int):
    """The reduced word as text, in the JVM."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    points = np.array([ord(c) for c in letters], np.uint32)
    codes = ((points * np.uint32(_SPREAD)) >> np.uint32(33 - symbols.bit_length())).tolist()
    return F.translate(F.col(word), "".join(letters), "".join(chr(48 + c) for c in codes))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of (word, n), in both directions."""
    vocabulary = settled(_with_reduced(words, symbols), "spelling-words")
    edges = settled(_edges(vocabulary, symbols), "spelling-edges")
    one = vocabulary.select("code", F.col("word").alias("a"), F.col("n").alias("n_a"))
    two = vocabulary.select(F.col("code").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = edges.join(one.hint("merge"), "code").join(two.hint("merge"), "other")
    pairs = pairs.where((F.col("code") != F.col("other")) | (F.col("a") < F.col("b")))
    pairs = settled(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct(), "spelling-pairs")
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).union(pairs.select("b", "n_b", "a", "n_a").toDF(*names))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointer jumping doubles the way at each turn."""
    chain = settled(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = chain.join(up.hint("merge"), "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step = settled(step, "spelling-roots")
        chain = step.select("word", "root")
        if step.where("moved").isEmpty():
            return chain


def spelling_groups(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words of
    letters (those of ``word_counts``).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is
    at least ``ratio`` times the word's n, else null; the root is where forms lead in the end."""
    words = settled(words.select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    met = near_pairs(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(met.hint("merge"), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = settled(joined.select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
