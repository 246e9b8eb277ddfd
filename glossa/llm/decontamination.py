"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z.  A benchmark
item's windows are its runs of 13 words (an item of 1 to 12 words is one window).
Of every 8 consecutive 6-gram hashes the smallest (leftmost on ties) is kept as a
fingerprint, in documents and items alike; any 13 words hold exactly 8 6-grams,
so a shared window always shares a fingerprint at the same place in it.  Windows
of short items are kept whole: k is their own length and every gram is kept.

Fingerprints of a document are joined with those of the benchmark; hits are
extended to the windows around them, which are compared word by word.  The
benchmark side goes out in blocks of at most ``block_words`` words (a block is
broadcast, so its size is bounded whatever the benchmark's), with one pass over
the documents per block and a union of the hit spans.

Null and empty texts have no words (0, 0, 0 items, not contaminated).  Items
without words have no windows.  Items with equal texts count one by one, and
repeated rows of one item id once.  Repeated document rows are judged one by one.
Empty tables and clashing extra columns are fine: only key and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.repeats import settled
from glossa.session import cut_lineage

WINDOW, GRAM = 13, 6
BLOCK_WORDS = 500_000  # some 150 MB of windows in a worker


def _folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = K.flat(texts)
    data = K.LOWER[data]
    return (data, *K.words(data, at, K.ALNUM))


def _kept(hashes: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of words inside a row: its start, its fingerprint's place and hash."""
    grams = K.gram_hashes(hashes, gram)
    place = K.sliding_first_min(grams, window - gram + 1)
    ends = np.repeat(rows[1:], np.diff(rows))
    starts = np.flatnonzero(np.arange(len(place)) + window <= ends[:len(place)])
    place = place[starts]
    return starts, place, grams[place]


class Block:
    """Windows of a bounded part of the benchmark, and their fingerprints."""

    def __init__(self, items: list[tuple[str, str]]):
        self.windows: dict[bytes, set[str]] = defaultdict(set)
        sizes: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            data, s, e, rows = _folded_words(pa.array([text]))
            if not len(s):
                continue
            raw = data.tobytes()
            own = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            size = min(WINDOW, len(own))
            gram = GRAM if size == WINDOW else size
            starts, _, fingerprints = _kept(K.span_hashes(data, s, e), rows, size, gram)
            for i in starts.tolist():
                self.windows[b" ".join(own[i:i + size])].add(item)
            sizes[size].update(fingerprints.tolist())
        self.fingerprints = {n: np.array(sorted(v), dtype=K.U) for n, v in sizes.items()}

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, list[dict[tuple[int, int], set[str]]]]:
        """Words per row, and per row the spans of words that are benchmark windows."""
        data, s, e, rows = _folded_words(texts)
        found: list[dict[tuple[int, int], set[str]]] = [{} for _ in range(len(texts))]
        if not len(s):
            return np.diff(rows), found
        hashes, raw = K.span_hashes(data, s, e), None
        for size, own in self.fingerprints.items():
            starts, _, fingerprint = _kept(hashes, rows, size, GRAM if size == WINDOW else size)
            at = np.minimum(np.searchsorted(own, fingerprint), len(own) - 1)
            for i in starts[own[at] == fingerprint].tolist():
                raw = raw if raw is not None else data.tobytes()
                ids = self.windows.get(b" ".join([raw[a:b] for a, b in zip(s[i:i + size], e[i:i + size])]))
                if ids:
                    row = int(np.searchsorted(rows, i, side="right")) - 1
                    found[row][(i - int(rows[row]), i - int(rows[row]) + size)] = ids
        return np.diff(rows), found


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    held, size = [], 0
    own = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    for row in own.where("t is not null").distinct().toLocalIterator():
        n = len(row.t) // 2 + 1  # at most so many words
        if held and (size + n > block_words):
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += n
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, n_hit, item_ids array<string>, spans array<struct<first, last>>) per document."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, row long, n_words long, n_hit long, item_ids array<string>, first array<int>, " \
             f"last array<int>"
    own = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"), F.lit(0).cast("long").alias("row"))
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        # each block is a job of its own: rows are numbered and written once, so that all name them alike
        own = settled(own.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")

    def one(items: list[tuple[str, str]]) -> DataFrame:
        block = sc.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Block(block.value)
            for batch in K.slices(batches):
                n, found = ready.hits(batch.column(1))
                first, last, hit, ids = [], [], [], []
                for i, spans in enumerate(found):
                    edges = sorted(spans)
                    first.append([a for a, _ in edges])
                    last.append([b for _, b in edges])
                    hit.append(int(K.covered(first[-1], last[-1], int(n[i])).sum()) if edges else 0)
                    ids.append(sorted(set().union(*spans.values())) if edges else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n), pa.array(hit, pa.int64()),
                     pa.array(ids, pa.list_(pa.string())), pa.array(first, pa.list_(pa.int32())),
                     pa.array(last, pa.list_(pa.int32()))],
                    names=[key, "row", "n_words", "n_hit", "item_ids", "first", "last"])

        return own.mapInArrow(scan, schema)

    if second is None:
        return one(first).drop("row")
    parts = [cut_lineage(one(items)) for items in chain([first, second], blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    spans = union.groupBy("row").agg(
        F.first(key).alias(key), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("first", "last")))).alias("s"))
    end = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), _cover, lambda a: a["n"])
    return spans.select(key, "n_words", end.alias("n_hit"), "item_ids", F.col("s.first").alias("first"),
                        F.col("s.last").alias("last"))


def _cover(acc: Column, span: Column) -> Column:
    start = F.greatest(acc["to"], span["first"])
    return F.struct((acc["n"] + F.greatest(F.lit(0), span["last"] - start)).cast("long").alias("n"),
                    F.greatest(acc["to"], span["last"]).alias("to"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is covered by benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged (keys are assumed to name
    texts: where a key repeats, the row goes if any row of that key is contaminated)."""
    bad = (contamination(docs, benchmark, key, text).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
           .select(F.col(key).alias("_bad")).distinct())
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")
