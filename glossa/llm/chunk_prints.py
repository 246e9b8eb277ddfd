"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its high bits are
zero.  Chunking is normalised: the mask is strict up to the normal size and
loose beyond it, with least and greatest sizes, so chunk sizes vary little and
cuts move with the content.  A fingerprint is the set of chunk digests, each with
its length; the likeness of a text to another is the share of its chunk bytes
whose digests the other has too (containment, weighted by length).

Null counts as empty; an empty text has the empty fingerprint, which is like
another empty one (1) and unlike all else (0).  Repeated rows get equal
fingerprints.  Rows with equal ids are neighbours in the order of their texts.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import kernels as K

LEAST, NORMAL, MOST = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
_GEAR = (K.mix(np.arange(1, 257, dtype=K.U)) >> K.U(32)).astype(np.uint32)
FINGERPRINT = "list of digest:length"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: sum of gear values, each shifted by its age (32 bytes)."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8, 16):
        older = h.copy()
        older[age:] += h[:-age] << np.uint32(age)
        h = older
    return h


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of all rows, in order; every row advances in step."""
    h = gear(data)
    never = np.array([len(data) + 2 * MOST])
    strict = np.concatenate([np.flatnonzero(h >> np.uint32(32 - STRICT_BITS) == 0) + 1, never])
    loose = np.concatenate([np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0) + 1, never])
    full = at[1:] > at[:-1]
    start, end = at[:-1][full], at[1:][full]
    firsts, lasts = [], []
    while len(start):
        cut = strict[np.searchsorted(strict, start + LEAST)]
        late = loose[np.searchsorted(loose, start + NORMAL + 1)]
        cut = np.where(cut <= start + NORMAL, cut, np.minimum(late, start + MOST))
        cut = np.minimum(cut, end)
        firsts.append(start)
        lasts.append(cut)
        more = cut < end
        start, end = cut[more], end[more]
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(firsts)), np.sort(np.concatenate(lasts))


def prints(texts: list[str]) -> list[dict[int, int]]:
    """For every text its chunk digests (48 bits) and their lengths."""
    data, at = K.flat(pa.array(texts, pa.large_string()))
    s, e = chunks(data, at)
    digest = (K.span_hashes(data, s, e) >> K.U(16)).tolist()
    size = (e - s).tolist()
    rows = np.searchsorted(s, at).tolist()
    return [dict(zip(digest[a:b], size[a:b])) for a, b in zip(rows[:-1], rows[1:])]


def spelled(mark: dict[int, int]) -> str:
    return ",".join(["%012x:%d" % x for x in sorted(mark.items())])


def likeness(own: dict[int, int], other: dict[int, int]) -> float:
    if not own:
        return 0.0 if other else 1.0
    return sum([own[k] for k in own.keys() & other.keys()]) / sum(own.values())


def chunk_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            marks = prints([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(spelled, marks), pa.string())],
                                             names=[key, "fingerprint"])

    own = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return own.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each row beside its successor by ascending integer key (after the last: the first).

    Returns (part, helper, key, text), partitioned by ``part`` and sorted, so that within a
    part every row that is no helper is followed by its successor.  The key range is cut at
    quantiles into a bounded number of parts; the first rows of a part also go to the part
    before it, as helpers.  Texts are shuffled once, and no task sees more than its parts.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * n
    own = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_text"))
    ids = own.select(F.coalesce("_k", F.lit(-(1 << 63))).alias("_k"))
    cuts = ids.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).head()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    @F.arrow_udf(T.IntegerType())
    def part(k: pa.Array) -> pa.Array:
        filled = k.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, filled, side="right").astype(np.int32))

    heads = {r["_p"]: r["_k"] for r in
             ids.select(part("_k").alias("_p"), "_k").groupBy("_p").agg(F.min("_k").alias("_k")).collect()}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first part's head goes to the last part

    to = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("helper", T.IntegerType())]))

    @F.arrow_udf(to)
    def targets(k: pa.Array) -> pa.Array:
        filled = k.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        home = np.searchsorted(bounds, filled, side="right").tolist()
        return pa.array([[{"part": p, "helper": 0}] + ([{"part": before[x], "helper": 1}] if x in before else [])
                         for p, x in zip(home, filled.tolist())],
                        pa.list_(pa.struct([("part", pa.int32()), ("helper", pa.int32())])))

    return (own.withColumn("_to", F.explode(targets("_k")))
            .select(F.col("_to.part").alias("part"), F.col("_to.helper").alias("helper"), "_k", "_text")
            .repartition(n, "part").sortWithinPartitions("part", "helper", "_k", "_text"))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit, in which the last quarter is replaced by
    the beginning of the next document; see the columns below."""
    schema = (f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, until its successor comes
        for batch in K.slices(batches, text=3):
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns)))
            held = rows[-1:]
            if out := compare(rows):
                yield out

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        texts = [r[3] or "" for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return None
        edited = []
        for i in pairs:
            quarter = len(texts[i]) // 4
            edited.append(texts[i][:len(texts[i]) - quarter] + texts[i + 1][:quarter])
        marks, after = prints(texts), prints(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([spelled(marks[i]) for i in pairs]),
            pa.array([spelled(x) for x in after]),
            pa.array([likeness(marks[i], x) for i, x in zip(pairs, after)]),
            pa.array([likeness(marks[i], marks[i + 1]) for i in pairs])],
            names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return beside_next(docs, key, text, parts).mapInArrow(run, schema)
