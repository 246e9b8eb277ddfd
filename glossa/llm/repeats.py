"""Shared Spark steps of the two substring operators: which windows of fixed size
occur again, over texts of any number and length.

Windows are handled in *bundles*: runs of consecutive window starts of one text
whose windows contain the same anchor, chosen from the window's content alone.  A
bundle has the anchor's key and its hull, a hash of all text its windows cover.

* Equal windows have equal anchors, so a window of a bundle whose key occurs
  nowhere else does not occur again.
* Bundles with equal key and hull hold the same windows.
* For keys with several hulls, one place of each hull goes on to a finer level.

Every level is a count per key and per (key, hull), combined before the shuffle,
and joins back to the rows that need the answer; Spark may split a hot key in these
joins.  Rows of a task with equal key and hull travel as one, with their places.
What a level finds is written to the shared folder, so a lost executor costs no
more than the level at hand.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.session import scratch_path

PLACE = np.dtype([("k", "<i8"), ("s", "<i8"), ("base", "<i4"), ("lo", "<i4"), ("n", "<i4")])
COUNTED = ["key", "m", "first", "last"]
NO_KEY = -(1 << 63)
SLICE = 1 << 18
#: texts -> key, hull, row, first window start, number of starts; hulls only if asked for
Kernel = Callable[[pa.Array, bool], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.  Shuffles of finished jobs are
    released first: their files would otherwise stay until the driver next collects garbage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes ``settled`` tables that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        jvm = tables[0].sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(tables[0].sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def identified(docs: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """(k, s, base, body, *carried): a text and what names it.  Where keys repeat or are null,
    ``s`` is a hash of the text, so that equal rows share their name and others do not."""
    own = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
                      *carried)
    twice = own.groupBy("k").count().where("count > 1 or k is null")
    s = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("body")
    return own.select(F.coalesce("k", F.lit(NO_KEY)).alias("k"), s.alias("s"), F.lit(0).alias("base"), "body", *carried)


def key_back(k: Column) -> Column:
    return F.when(k != NO_KEY, k)


def _rows(texts: DataFrame, kernel: Kernel, full: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=3, max_bytes=SLICE):
            key, hull, row, lo, n = kernel(batch.column(3), full)
            if not len(key):
                continue
            k, s, base = (batch.column(i).to_numpy()[row] for i in range(3))
            order = np.lexsort((lo, k, hull, key)) if full else np.lexsort((k, key))
            key, k = key[order], k[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if full:
                hull = hull[order]
                new[1:] |= hull[1:] != hull[:-1]
            at = np.append(np.flatnonzero(new), len(key))
            head = at[:-1]
            cols = [K.as_long(key[head]), pa.array(np.diff(at).astype(np.int32)), pa.array(k[head]), pa.array(k[at[1:] - 1])]
            names = COUNTED
            if full:
                places = np.empty(len(key), PLACE)
                places["k"], places["s"], places["base"] = k, s[order], base[order]
                places["lo"], places["n"] = (lo + base)[order], n[order]
                packed = pa.Array.from_buffers(pa.binary(), len(head), [
                    None, pa.py_buffer((at * PLACE.itemsize).astype(np.int32)), pa.py_buffer(places.tobytes())])
                cols, names = [*cols, K.as_long(hull[head]), packed], [*COUNTED, "hull", "places"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "key long, m int, first long, last long" + ", hull long, places binary" * full
    return texts.select("k", "s", "base", "body").mapInArrow(run, schema)


def _unpack(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of a batch, and the row of each."""
    data, at = K.flat(batch.column(column))
    return np.frombuffer(data.tobytes(), PLACE), K.row_of(at // PLACE.itemsize)


def level(texts: DataFrame, kernel: Kernel, earlier: bool, store: str | None = None) -> DataFrame:
    """(k, s, base, lo, n, found): bundles all of whose windows occur again (``found``), and those
    that stand for their hulls where a key is still open.

    ``earlier``: only occurrences in a text with a smaller k count; else any other place does.
    The rows are needed twice: a kernel that costs more than its rows take on disk runs
    once and its rows are kept (``store``), a cheap one runs again.
    """
    kept = settled(_rows(texts, kernel, True), store) if store else None
    shared = ((kept.select(*COUNTED) if store else _rows(texts, kernel, False)).groupBy("key")
              .agg(F.sum("m").alias("n"), F.min("first").alias("f"), F.max("last").alias("l"))
              .where("f < l" if earlier else "n > 1").select("key"))
    rows = (kept if store else _rows(texts, kernel, True)).join(shared, "key").drop("last")
    hulls = rows.groupBy("key", "hull").agg(F.sum("m").alias("nh"), F.min("first").alias("fh"))
    open_keys = hulls.groupBy("key").agg(F.count("*").alias("hulls")).where("hulls > 1").select("key", F.lit(True).alias("open"))
    marked = hulls.join(open_keys, "key", "left").where("open or nh > 1")
    rows = rows.join(marked, ["key", "hull"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, row = _unpack(batch, 0)
            if not len(places):
                continue
            nh, fh, first = (batch.column(i).to_numpy()[row] for i in range(1, 4))
            still = batch.column(4).fill_null(False).to_numpy(zero_copy_only=False)[row]
            found = places["k"] > fh if earlier else nh > 1
            head = np.ones(len(places), bool)
            head[1:] = row[1:] != row[:-1]
            # with ``earlier``, all places in the hull's first text are undecided; else one stands for all
            undecided = still & (places["k"] == fh if earlier else head & (first == fh))
            for which, mark in ((found, True), (undecided, False)):
                p = places[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(p[c])) for c in PLACE.names] + [pa.array(np.full(len(p), mark))],
                    names=[*PLACE.names, "found"])

    return rows.select("places", "nh", "fh", "first", "open").mapInArrow(
        unpack, "k long, s long, base int, lo int, n int, found boolean")


def zoomed(texts: DataFrame, places: DataFrame, cut: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list],
           kind: str) -> DataFrame:
    """(k, s, base, body): the text that the windows of open bundles cover, neighbours joined."""
    by_text = places.groupBy("k", "s", "base").agg(
        F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=3):
            spans = batch.column(4)
            at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            flat = spans.flatten()
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            row = K.row_of(at)
            lo = lo - batch.column(2).to_numpy()[row]
            new = np.ones(len(lo), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] > (lo + n)[:-1])
            head = np.flatnonzero(new)
            end = np.maximum.reduceat(lo + n, head) if len(head) else lo
            bodies = cut(batch.column(3), row[head], lo[head], end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[head])), batch.column(1).take(pa.array(row[head])),
                 pa.array((lo[head] + batch.column(2).to_numpy()[row[head]]).astype(np.int32)),
                 pa.array(bodies, pa.binary() if kind == "binary" else pa.string())], names=["k", "s", "base", "body"])

    return texts.join(by_text, ["k", "s", "base"]).select("k", "s", "base", "body", "spans").mapInArrow(
        run, f"k long, s long, base int, body {kind}")


def found_spans(texts: DataFrame, kernels: list[Kernel], cut: Callable, kind: str, earlier: bool, name: str,
                store: bool = False) -> DataFrame:
    """(k, s, spans array<struct<lo, n>>): per text the window starts that occur again."""
    spark, parts = texts.sparkSession, []
    for i, kernel in enumerate(kernels):
        out = settled(level(texts, kernel, earlier, f"{name}-rows{i}" if store else None), f"{name}-level{i}")
        release(spark)
        parts.append(out.where("found").select("k", "s", "lo", "n"))
        if i + 1 < len(kernels):
            texts = settled(zoomed(texts, out.where("not found"), cut, kind), f"{name}-open{i}")
            release(spark)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("k", "s").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def span_arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, starts and counts of a column of spans (null: none)."""
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten()
    at = column.offsets.to_numpy()
    return at - at[0], flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
