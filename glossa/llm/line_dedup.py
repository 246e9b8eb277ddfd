"""Line dedup with a sharded minimal perfect hash.

Texts are split at ``\\n``.  A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both
ends, A-Z lower-cased.  Lines whose key has at least one code point and stands in at least
``least_docs`` rows go, in every text.

1. Each text's distinct keys become 96-bit digests (64 bits to place, 32 to check), written
   once, with the text's name, as packed rows.
2. Spark counts texts per digest (per Arrow slice first).  The distinct digests are dealt into
   shards of about ``SHARD`` by hash.  A shard becomes one row: a minimal perfect hash in bit
   levels (a key sits at the first level where no other meets it; its slot is the number of
   set bits before), a 32-bit fingerprint and a count in each slot.  Counts stop at what the
   threshold needs, so they take the fewest bytes.
3. Texts probe the arrays: the digests of a slice of texts go out packed by shard, and are
   dealt and sorted behind the one row of their shard's arrays.  No line is joined with a line,
   and no array travels twice.  A line in ``least_docs`` texts of one slice is answered at once
   and needs no probe, so a very common line costs each slice less than ``least_docs`` probes.
   A task holds one shard's arrays and one row of probes at a time.
4. What is to go comes back by text, and the texts drop their lines.

No shard, slice or probe row grows with the corpus; their numbers do.  Null and empty texts
have one empty line, which stays.  Equal rows count as texts of their own; rows with equal keys
and different texts are judged one by one, a null key like any other.  Empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.repeats import identified, key_back, settled

LEAST_DOCS = 10
SHARD = 1 << 17
PROBES = 1 << 14
GAMMA, LEVELS = 2.0, 64
BLANK = b" \t\n\x0b\x0c\r"
DIGEST = np.dtype([("h", "<u8"), ("f", "<u4")])
INDEX = "shard long, n long, sizes array<long>, bits binary, prints binary, counts binary"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower folds A-Z only


def digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=12).digest() for k in keys), DIGEST)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, r, body): r names a text (equal rows share it)."""
    own = identified(docs, key, text)
    return own.select("k", F.when(F.col("s") == 0, F.col("k")).otherwise(F.xxhash64("k", "s")).alias("r"), "body")


def _lines(texts: DataFrame) -> DataFrame:
    """(r, h, f) packed by slice: every distinct key of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=1):
            found, names = [], []
            for r, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = {line_key(x) for x in body.split(b"\n")}
                own.discard(b"")
                found.append(digests(sorted(own)))
                names.append(np.full(len(own), r, np.int64))
            every, name = np.concatenate(found), np.concatenate(names)
            order = np.lexsort((name, every["f"], every["h"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[order].tobytes()], pa.binary()), pa.array([every[order].tobytes()], pa.binary())],
                names=["names", "lines"])

    return texts.select("r", "body").mapInArrow(run, "names binary, lines binary")


def _starts(lines: np.ndarray) -> np.ndarray:
    """Where runs of equal digests begin, and the end."""
    new = np.ones(len(lines), bool)
    new[1:] = (lines["h"][1:] != lines["h"][:-1]) | (lines["f"][1:] != lines["f"][:-1])
    return np.append(np.flatnonzero(new), len(lines))


def line_counts(lines: DataFrame) -> DataFrame:
    """(h, f, n): the number of texts of every distinct digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, DIGEST)
                at = _starts(own)
                one = own[at[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [K.as_long(one["h"].copy()), pa.array(one["f"].astype(np.int64)), pa.array(np.diff(at))], names=["h", "f", "n"])

    return lines.select("lines").mapInArrow(run, "h long, f long, n long").groupBy("h", "f").agg(F.sum("n").alias("n"))


def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix(h ^ K.mix(f.astype(K.U) + K.U(level << 32))) % K.U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct (h, f): slots 0 .. n - 1, in bit levels."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.slots = np.cumsum(bits) - 1

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h):
            if len(sizes) == LEVELS:
                raise ValueError("the same digest stands twice in a shard")
            size = max(64, int(GAMMA * len(h)))
            at = _place(h, f, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[at]
            h, f = h[rest], f[rest]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slot(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The slot of every key; one that is not of the set gets any slot or -1."""
        out = np.full(len(h), -1, np.int64)
        left, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(h[left], f[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.slots[at[here]]
            left, base = left[~here], base + size
        return out


def build_index(counts: DataFrame, least_docs: int = LEAST_DOCS, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The shards of (h, f, n) as rows, and their number.  Counts are exact up to ``least_docs``."""
    shards = counts.count() // shard + 1
    width = np.min_scalar_type(least_docs).newbyteorder("<")

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        h, f, n = (t.column(i).to_numpy() for i in ("h", "f", "n"))
        h, f = h.astype(np.int64).view(K.U), f.astype(np.uint32)
        own = PerfectHash.build(h, f)
        at = own.slot(h, f)
        prints, held = np.zeros(len(h), "<u4"), np.zeros(len(h), width)
        prints[at], held[at] = f, np.minimum(n, least_docs)
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "n": pa.array([len(h)], pa.int64()),
            "sizes": pa.array([own.sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(own.bits).tobytes()], pa.binary()),
            "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([held.tobytes()], pa.binary())})

    dealt = counts.withColumn("shard", F.pmod("h", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, INDEX), shards


class Shard:
    """The arrays of one shard, as ``build_index`` packs them."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, n: int):
        self.places = PerfectHash(list(sizes), np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool))
        self.prints = np.frombuffer(prints, "<u4")
        self.counts = np.frombuffer(counts, np.dtype(f"<u{len(counts) // n}")).astype(np.int64)

    def counts_at(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The count of every digest, 0 for those that the shard does not hold."""
        at = self.places.slot(h, f)
        return np.where((at >= 0) & (self.prints[at] == f), self.counts[at], 0)


def _probes(lines: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """(shard, names, lines): the packed probes of a slice by shard; shard -1 is what the slice
    itself shows to stand in ``least_docs`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, own = np.frombuffer(names, np.int64), np.frombuffer(raw, DIGEST)
                sizes = np.diff(_starts(own))
                shard = (own["h"].copy().view(np.int64) % shards).astype(np.int64)  # sign of the divisor, as pmod
                shard[np.repeat(sizes >= least_docs, sizes)] = -1
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order])) + 1
                parts = [p[i:i + PROBES] for p in np.split(order, cut) for i in range(0, len(p), PROBES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[p[0]]) for p in parts], pa.int64()),
                     pa.array([name[p].tobytes() for p in parts], pa.binary()),
                     pa.array([own[p].tobytes() for p in parts], pa.binary())], names=["shard", "names", "lines"])

    return lines.select("names", "lines").mapInArrow(run, "shard long, names binary, lines binary")


def _frequent(probes: DataFrame, index: DataFrame, least_docs: int) -> DataFrame:
    """(r, h): the lines of every text that stand in at least ``least_docs`` texts."""

    def rows(name: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name), K.as_long(own["h"].copy())], names=["r", "h"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield rows(np.frombuffer(names, np.int64), np.frombuffer(raw, DIGEST))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Shard | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                names, raw, n, sizes, bits, prints, counts = (batch.column(j)[i].as_py() for j in range(2, 9))
                if names is None:
                    held = Shard(sizes, bits, prints, counts, n)
                    continue
                name, own = np.frombuffer(names, np.int64), np.frombuffer(raw, DIGEST)
                often = held.counts_at(own["h"].copy(), own["f"].copy()) >= least_docs
                yield rows(name[often], own[often])

    arrays = ("n", "sizes", "bits", "prints", "counts")
    heads = index.select("shard", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("names"),
                         F.lit(None).cast("binary").alias("lines"), *arrays)
    tails = probes.where("shard >= 0").select("shard", F.lit(1).alias("side"), "names", "lines",
                                              *(F.lit(None).cast(index.schema[a].dataType).alias(a) for a in arrays))
    met = heads.union(tails).repartition("shard").sortWithinPartitions("shard", "side")
    here = probes.where("shard < 0").select("names", "lines").mapInArrow(known, "r long, h long")
    return here.unionByName(met.mapInArrow(probe, "r long, h long"))


def without_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS,
                           shard: int = SHARD) -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row; ``kept`` is the text without its frequent lines."""
    texts = _named(docs, key, text)
    lines = settled(_lines(texts), "lines")
    counts = settled(line_counts(lines), "line-counts")
    index, shards = build_index(counts, least_docs, shard)
    index = settled(index, "line-index")
    probes = settled(_probes(lines, shards, least_docs), "line-probes")
    gone = _frequent(probes, index, least_docs).groupBy("r").agg(F.collect_set("h").alias("gone"))
    both = texts.join(gone.hint("merge"), "r", "left").select("k", "body", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=1):
            n_lines, n_dropped, kept = [], [], []
            for body, out in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                own = body.split(b"\n")
                left = own
                if out:
                    keys = [line_key(x) for x in own]
                    drop = np.isin(digests(keys)["h"].copy().view(np.int64), np.array(out, np.int64)).tolist()
                    left = [x for x, k, d in zip(own, keys, drop) if not (d and k)]
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["k", "n_lines", "n_dropped", "kept"])

    out = both.mapInArrow(run, "k long, n_lines long, n_dropped long, kept string")
    return out.select(key_back(F.col("k")).alias(key), "n_lines", "n_dropped", "kept")
