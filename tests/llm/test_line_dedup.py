"""Line dedup and its perfect hash against brute force."""
import random
from collections import Counter

import numpy as np
import pytest

from glossa.llm import line_dedup as L

from llm_helpers import CLASH, SCHEMA, build, by_row

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(BLANK).translate(FOLD)


def brute(texts, least):
    n = Counter(k for _, t in texts for k in {key_of(x) for x in (t or "").split("\n")})
    out = {}
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key_of(x) and n[key_of(x)] >= least)]
        out.setdefault(d, []).append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return {d: sorted(rows) for d, rows in out.items()}


def got(frame, **options):
    return {d: sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in rows)
            for d, rows in by_row(L.without_frequent_lines(frame, **options)).items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = ["Share this", "  share THIS\r", "\tÄ header", "ä header", "Ä HEADER ", " nbsp", "x", "", "   ", "\x1cfs"]
    out = [(i, "\n".join(rng.choice(common + [f"line {rng.randrange(60)}", f"own {i}"]) for _ in range(rng.randint(0, 9))))
           for i in range(80)]
    out += [(900, None), (901, ""), (902, "\n"), (903, "x\nx\nx"), (None, "share this\nnull key"), (None, "share this\nnull key"),
            (None, "other null key\nx"), (904, "a" * 200_000 + "\nx\n" + "b\n" * 50_000), (905, "share this"), (905, "line 3\nline 3"),
            (905, "share this")]
    return out


@pytest.mark.parametrize("least,shard,slice_bytes", [(10, 1 << 17, 2 << 20), (3, 5, 60), (2, 16, 2 << 20), (1, 7, 500), (300, 3, 60)])
def test_against_brute_force(spark, texts, monkeypatch, least, shard, slice_bytes):
    """Any number of shards and any size of slices give the same rows."""
    slices = L.K.slices
    monkeypatch.setattr(L.K, "slices", lambda b, text=1: slices(b, text, slice_bytes))
    rows = [(i, t, "en", "src", 0, *["x"] * len(CLASH)) for i, t in texts]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(frame, least_docs=least, shard=shard) == brute(texts, least)


def test_edge_and_empty(spark, edge, edge_texts, empty):
    assert got(edge, least_docs=2) == brute(edge_texts, 2)
    assert L.without_frequent_lines(empty).count() == 0
    blank = build(spark, [(1, None), (2, ""), (3, "\n\n")])
    assert got(blank) == brute([(1, None), (2, ""), (3, "\n\n")], 10)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 32, n, dtype=np.uint32)
    h[: n // 3] = h[n // 3: 2 * (n // 3)]  # equal places, told apart by the other 32 bits
    own = L.PerfectHash.build(h, f)
    assert sorted(own.slot(h, f).tolist()) == list(range(n))
    assert len(own.bits) <= 64 * 20 + 5 * n


def test_index_counts(spark):
    """The arrays give every digest's count up to the threshold, and 0 to one that is not held."""
    rng = np.random.default_rng(5)
    rows = [(int(h), int(f), int(n)) for h, f, n in zip(rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(0, 1 << 32, 300),
                                                        rng.integers(1, 600, 300))]
    index, shards = L.build_index(spark.createDataFrame(rows, "h long, f long, n long"), least_docs=300, shard=64)
    held = {r["shard"]: r for r in index.collect()}
    assert shards == 5 and sum(r["n"] for r in held.values()) == 300 and len(held[0]["counts"]) == 2 * held[0]["n"]
    for h, f, n in rows:
        r = held[h % shards]
        held_by = L.Shard(r["sizes"], r["bits"], r["prints"], r["counts"], r["n"])
        assert held_by.counts_at(np.array([h]).view(np.uint64), np.array([f], np.uint32))[0] == min(n, 300)
        assert held_by.counts_at(np.array([h]).view(np.uint64), np.array([f ^ 1], np.uint32))[0] == 0
