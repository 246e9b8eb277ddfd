"""Centroid clustering against plain Python integers."""
import hashlib
import math
import random

import pytest

from glossa.llm import centroids as C


def quantise(x, dims, scale=1024):
    if x is None or len(x) != dims or any(v is None or not math.isfinite(v) for v in x):
        return None
    return [math.floor(min(max(v * scale, -(2.0 ** 27)), 2.0 ** 27)) for v in x]


def brute(rows, k, rounds, dims, salt):
    kept = [(i, q) for i, q in ((i, quantise(x, dims)) for i, x in rows) if q is not None]
    first = sorted((hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    centres = [q for _, q in first]
    assign = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(assign(q)[1], []).append(q)
        for n, qs in groups.items():
            centres[n] = [sum(col) // len(qs) for col in zip(*qs)]
    last = [(i, *assign(q)[::-1]) for i, q in kept]
    by = {}
    for _, n, d in last:
        by[n] = by.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, n, d, fits(by[n]), fits(sum(by.values())), digest[n]) for i, n, d in last), key=str)


def run(spark, rows, k, rounds, dims, salt=3):
    frame = spark.createDataFrame([(i, x, "c", "n") for i, x in rows], "vec_id long, embedding array<double>, cluster string, q string")
    out = C.cluster_report(C.fit(frame.repartition(3), k=k, rounds=rounds, dims=dims, salt=salt))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.columns == names
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("k,rounds,dims", [(8, 10, 4), (3, 2, 64), (1, 1, 2), (5, 0, 3)])
def test_against_brute_force(spark, k, rounds, dims):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(dims)]) for i in range(90)]
    rows += [(100, rows[0][1])] * 30 + [(0, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(200, None), (201, []), (202, [0.0] * (dims + 1)), (203, [None] + [0.0] * (dims - 1)),
             (204, [math.nan] + [0.0] * (dims - 1)), (205, [math.inf] * dims), (206, [-math.inf] + [1.0] * (dims - 1)),
             (207, [-0.0] * dims), (208, [-1e-9] * dims)]
    assert run(spark, rows, k, rounds, dims) == brute(rows, k, rounds, dims, 3)


def test_huge_components_and_ties(spark):
    """Components beyond the limit are held there; sums that leave a long are null; ties take the smaller number."""
    rows = [(i, [1e300 * (-1) ** i] * 64) for i in range(6)] + [(i, [1.7e5 * (-1) ** (i // 3)] * 64) for i in range(6, 12)]
    assert run(spark, rows, 2, 3, 64) == brute(rows, 2, 3, 64, 3)
    ties = [(i, [float(i % 2), 0.0]) for i in range(8)]
    assert run(spark, ties, 8, 2, 2) == brute(ties, 8, 2, 2, 3)


def test_empty_clusters_and_tables(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 2.0])]
    assert run(spark, few, 8, 10, 2) == brute(few, 8, 10, 2, 3)
    assert run(spark, [], 8, 10, 2) == []
    assert run(spark, [(1, None)], 8, 10, 2) == []


def test_task_code_stays_in_the_jvm(spark):
    found = C.fit(spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>"))
    plan = C.cluster_report(found)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert found.sizes == [{0: 1}] * 10
