"""Suffix dedup, recompression and the n-gram join against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import ngram_join, recompression, suffix_dedup

from llm_helpers import build, by_row, prose

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_suffix(texts, window):
    bodies = [(t or "").encode() for _, t in texts]
    seen = Counter(b[i:i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, window):
    first, rows = {}, [(d, SPACED.findall(t or "")) for d, t in texts]
    for d, w in rows:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [(d, shingles(t)) for d, t in texts]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(a), least[find(i)]) for i, (_, a) in enumerate(sets)]


def assert_rows(texts, expected, found, fields):
    want = {}
    for (d, _), e in zip(texts, expected):
        want.setdefault(d, []).append(e)
    got = {d: sorted(tuple(r[f] for f in fields) for r in rows) for d, rows in found.items()}
    assert got == {d: sorted(rows) for d, rows in want.items()}


@pytest.mark.parametrize("threshold", [200, 25])
def test_suffix_dedup(edge, edge_texts, threshold):
    found = by_row(suffix_dedup.removed_repeats(edge, threshold=threshold))
    assert_rows(edge_texts, brute_suffix(edge_texts, threshold), found, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


@pytest.mark.parametrize("window,rounds", [(50, 4), (8, 2), (5, 0)])
def test_recompression(edge, edge_texts, window, rounds):
    found = by_row(recompression.deduplicated(edge, window=window, rounds=rounds))
    assert_rows(edge_texts, brute_passages(edge_texts, window), found, ("n_words", "n_removed", "kept"))


def test_periodic_and_small_alphabets(spark):
    """Ties everywhere: few words, few letters, runs and periods."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(0, 120)))) for i in range(25)]
    texts += [(50 + i, "a " * (20 + i)) for i in range(5)] + [(60 + i, ("a b b " * 20)[i:]) for i in range(5)]
    docs = build(spark, texts)
    assert_rows(texts, brute_suffix(texts, 12), by_row(suffix_dedup.removed_repeats(docs, threshold=12)),
                ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert_rows(texts, brute_passages(texts, 6), by_row(recompression.deduplicated(docs, window=6, rounds=3)),
                ("n_words", "n_removed", "kept"))
    assert_rows(texts, brute_components(texts), by_row(ngram_join.jaccard_components(docs)), ("n_shingles", "component_id"))


def test_one_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = [(i, prose(rng, 30) + (" " + passage + " " if i % 3 == 0 else " ") + prose(rng, 30)) for i in range(90)]
    docs = build(spark, texts)
    assert_rows(texts, brute_suffix(texts, 200), by_row(suffix_dedup.removed_repeats(docs)),
                ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert_rows(texts, brute_passages(texts, 50), by_row(recompression.deduplicated(docs)), ("n_words", "n_removed", "kept"))


def test_without_repeats_keeps_columns_and_untouched_texts(edge, edge_texts):
    out = recompression.without_repeats(edge)
    assert out.columns == edge.columns
    got = by_row(out)
    assert sum(map(len, got.values())) == len(edge_texts)
    assert got[3][0]["text"] == " \n\t " and got[20][0]["label"] == "x"
    assert got[23][0]["text"] == "" and got[4][0]["text"] == "word"


def test_ngram_join(edge, edge_texts):
    found = by_row(ngram_join.jaccard_components(edge))
    assert_rows(edge_texts, brute_components(edge_texts), found, ("n_shingles", "component_id"))


@pytest.fixture(scope="module")
def chained(spark):
    """Chains of edits (links that only exist through others), near misses, copies, shared passages."""
    rng = random.Random(5)
    texts, i = [], 0
    passage = prose(rng, 40)
    for family in range(12):
        words = prose(rng, rng.randint(20, 160)).split(" ")
        for step in range(9):
            texts.append((i, " ".join(words)))
            i += 1
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
            if step == 4 and family % 3 == 0:
                words += passage.split(" ")
    rng.shuffle(texts)
    return texts, build(spark, texts)


def test_ngram_join_follows_chains(chained):
    texts, docs = chained
    assert_rows(texts, brute_components(texts), by_row(ngram_join.jaccard_components(docs)), ("n_shingles", "component_id"))


def spied(monkeypatch, name, keys, of):
    """Sizes of the groups by ``keys`` of what ``ngram_join.name`` is given (of=0) or gives (of=1)."""
    real, sizes = getattr(ngram_join, name), []

    def run(*args):
        out = real(*args)
        sizes.extend(r["count"] for r in (out if of else args[0]).groupBy(*keys).count().collect())
        return out

    monkeypatch.setattr(ngram_join, name, run)
    return sizes


def test_template_with_own_words_makes_no_block(spark, monkeypatch):
    """Four fifths are shared and a fifth is the text's own: such texts do not link."""
    rng = random.Random(13)
    template = prose(rng, 80, 10_000)
    texts = [(i, template + " " + prose(rng, 20, 10_000)) for i in range(60)]
    sizes = spied(monkeypatch, "_open_points", ["token"], 0)
    found = by_row(ngram_join.jaccard_components(build(spark, texts)))
    assert_rows(texts, brute_components(texts), found, ("n_shingles", "component_id"))
    assert max(sizes, default=0) < 10


@pytest.mark.parametrize("rounds", [0, 2])
def test_large_blocks_are_dealt_in_chunks(spark, monkeypatch, rounds):
    """A template with one of eight common endings and few or many own words, beside bare templates."""
    rng = random.Random(17)
    template, endings = prose(rng, 60, 10_000), [prose(rng, 30, 10_000) for _ in range(8)]
    texts = [(i, f"{template} {endings[i % 8]} {prose(rng, rng.choice([0, 3, 8, 16, 25]), 10_000)}") for i in range(150)]
    texts += [(200 + i, template + " " + prose(rng, 1 + i, 10_000)) for i in range(20)]
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "CHUNK", 20)
    monkeypatch.setattr(ngram_join, "SET_CHUNK", 2000)
    blocks, groups = spied(monkeypatch, "_open_points", ["token"], 0), spied(monkeypatch, "_members", ["token", "band", "x", "y"], 1)
    found = by_row(ngram_join.jaccard_components(build(spark, texts)))
    assert_rows(texts, brute_components(texts), found, ("n_shingles", "component_id"))
    assert max(blocks) > 100 and 16 < max(groups) < 80


def near_template(rng, families, size):
    """Texts of a family share about 0.67 of their shingles, some pairs of each family more; few link."""
    texts = []
    for f in range(families):
        template = prose(rng, 160, 100_000).split(" ")
        for i in range(size):
            words = template[:]
            for place in rng.sample(range(0, 160, 5), 6):
                words[place] = f"own{f}x{i}x{place}"
            texts.append((len(texts), " ".join(words)))
            if i % 5 == 0:
                words[80:82] = ["linked", "copy"]
                texts.append((len(texts), " ".join(words)))
    return texts


def test_join_output_is_linear(spark, monkeypatch):
    """Families four times as large give about four times the rows, not sixteen, and all links."""
    sent = []
    for size in (16, 64):
        points, links = spied(monkeypatch, "_open_points", ["c"], 1), spied(monkeypatch, "_forest", ["a", "b"], 1)
        texts = near_template(random.Random(29), 6, size)
        found = by_row(ngram_join.jaccard_components(build(spark, texts)))
        assert_rows(texts, brute_components(texts), found, ("n_shingles", "component_id"))
        assert sum(links) < len(texts)
        sent.append((sum(points) + sum(links)) / len(texts))
        monkeypatch.undo()
    assert sent[1] < 2 * max(sent[0], 1)


def test_met_before():
    rng = random.Random(2)
    lists = [np.array(rng.sample(range(-50, 150), rng.choice([0, 1, 5, 30, 70])), np.int64) for _ in range(60)]
    a, b = (np.array([rng.randrange(60) for _ in range(500)]) for _ in range(2))
    assert ngram_join.met_before(lists, a, b).tolist() == [bool(set(lists[i].tolist()) & set(lists[j].tolist())) for i, j in zip(a, b)]


def test_spanning_links():
    """The links of a group join what brute force joins, with fewer rows than sets."""
    rng = random.Random(4)
    for _ in range(20):
        base = rng.sample(range(1000), 40)
        sets = [np.array(sorted(set(base[:rng.randint(25, 40)]) | set(rng.sample(range(1000), rng.randint(1, 9)))), np.uint64)
                for _ in range(30)]
        label = np.array([rng.randrange(25) for _ in sets])
        links = ngram_join.spanning_links(sets, label, lambda i, js: np.ones(len(js), bool), 75)
        every = [(i, j) for i in range(30) for j in range(i) if label[i] != label[j]
                 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]

        def joined(pairs):
            comp = label.tolist()
            for i, j in pairs:
                comp = [comp[j] if c == comp[i] else c for c in comp]
            first = {}
            return [first.setdefault(c, k) for k, c in enumerate(comp)]

        assert joined(links) == joined(every) and len(links) < len(set(label.tolist()))


def test_ngram_join_without_pivots(chained, monkeypatch):
    """The R-tree alone finds every pair, and shingles in any order do."""
    texts, docs = chained
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 2)
    assert_rows(texts, brute_components(texts), by_row(ngram_join.jaccard_components(docs)), ("n_shingles", "component_id"))


def test_one_of_each(edge):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(edge).collect()]
    assert {1, 2, 3, 4, 6, 10, 20, 43} <= set(kept) and not {5, 11, 12} & set(kept)


def test_null_keys(spark):
    docs = build(spark, [(1, "a b c d e f")]).unionByName(
        build(spark, [(2, "a b c d e f")]).withColumn("doc_id", F.lit(None).cast("long")))
    assert {r["doc_id"] for r in suffix_dedup.removed_repeats(docs, threshold=4).collect()} == {1, None}
    assert {r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {None}
    assert {(r["doc_id"], r["n_removed"]) for r in recompression.deduplicated(docs, window=3).collect()} == {(1, 6), (None, 0)}


def test_empty_tables(empty):
    assert suffix_dedup.removed_repeats(empty).count() == 0
    assert recompression.deduplicated(empty).count() == 0
    assert recompression.without_repeats(empty).columns == empty.columns
    assert ngram_join.jaccard_components(empty).count() == 0
