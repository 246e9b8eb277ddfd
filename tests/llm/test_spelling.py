"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(texts, thin=None, least=7):
    n = Counter()
    for key, text in texts:
        for w in RUN.findall((text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if thin and h % thin == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    near_of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in near_of.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near_of[w]), words.get(form[w]))
    return out


@pytest.mark.parametrize("thin", [None, 3])
@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_word_counts(spark, edge, edge_texts, monkeypatch, thin, chunk):
    """Any block size gives the counts of plain Python, with and without seeded noise."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    got = S.word_counts(edge, thin=thin, least_chars=3).collect()
    assert {r["word"]: r["n"] for r in got} == brute_words(edge_texts, thin, 3)


def test_words_at_the_edges(spark):
    texts = [(1, "ÀÉÿabcd× ÀÉÿabcd× naïveté!naïveté Āabcdefg Āabcdefg"), (2, "x" * 500 + " " + "x" * 500), (3, None), (4, ""),
             (None, "nullkeyed nullkeyed"), (5, "wordone1wordone ＡＢＣＤＥＦＧ wordone"), (5, "wordone1wordone ＡＢＣＤＥＦＧ wordone"),
             (6, "日本語日本語日本 " * 3), (7, "ÃÃÃÃÃÃÃ " * 2)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for thin in (None, 1, 2, 31):
        got = S.word_counts(frame, thin=thin).collect()
        assert {r["word"]: r["n"] for r in got} == brute_words(texts, thin)


def variants(rng, n=60, alphabet="abcdeéüz"):
    """Words with chains of ever rarer misspellings, repeated letters, and all letters alike."""
    words = {}
    for _ in range(n):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 9)))
        count = rng.choice([2, 3, 30, 500, 40_000])
        for _ in range(rng.randint(1, 5)):
            words.setdefault(w, count)
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            w = w if len(w) >= 7 else w + c * 2
            count = max(2, count // rng.choice([3, 10, 12]))
    words.update({"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "baaaaaaa": 500, "aaaaaaab": 500})
    return words


@pytest.mark.parametrize("symbols", [2, 8, 16])
def test_groups(spark, symbols):
    words = variants(random.Random(symbols))
    got = S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), symbols=symbols)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == brute_groups(words)


def test_long_chain(spark):
    words = {"a" * 7 + "b" * i: 2 * 10 ** (12 - i) for i in range(12)}
    got = S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r["root"] for r in got.collect()} == {"a" * 7}


def test_long_words(spark):
    """Neighbours of a word of 30,000 letters are hashes: linear, not quadratic, in its length."""
    long = "abcdefgh" * 3750
    words = {long: 100, long[:20_000] + long[20_001:]: 3, long[:-1] + "é": 4, long + "xx": 9}
    got = {r["word"]: (r["form"], r["n_near"]) for r in
           S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {long: (None, 2), long[:20_000] + long[20_001:]: (long, 1), long[:-1] + "é": (long, 1), long + "xx": (None, 0)}


def test_generated_neighbours_are_complete():
    """Every pair of reduced words one edit apart is generated from one of the two sides."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    sym, at = S._symbols(pa.array(words), 8)
    codes = S.reduced_hashes(sym, at)
    text = ["".join(map(str, sym[at[i]:at[i + 1]])) for i in range(len(words))]
    word, h = S.neighbours(sym, at, 8)
    made = set(zip(codes[word].tolist(), h.tolist()))
    for i, a in enumerate(text):
        for j, b in enumerate(text):
            if near(a, b):
                assert (int(codes[i]), int(codes[j])) in made or (int(codes[j]), int(codes[i])) in made
    assert len(np.unique(codes)) == len(set(text))


def test_empty(spark, empty):
    words = S.word_counts(empty, thin=31)
    assert words.count() == 0
    out = S.spelling_groups(words)
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
