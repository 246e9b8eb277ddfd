"""Language identification and toxicity: held-out accuracy, and defined results at the edges."""
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossa.llm import language_id, toxicity

from llm_helpers import build, by_row

SYLLABLES = {"en": ["the", "ing", "wh", "ou", "ed"], "de": ["sch", "ein", "ung", "ü", "er"], "es": ["ción", "os", "que", "ñ", "ar"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = [(i, invented(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randint(3, 60)), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(spark):
    rows, docs = corpus(spark)
    train = docs.where(language_id.fold(F.col("doc_id"), 4) != 2)
    model = language_id.fit(train)
    assert model.languages == sorted(SYLLABLES)
    got = by_row(language_id.identify(docs, model))
    assert np.mean([got[i][0]["lang_pred"] == lang for i, _, lang in rows]) > 0.97


def test_backoff_uses_shorter_grams():
    """Unknown words are scored by the longest n-grams that any known word shares with them."""
    rng = random.Random(2)
    data = {lang: [invented(rng, lang, 1) for _ in range(200)] for lang in SYLLABLES}
    pred = {}
    words, s, e, _ = language_id.letter_words([" ".join(v) for v in data.values()])
    langs = sorted(data)
    code = np.repeat([langs.index(k) for k in data], 200)
    chars, at = language_id._edged(words, s, e)
    grams = {}
    for order in language_id.ORDERS:
        h, w = language_id._grams(chars, at, order)
        names, which = np.unique(h, return_inverse=True)
        counts = np.zeros((len(names), 3))
        np.add.at(counts, (which, code[w]), 1)
        place, lang = np.nonzero(counts)
        grams[order] = language_id._table(names, place, lang, counts[place, lang], counts.sum(axis=0), len(names))
    none = (np.zeros(0, np.uint64), np.zeros((0, 3), np.float32))
    model = language_id.Model(langs, none, grams)
    pred, _ = model.predict(["ungungungung", "whingwhing", "quequeción", "zzzzz", "ü"])
    assert pred[:3] == ["de", "en", "es"] and pred[4] == "de" and pred[3] in langs


def plain_words(text):
    low = (text or "").lower()
    return "".join(c if c.isalpha() else " " for c in low).split(" ")


def plain_language(train, texts, least=2):
    """Fit and prediction in plain Python: distinct texts, dictionaries of strings."""
    train = sorted({(lang, text) for text, lang in train if lang is not None and text is not None})
    langs = sorted({lang for lang, text in train if any(plain_words(text))})
    sizes = (0, *language_id.ORDERS)
    names = lambda w, size: [w] if size == 0 else [g for i in range(len(w) + 3 - size) if (g := f"^{w}$"[i:i + size]) not in "^$"]
    count = {size: {} for size in sizes}
    for lang, text in train:
        for w in filter(None, plain_words(text)):
            for size in sizes:
                for g in names(w, size):
                    own = count[size].setdefault(g, dict.fromkeys(langs, 0))
                    own[lang] += 1
    total = {size: {lang: sum(c[lang] for c in count[size].values()) for lang in langs} for size in sizes}

    def logs(size, g):
        c = count[size].get(g)
        if c is None or sum(c.values()) < least:
            return None
        return [math.log((c[lang] + 0.5) / (total[size][lang] + 0.5 * len(count[size]))) for lang in langs]

    out = []
    for text in texts:
        words, sums = [w for w in plain_words(text) if w], [0.0] * len(langs)
        for w in words:
            for size in sizes:
                found = [x for g in names(w, size) if (x := logs(size, g)) is not None]
                if found:
                    sums = [s + sum(col) / len(found) for s, col in zip(sums, zip(*found))]
                    break
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        soft = [math.exp((s - max(sums)) / max(1, len(words) / 20)) for s in sums]
        out.append((langs[sums.index(max(sums))], max(soft) / sum(soft)))
    return out


def test_language_equals_plain_python(spark):
    rows, docs = corpus(spark, 90)
    texts = [(i, t, lang) for i, t, lang in rows] + [(500 + i, rows[0][1], rows[0][2]) for i in range(40)]  # copies count once
    texts += [(600, "123 !", "xx"), (601, None, "en"), (602, "Ünïcode wörds ÇA", None), (603, "the", "de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs)
    assert model.languages == sorted(SYLLABLES)
    asked = texts + [(700, "whinged schein quños zz", None), (701, "x", None)]
    got = by_row(language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model))
    for (i, _, _), (lang, score) in zip(asked, plain_language([(t, lang) for _, t, lang in texts], [t for _, t, _ in asked])):
        assert got[i][0]["lang_pred"] == lang and abs(got[i][0]["score"] - score) < 1e-4


def test_language_edges(spark, edge, edge_texts, empty):
    model = language_id.fit(edge)
    got = by_row(language_id.identify(edge, model))
    assert sum(map(len, got.values())) == len(edge_texts)
    for d in (1, 2, 3, 43):
        assert got[d][0]["lang_pred"] == "und" and got[d][0]["score"] == 0.0
    assert got[42][0]["lang_pred"] == "en" and all(0 <= r[0]["score"] <= 1 for r in got.values())
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(edge, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    unlabelled = language_id.fit(edge.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.languages == []


def toxic_corpus(spark, n=1200):
    rng = random.Random(4)
    bad = ["vile", "scumbag", "hateful", "moronic"]
    texts, labels = [], []
    for i in range(n):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w.upper() if rng.random() < 0.3 else w)
        texts.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
        else:
            labels.append((i, None)) if rng.random() < 0.1 else None
    truth = {i: any(b in t.lower() for b in bad) for i, t in texts}
    return texts, truth, build(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    texts, truth, docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs.where(language_id.fold(F.col("doc_id"), 5) != 0), labels)
    got = by_row(toxicity.score(docs, model))
    hits = [got[i][0]["predicted"] == truth[i] for i, _ in texts]
    assert np.mean(hits) > 0.97
    assert all(r[0]["predicted"] == int(r[0]["score"] >= 0.5) for r in got.values())
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r[0]["predicted"]}


def test_toxicity_equals_plain_python(spark):
    """The model's words are those that plain counts find telling, and a score is the bias and the
    weights of a text's distinct words."""
    texts, truth, docs, labels = toxic_corpus(spark)
    train = docs.where(language_id.fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(train, labels)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: set(word.findall((t or "").translate(fold)))
    code = {w: int(toxicity.distinct_words(pa.array([w]))[0][0]) for _, t in texts for w in words(t)}
    inside = {r["doc_id"] for r in train.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    sample = {(t, d in toxic) for d, t in texts if d in inside and t is not None}
    counts = {}
    for t, p in sample:
        for w in words(t):
            c = counts.setdefault(w, [0, 0])
            c[0] += p
            c[1] += 1
    positives = sum(p for _, p in sample)
    found = [{code[w] for w, (a, b) in counts.items() if toxicity.telling(a, b, positives, len(sample), toxicity.MIN_DOCS, *setting)}
             for setting in toxicity.SETTINGS]
    assert set(model.words.tolist()) in found
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    got = by_row(toxicity.score(docs, model))
    for d, t in texts:
        z = model.bias + sum(weight.get(code[w], 0.0) for w in words(t))
        assert abs(got[d][0]["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_setting_is_chosen_on_folds():
    """A word that only copies of one fold share does not help the others: the choice sees that."""
    rng = np.random.default_rng(0)
    rows = [[0] if i % 4 == 0 else [1 + int(rng.integers(5))] for i in range(400)]
    sample = toxicity.Sample(np.array([c for r in rows for c in r]), np.arange(401), np.arange(400) % 4 == 0, 6)
    setting = toxicity.chosen_setting(sample, np.arange(400) % 3, 3, 0.25)
    w, b = sample.fitted(setting, 3, 0.25)
    assert setting in toxicity.SETTINGS and w[0] > 0 and (w[1:] == 0).all()
    assert sample.flagged(w, b)[sample.positive].all()


def test_toxicity_edges(spark, edge, edge_texts, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(edge, none)
    got = toxicity.score(edge, model).collect()
    assert len(got) == len(edge_texts) and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    some = spark.createDataFrame([(10, 1), (10, 0), (11, 1), (None, 1), (20, None)], "doc_id long, toxic int")
    model = toxicity.fit(edge, some)
    assert 0 < model.prior < 1
    assert len(toxicity.score(edge, model).collect()) == len(edge_texts)
    assert toxicity.score(empty, model).count() == 0 and toxicity.without_toxic(empty, model).count() == 0


def test_nonnegative_risk_keeps_the_prior():
    """With pure noise features the mean prediction stays near the class prior."""
    rng = np.random.default_rng(0)
    n, size = 600, 50
    rows = np.arange(0, n * 5 + 1, 5)
    cols = rng.integers(0, size, n * 5)
    positive = np.arange(n) < 100
    w, b = toxicity.train(cols, rows, positive, size, 0.15)
    z = b + np.add.reduceat(w[cols], rows[:-1])
    assert 0.02 < toxicity._sigmoid(z).mean() < 0.5
