"""Operators that must not pass a whole table through one task: results and plans."""
import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import errors as E
from glossa.operators import features as FE
from glossa.operators import models as MO
from glossa.operators import split as SP
from glossa.operators import stats as ST
from glossa.operators import text_batches as TB


@pytest.fixture(scope="module")
def stats(spark):
    rng = random.Random(4)
    rows = [(f"t{i:04d}", rng.randint(1, 9), rng.choice([2, 3, 3, 3, 7, 7, 50, 10_000, 5 * 10 ** 9 + rng.randrange(3)]))
            for i in range(900)]
    return spark.createDataFrame(rows, "term string, df long, tf_total long").repartition(5)


@pytest.mark.parametrize("k", [1, 5, 333, 899, 900])
@pytest.mark.parametrize("buckets", [64, 4096])
def test_most_frequent_terms(stats, k, buckets, monkeypatch):
    monkeypatch.setattr(FE, "CUT_BUCKETS", buckets)
    want = sorted(((r["term"], r["tf_total"]) for r in stats.collect()), key=lambda r: (-r[1], r[0]))[:k]
    cut = FE.frequency_cut(stats, k, buckets=buckets)
    assert (cut is None) == (k >= 900)
    if cut:
        assert cut == (want[-1][1], sum(1 for r in stats.collect() if r["tf_total"] > want[-1][1]))
    assert {(r["term"], r["tf_total"]) for r in FE.most_frequent(stats, k).collect()} == set(want)


@pytest.mark.parametrize("rows", [7, 100_000])
def test_term_index_by_ranges(stats, rows):
    got = FE.term_index(stats, rows=rows).collect()
    assert [r["term"] for r in sorted(got, key=lambda r: r["index"])] == sorted(r["term"] for r in got)
    assert sorted(r["index"] for r in got) == list(range(900))
    assert FE.term_index(stats.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_plan_has_no_single_task(stats):
    n = stats.sparkSession.createDataFrame([(900.0,)], "n_docs double")
    vocab = FE.vocabulary_from_stats(stats, n, 2, 50)
    assert "TakeOrderedAndProject" not in plan_of(vocab) and "SinglePartition" not in plan_of(vocab).replace(
        "BroadcastExchange", "")
    assert vocab.count() == 50


def test_weights_shuffle_texts_only(spark):
    docs = spark.createDataFrame([(i, f"aa bb cc{i % 3} dd") for i in range(60)], "doc_id long, text string")
    vocab = \
        spark.createDataFrame(FE.vocabulary(FE.doc_terms(docs), FE.count_docs(docs), 1, 100).collect())
    own = FE.text_tfidf(docs, F.broadcast(vocab))
    assert plan_of(own).count("Exchange hashpartitioning") == 1
    before = FE.tfidf(FE.doc_terms(docs), vocab)
    key = lambda r: (r["doc_id"], r["term"])
    assert [(key(r), pytest.approx(r["weight"])) for r in sorted(before.collect(), key=key)] == \
        [(key(r), r["weight"]) for r in sorted(own.collect(), key=key)]


def test_vectors_are_built_without_row_functions(spark):
    docs = spark.createDataFrame([(1, "bb aa bb"), (2, ""), (3, None), (4, "zz")], "doc_id long, text string")
    vocab = spark.createDataFrame([("aa", 1.0, 0), ("bb", 2.0, 1), ("cc", 1.0, 2)], "term string, idf double, index int")
    fs = MO.FeatureSpace(F.broadcast(vocab), 3, (1, 1), None, {})
    vec = MO.vectorize(docs, fs)
    assert "BatchEvalPython" not in plan_of(vec) and plan_of(vec).count("Exchange hashpartitioning") == 1
    got = {r["doc_id"]: r["features"] for r in vec.collect()}
    assert got[1].size == 3 and list(got[1].indices) == [0, 1] and got[1].norm(2) == pytest.approx(1)
    assert all(len(got[i].indices) == 0 for i in (2, 3, 4))


@pytest.mark.parametrize("rank_rows", [1, 50, 4096])
def test_split_ranks_small_groups_only(spark, rank_rows, monkeypatch):
    """The boundary is refined until its bucket is small; the split does not depend on it."""
    monkeypatch.setattr(SP, "PREFIX_HEX", 1)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("label"))
    found = SP.boundary_buckets(df, rank_rows=rank_rows).collect()
    assert len(found) == 4 and max(r["rows"] for r in found) <= max(rank_rows, 1)
    got = SP.stratified_split(df, rank_rows=rank_rows)
    want = df.withColumn("h", SP.hash_order("doc_id", 42))
    quota = {r["label"]: r["quota"] for r in SP.class_quotas(df).collect()}
    test = {r["doc_id"] for r in got.where("split = 'test'").collect()}
    for label, q in quota.items():
        rows = want.where(F.col("label").eqNullSafe(F.lit(label))).orderBy("h").limit(q).collect()
        assert {r["doc_id"] for r in rows} <= test
    assert len(test) == sum(quota.values()) and got.count() == 4000


def test_split_of_a_large_table_stays_bounded(spark):
    df = spark.range(10_000_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    found = SP.boundary_buckets(df, rank_rows=16).collect()
    assert {r["label"] for r in found} == {0, 1} and max(r["rows"] for r in found) <= 16


def test_split_with_repeated_keys_and_one_class(spark):
    df = spark.createDataFrame([(1, 0)] * 30 + [(2, 0)] * 10, "doc_id long, label long")
    assert SP.stratified_split(df, rank_rows=2).groupBy("split").count().orderBy("split").collect()[0]["count"] == 8
    assert SP.stratified_split(df.limit(0)).count() == 0


def test_join_on_text_multiplies_like_sql(spark, monkeypatch):
    monkeypatch.setattr(E, "EXPAND", 3)
    a = [("x", i % 2, 0.5) for i in range(8)] + [("y", 1, 0.25), (None, 1, 0.1), ("only a", 0, 0.1)]
    b = [("x", j % 3 == 0) for j in range(5)] + [("y", True), (None, False), ("only b", True)]
    c = [("x", "m"), ("x", "n"), ("y", None)]
    one = spark.createDataFrame(a, "text string, pred_a int, prob_a double")
    two, three = spark.createDataFrame(b, "text string, pred_b boolean"), spark.createDataFrame(c, "text string, pred_c string")
    got = E.join_predictions_on_text(one, [two, three])
    want = one.join(two, "text").join(three, "text")
    assert got.columns == want.columns
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and key
    assert E.join_predictions_on_text(one, [two.limit(0)]).count() == 0


def test_a_hot_text_is_one_row_before_the_shuffle(spark):
    hot = spark.range(0, 3000, 1, 4).select(F.lit("same").alias("text"), F.lit(1).alias("pred_a"))
    joined = E.join_predictions_on_text(hot, [hot.limit(400).withColumnRenamed("pred_a", "pred_b")])
    assert joined.count() == 3000 * 400


@pytest.mark.parametrize("k", [64, 800])
def test_sketched_quantiles_keep_the_stated_error(spark, k):
    rng = random.Random(k)
    df = spark.createDataFrame([("a " * rng.randint(0, 400), i % 2, f"s{i % 5}") for i in range(6000)], "text string, label int, source string")
    found = ST.sketch_quantiles(ST.length_sketches(df, ["label", "source"], k=k), ["label"], (0.0, 0.1, 0.5, 0.99, 1.0), k)
    ranks = ST.quantile_ranks(ST.length_rows(df, ["label"]), found, ["label"]).collect()
    assert len(ranks) == 2 * 2 * 5
    error = 2 * ST.sketch_rank_error(k) + 1 / 3000
    assert all(r["below"] <= r["q"] + error and r["up_to"] >= r["q"] - error for r in ranks)
    assert ST.sketch_rank_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_text_batches_of_any_length(spark):
    texts = [(1, ""), (2, None), (3, "one two"), (4, "ab " * 17), (5, "cd " * 64), (6, "word " * 5000), (7, "é! " * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    weights = [((i * 7) % 13 - 6) / 3 for i in range(64)]
    for longest in (None, 20):
        got = {r["doc_id"]: r for r in TB.score_text_batches(df, TB.mean_weight_factory(weights, -0.3), vocabulary=64,
                                                            max_length=longest).collect()}
        tokens = F.coalesce(FE.doc_tokens(df, "text", None, longest or 128), F.array().cast("array<string>"))
        want = {r["doc_id"]: r["p"] for r in df.select("doc_id", TB.mean_weight_score(tokens, weights, -0.3).alias("p")).collect()}
        assert {d: r["probability"] for d, r in got.items()} == pytest.approx(want, abs=1e-12)
        assert got[6]["n_tokens"] == (longest or 128) and got[1]["n_tokens"] == got[2]["n_tokens"] == 0
