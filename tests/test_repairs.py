"""Edge cases of validation, merge, split, statistics, explanation and streaming."""
import pytest
from pyspark.sql import functions as F

from glossa.operators import explain as X
from glossa.operators import models as MO
from glossa.operators import split as SP
from glossa.operators import stats as ST
from glossa.operators import validate as V
from glossa.operators.features import doc_terms, term_index
from glossa.operators.normalize import UnresolvedColumn, merge_corpora, normalize
from glossa.streaming.jobs import read_batches, score_batch


def test_terms_decode_every_entity(spark):
    df = spark.createDataFrame([(1, "caf&eacute; &#8217;tis na&iuml;ve"), (2, "no entity"), (3, None)], "doc_id int, text string")
    got = {r["term"] for r in doc_terms(df, ngram_range=(1, 1)).where("doc_id = 1").collect()}
    assert got == {"café", "tis", "naïve"}


def test_alignment_counts_duplicates(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert tuple(V.check_alignment(left, right, "k").first()) == (1, 1, False)
    assert tuple(V.check_alignment(left, left, "k").first()) == (0, 0, True)
    assert tuple(V.check_alignment(left.limit(0), left.limit(0), "k").first()) == (0, 0, True)
    with pytest.raises(ValueError):
        V.assert_aligned(left, right, "k")


def test_unknown_payload_fields(spark):
    V.check_payload_fields(spark.createDataFrame([(1, "t")], "doc_id int, text string"))
    with pytest.raises(ValueError, match="not in the schema: lang"):
        V.check_payload_fields(spark.createDataFrame([(1, "t", "en")], "doc_id int, text string, lang string"))


def test_every_offending_value_is_named(spark):
    df = spark.range(1500).select((F.col("id") + 10).alias("label"), F.lit("en-IN").alias("register"))
    assert len(V.domain_problems(df).outside[0][1]) == 1500


def test_null_labels_and_unresolved_columns(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "text string, label int")
    with pytest.raises(Exception, match="a label is NULL"):
        normalize(df, source="s", register="r").collect()
    assert normalize(df, source="s", register="r", null_labels="keep").count() == 2
    with pytest.raises(UnresolvedColumn, match="no label column"):
        normalize(df.drop("label"), source="s", register="r")


def test_split_counts_null_labels(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, F.lit(1)).alias("label"))
    got = SP.stratified_split(df).groupBy("split").count().collect()
    assert dict(map(tuple, got)) == {"train": 80, "test": 20}


def test_register_without_text(spark):
    df = spark.createDataFrame([("x", None, 1), ("y", "t", 1)], "language_register string, text string, label int")
    got = {r["language_register"]: r["pct_positive"] for r in ST.register_breakdown(df).collect()}
    assert got == {"x": None, "y": 100.0}


def frame(spark, rows, kind):
    return spark.createDataFrame([(t, 0, "s", "r", *o) for t, *o in rows],
                                 f"text string, label bigint, source string, language_register string, {kind}")


def test_merge_orders_by_any_columns(spark):
    a = frame(spark, [("t", "b", 1, 5.0), ("t", "a", 9, 7.0), ("t", "a", 9, -2.5)], "o1 string, o2 int, o3 double")
    a = a.withColumn("source", F.col("o3").cast("string"))
    assert [r["source"] for r in merge_corpora([(a, ["o1", "o2", "o3"])]).collect()] == ["-2.5"]
    b = frame(spark, [("t", 10), ("t", 9), ("t", -11), ("u", None)], "o1 int").withColumn("source", F.col("o1").cast("string"))
    assert {r["text"]: r["source"] for r in merge_corpora([(b, ["o1"])]).collect()} == {"t": "-11", "u": None}
    assert merge_corpora([], spark=spark).columns == merge_corpora([(b, ["o1"])]).columns


def test_term_index_is_the_order(spark):
    terms = spark.createDataFrame([(w,) for w in "delta alpha echo bravo charlie".split()], "term string").repartition(3)
    assert [r["term"] for r in term_index(terms).orderBy("index").collect()] == sorted("delta alpha echo bravo charlie".split())


@pytest.fixture
def model(spark, tiny):
    m, _ = MO.labelled_log_count_ratio_model(tiny, max_features=None)
    m.intercept = float(m.intercept.first()["intercept"])
    return m


def test_explain_edges(spark, model):
    df = spark.createDataFrame([(1, ""), (2, "sarcasm"), (3, "oh great another monday meeting"), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in X.explain(df, model, num_samples=60).collect()}
    assert got[1]["tokens"] == [] and got[4]["tokens"] == [] and got[3]["text"].startswith("oh great")
    assert [t["token"] for t in got[2]["tokens"]] == ["sarcasm"] and got[2]["tokens"][0]["weight"] > 0


def test_explanation_agrees_with_exact_contributions(spark, model):
    df = spark.createDataFrame([(1, "oh great another monday meeting at ten")], "doc_id int, text string")
    exact = {r["term"]: r["contribution"] for r in
             MO.term_contributions(doc_terms(df, ngram_range=(1, 1)), model, k=50).collect()}
    weights = {t["token"]: t["weight"] for t in X.explain(df, model, num_samples=200).first()["tokens"]}
    strong = sorted(weights, key=lambda t: -abs(weights[t]))[:3]
    assert all(weights[t] * exact[t] > 0 for t in strong)


def test_perturbations_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"a{i} b c d{i}") for i in range(20)], "doc_id int, text string")
    rows = [sorted(map(str, X.perturbations(df.repartition(n), num_samples=8).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_replayed_batch_is_scored_once(spark, model, tmp_path):
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    batch = spark.createDataFrame([(1, "oh great"), (2, ""), (3, "x" * 4001), (4, None)], "doc_id long, text string")
    for epoch in (0, 0, 1):
        score_batch(batch, model, out, bad, epoch=epoch)
    assert read_batches(spark, out, "doc_id long, probability double").count() == 2
    reasons = {(r["doc_id"], r["reason"]) for r in read_batches(spark, bad, "doc_id long, reason string").collect()}
    assert reasons == {(2, "too_short"), (3, "too_long"), (4, "missing")}
    assert read_batches(spark, str(tmp_path / "none"), "doc_id long").count() == 0


def test_merge_orders_by_typed_keys(spark):
    """Doubles that nine decimals do not tell apart, and numbers of thirty digits."""
    small = spark.createDataFrame([("t", 0, "s", "r", 2e-12), ("t", 1, "s", "r", 1e-12), ("u", 0, "s", "r", None), ("u", 1, "s", "r", 0.0)],
                                  "text string, label long, source string, language_register string, o double")
    big = spark.createDataFrame([("v", 0, "s", "r", "9" * 30), ("v", 1, "s", "r", "8" * 30)],
                                "text string, label long, source string, language_register string, o string")
    big = big.withColumn("o", F.col("o").cast("decimal(38,0)"))
    got = {r["text"]: r for r in merge_corpora([(small, ["o"]), (big, ["o"])]).collect()}
    assert (got["t"]["label"], got["u"]["label"], got["v"]["label"]) == (1, 0, 1)
    assert got["v"]["row_key"] is None and got["v"]["frame_ord"] == 2
    dates = small.select("text", "label", "source", "language_register", F.when(F.col("label") == 0, F.lit("2020-02-01"))
                         .otherwise(F.lit("2019-12-31")).cast("date").alias("o"))
    assert {r["text"]: r["label"] for r in merge_corpora([(dates, ["o"])]).collect()} == {"t": 1, "u": 1}


def test_messages_name_a_bounded_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(V, "NAMED", 50)
    df = spark.range(1000).select((F.col("id") + 10).alias("label"), F.lit("en-IN").alias("register"))
    (field, values, n), = V.domain_problems(df).outside
    assert field == "label" and n == 1000 and 5 <= len(values) <= 60 and list(values) == sorted(values)
    with pytest.raises(ValueError, match=r"label holds 1000 value\(s\) outside its domain: .* and \d+ more"):
        V.check_domain(df)


def test_streams_take_any_scorer(spark, tmp_path):
    from glossa.operators.scorers import ConstantScorer

    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    batch = spark.createDataFrame([(1, "fine"), (2, "")], "doc_id long, text string")
    score_batch(batch, ConstantScorer(0.7), out, bad, epoch=0)
    rows = spark.read.parquet(out).collect()
    assert [(r["doc_id"], r["probability"], r["decision"]) for r in rows] == [(1, 0.7, "SARCASTIC")]
    assert spark.read.parquet(bad).count() == 1
