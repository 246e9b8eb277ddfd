import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossa.operators.normalize import empty_corpus, merge_corpora, normalize


def test_aliases_resolved(spark):
    df = spark.createDataFrame([(1, "hello", 1)], "k bigint, tweet string, is_sarcastic int")
    out = normalize(df, source="a", register="en-IN", keep=["k"])
    assert out.columns == ["k", "text", "label", "source", "language_register"]
    assert out.first().asDict() == {"k": 1, "text": "hello", "label": 1, "source": "a",
                                    "language_register": "en-IN"}


def test_missing_text_column_raises(spark):
    df = spark.createDataFrame([(1,)], "label int")
    with pytest.raises(KeyError):
        normalize(df, source="a", register="x")


def test_null_label_check(spark):
    df = spark.createDataFrame([("a", None)], "text string, label int")
    with pytest.raises(PySparkException, match="a label is NULL"):
        normalize(df, source="a", register="x").collect()


def test_first_frame_wins(spark):
    a = normalize(spark.createDataFrame([(1, "dup", 1), (2, "only a", 0)], "k bigint, text string, label int"),
                  source="A", register="en", keep=["k"])
    b = normalize(spark.createDataFrame([(1, "dup", 0), (0, "only b", 1)], "k bigint, text string, label int"),
                  source="B", register="en", keep=["k"])
    out = {r["text"]: r for r in merge_corpora([(a, ["k"]), (b, ["k"])]).collect()}
    assert len(out) == 3
    assert out["dup"]["source"] == "A" and out["dup"]["label"] == 1
    keep_all = merge_corpora([(a, ["k"]), (b, ["k"])], deduplicate=False)
    assert keep_all.count() == 4


def test_first_wins_within_frame_by_order_key(spark):
    a = normalize(spark.createDataFrame([(5, "dup", 1), (3, "dup", 0)], "k bigint, text string, label int"),
                  source="A", register="en", keep=["k"])
    r = merge_corpora([(a, ["k"])]).first()
    assert (r["row_key"], r["label"]) == (3, 0)


def test_merge_partition_invariant(spark):
    rows = [(i, f"t{i % 37}", i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, text string, label int")
    outs = []
    for n in (1, 7):
        n_df = normalize(df.repartition(n), source="A", register="en", keep=["k"])
        outs.append(sorted(merge_corpora([(n_df, ["k"])]).collect()))
    assert outs[0] == outs[1]


def test_empty_typed_frame(spark):
    e = empty_corpus(spark)
    assert e.count() == 0
    assert e.columns == ["text", "label", "source", "language_register"]
