"""What several jobs read is written once: statistics of terms, the corpus of a split, feature rows; and one sort serves two windows."""
import math

import pytest
from pyspark.sql import functions as F

from glossa.operators import features as FE
from glossa.operators import models as MO
from glossa.operators import selection as SE
from glossa.plans import flagship as FL
from glossa.session import scratch_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_into_terms_once_for_a_ratio_model(tiny):
    model, vocab = MO.labelled_log_count_ratio_model(tiny, max_features=5)
    assert "ArrowEvalPython" not in plan_of(model.params) and "ArrowEvalPython" not in plan_of(vocab.drop("idf"))
    terms = FE.doc_terms(tiny)
    want = MO.log_count_ratio_model(terms, tiny, FE.vocabulary(terms, FE.count_docs(tiny), 2, 5))
    rows = lambda m: sorted(map(tuple, m.params.select("term", "idf", "index", "coef").collect()))
    assert rows(model) == rows(want) and len(rows(model)) == 5


def test_contributions_sort_once(spark):
    docs = spark.createDataFrame([(1, "aa bb bb cc"), (2, "cc"), (3, ""), (4, None), (5, "aa dd bb")], "doc_id long, text string")
    params = [("aa", 1.0, 0.5), ("bb", 2.0, -1.0), ("cc", 1.0, 0.5), ("aa bb", 1.5, 0.0)]
    model = MO.LinearTextModel(spark.createDataFrame(params, "term string, idf double, coef double"), 0.0)
    got = MO.term_contributions(FE.terms_by_key(docs), model, "doc_id", 2)
    assert plan_of(MO.term_contributions(FE.terms_by_key(docs), MO.LinearTextModel(F.broadcast(model.params), 0.0), "doc_id", 2)).count("Sort [") == 1
    w = {"aa": 1.0, "bb": 2 * (1 + math.log(2)), "cc": 1.0, "aa bb": 1.5}
    norm = math.sqrt(sum(x * x for x in w.values()))
    rows = {(r["doc_id"], r["rank"]): (r["term"], r["contribution"]) for r in got.collect()}
    assert rows[1, 1] == ("bb", pytest.approx(-w["bb"] / norm)) and rows[1, 2] == ("aa", pytest.approx(0.5 / norm))
    assert rows[2, 1] == ("cc", pytest.approx(0.5)) and set(rows) == {(1, 1), (1, 2), (2, 1), (5, 1), (5, 2)}


@pytest.mark.parametrize("rows", [7, 1000])
def test_ranks_need_no_second_exchange(spark, rows):
    terms = spark.range(300).select(F.concat(F.lit("t"), F.pmod(F.col("id") * 7, F.lit(300)).cast("string")).alias("term")).repartition(5)
    ranked = FE.term_index(terms, rows=rows)
    assert "Exchange" not in plan_of(ranked)
    assert [r["term"] for r in sorted(ranked.collect(), key=lambda r: r["index"])] == sorted(f"t{i}" for i in range(300))


def test_the_corpus_of_a_split_is_written(spark, sf):
    plan = plan_of(FL.prepared_corpus(spark, sf))
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_a_second_run_reads_the_feature_rows_of_the_first(spark, tiny, monkeypatch):
    fs, how = MO.fit_features(tiny), SE.EpochSettings(epochs=3)
    run = SE.fit_epochs(tiny, tiny, scratch_path(spark, "epochs"), how, fs=fs)
    monkeypatch.setattr(SE, "_prepare", None)  # no other feature rows are made
    path = scratch_path(spark, "epochs")
    SE.fit_epochs(tiny, tiny, path, SE.EpochSettings(epochs=1), fs=fs, rows_of=run)
    again = SE.fit_epochs(tiny, tiny, path, how)
    assert again.history == run.history and again.folder == run.folder
    with pytest.raises(ValueError, match="feature space"):
        SE.fit_epochs(tiny, tiny, scratch_path(spark, "epochs"), how, rows_of=run)
