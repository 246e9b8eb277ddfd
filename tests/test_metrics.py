import pytest

from glossa.operators import evaluate as EV
from glossa.operators import split as SP


def frame(spark, pairs, extra=None):
    rows = [(i, y, p, (extra[i] if extra else "en")) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "doc_id bigint, label bigint, pred bigint, language_register string")


def test_all_wrong_is_zero(spark):
    r = EV.report(frame(spark, [(0, 1), (1, 0), (1, 0)])).first()
    assert r["macro_f1"] == 0.0 and r["accuracy"] == 0.0


def test_one_class_slice_perfect_is_one(spark):
    r = EV.report(frame(spark, [(1, 1), (1, 1)])).first()
    assert r["macro_f1"] == 1.0


def test_confusion_layout(spark):
    r = EV.confusion_matrix(frame(spark, [(0, 0), (0, 1), (0, 1), (1, 0), (1, 1), (1, 1), (1, 1)])).first()
    assert r["confusion"] == [[1, 2], [1, 3]]


def test_macro_f1_matches_hand_computation(spark):
    pairs = [(0, 0), (0, 1), (0, 1), (1, 0), (1, 1), (1, 1), (1, 1)]
    r = EV.report(frame(spark, pairs)).first()
    f_neg = 2 * 1 / (2 * 1 + 2 + 1)
    f_pos = 2 * 3 / (2 * 3 + 2 + 1)
    assert r["macro_f1"] == pytest.approx((f_neg + f_pos) / 2)
    assert r["accuracy"] == pytest.approx(4 / 7)


def test_per_slice_f1(spark):
    pairs = [(1, 1), (0, 0), (1, 0), (0, 0)]
    regs = ["en-IN", "en-IN", "hi-en", "hi-en"]
    out = {r["register"]: (r["n"], r["macro_f1"]) for r in EV.per_slice_f1(frame(spark, pairs, regs)).collect()}
    assert out["en-IN"] == (2, 1.0)
    assert out["hi-en"][0] == 2 and out["hi-en"][1] == pytest.approx((2 * 1 / 3 + 0.0) / 2)


def test_leaderboard_two_models(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (1, 1, 1)], "label bigint, pa bigint, pb bigint")
    out = {r["model"]: r for r in EV.leaderboard(df, {"a": "pa", "b": "pb"}).collect()}
    assert out["a"]["accuracy"] == 1.0 and out["a"]["macro_f1"] == 1.0
    assert out["b"]["accuracy"] == pytest.approx(1 / 3)


def test_split_exact_quotas_and_partition_invariance(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, label bigint")
    outs = []
    for n in (1, 7):
        s = SP.stratified_split(df.repartition(n), "doc_id", "label", 0.2, 42)
        outs.append(sorted((r["doc_id"], r["split"]) for r in s.collect()))
    assert outs[0] == outs[1]
    test = [d for d, s in outs[0] if s == "test"]
    assert len(test) == 200
    pos = sum(1 for d in test if d % 3 == 0)
    assert pos in (66, 67)  # 334 positives * 0.2 = 66.8, largest remainder


def test_split_seed_changes_assignment(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, label bigint")
    a = {r["doc_id"] for r in SP.stratified_split(df, seed=1).where("split = 'test'").collect()}
    b = {r["doc_id"] for r in SP.stratified_split(df, seed=2).where("split = 'test'").collect()}
    assert len(a) == len(b) == 40 and a != b


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label bigint")
    w = {r["label"]: r["weight"] for r in SP.class_weights(df).collect()}
    assert w[0] == pytest.approx(40 / (2 * 30)) and w[1] == pytest.approx(40 / (2 * 10))
