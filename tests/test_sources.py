"""Readers and writers (S1-S11) on files that the tests write."""
import pytest

from glossa.operators import models as MO
from glossa.session import checkpoint_root, materialized, scratch_path
from glossa.sources import corpus as S

ROWS = [("yes, really", 1, "en-IN", "tone"), ("plain fact", 0, "hi-en", "literal")]
COLS = "text string, label bigint, register string, rationale string"


def test_parquet_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        S.read_corpus(spark, path, "src", "en")
    df = spark.createDataFrame([("a", 1), ("b", 0)], "tweet string, sarcastic int")
    S.materialize(df, path)
    S.materialize(df.limit(1), path)  # present: skipped
    out = S.read_corpus(spark, path, "src", "en")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, "src", "en"), ("b", 0, "src", "en")]
    S.materialize(df.limit(1), path, force=True)
    assert S.read_corpus(spark, path, "src", "en").count() == 1


def test_append_validates_once_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert S.append_labels(spark.createDataFrame(ROWS, COLS), path) == 2
    with pytest.raises(ValueError, match="1 of 2"):
        S.append_labels(spark.createDataFrame([("x", 1, "en-IN", "ok"), ("y", 2, "en-IN", "ok")], COLS), path)
    assert S.append_labels(spark.createDataFrame([('quote " and, comma', 1, "en-IN", "r")], COLS), path) == 1
    strict = S.read_curated_strict(spark, path)
    assert sorted(r["text"] for r in strict.collect()) == ["plain fact", 'quote " and, comma', "yes, really"]
    lenient = S.read_curated_lenient(spark, path, register_col="register")
    assert {r["language_register"] for r in lenient.collect()} == {"en-IN", "hi-en"}
    assert S.read_curated_lenient(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_curated_strict(spark, str(tmp_path / "none"))


def test_strict_reader_names_every_problem(spark, tmp_path):
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("t", 2, "fr", "r"), ("t", 1, "xx", "r")], COLS).write.option("header", True).csv(bad)
    with pytest.raises(ValueError, match=r"label holds 1 value\(s\).*: 2; register holds 2 value\(s\).*: fr, xx"):
        S.read_curated_strict(spark, bad)
    extra = str(tmp_path / "extra")
    spark.createDataFrame([("t", 1, "z")], "text string, label int, more string").write.option("header", True).csv(extra)
    with pytest.raises(ValueError, match="columns absent: register, rationale; columns not in the schema: more"):
        S.read_curated_strict(spark, extra)


def test_first_usable_falls_back(spark, tmp_path):
    other, broken, good, late = (str(tmp_path / n) for n in ("other", "broken", "good", "late"))
    spark.createDataFrame([("a",)], "unrelated string").write.option("header", True).csv(other)
    spark.createDataFrame([("a", "not a number")], "tweet string, sarcastic string").write.option("header", True).csv(broken)
    spark.createDataFrame([("a", 1), (None, 0)], "tweet string, sarcastic int").write.json(good)
    spark.createDataFrame([("z", 1)], "tweet string, sarcastic int").write.option("header", True).csv(late)
    df, path = S.first_usable(spark, [str(tmp_path / "missing"), other, broken, good, late])
    assert path == good and [tuple(r) for r in df.collect()] == [("a", 1)]
    with pytest.raises(RuntimeError, match="no usable corpus"):
        S.first_usable(spark, [other, broken])


def test_predictions_must_exist(spark, tmp_path):
    spark.createDataFrame([("t", 1)], "text string, pred_a int").write.parquet(str(tmp_path / "a"))
    assert S.read_predictions(spark, {"a": str(tmp_path / "a")})["a"].count() == 1
    with pytest.raises(FileNotFoundError, match="of b at"):
        S.read_predictions(spark, {"b": str(tmp_path / "b")})


def test_models_save_load_and_preference(spark, tiny, tmp_path):
    model, _ = MO.labelled_log_count_ratio_model(tiny, max_features=None)
    model.intercept = float(model.intercept.first()["intercept"])
    one, none, corrupt = (str(tmp_path / n) for n in ("one", "none", "corrupt"))
    model.save(one)
    loaded = MO.load_first_available(spark, [none, one])
    before = {r["doc_id"]: r["probability"] for r in MO.score(tiny, model).collect()}
    assert {r["doc_id"]: r["probability"] for r in MO.score(tiny, loaded).collect()} == pytest.approx(before)
    assert MO.load_first_available(spark, [none]) is None
    spark.range(1).write.parquet(f"{corrupt}/meta")
    with pytest.raises(Exception):  # noqa: B017 - whichever the reader raises: it must not be passed over
        MO.load_first_available(spark, [corrupt, one])


def test_checkpoint_root(spark, monkeypatch):
    root = checkpoint_root(spark)
    assert scratch_path(spark, "x").startswith(root.rstrip("/"))
    assert materialized(spark.range(3), "ids").count() == 3

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="driver and all executors share"):
        checkpoint_root(Session())
    Context.getCheckpointDir = lambda self: "/shared/ckpt"
    assert checkpoint_root(Session()) == "/shared/ckpt"


def test_appended_files_are_bounded(spark, tmp_path, monkeypatch):
    """Rows with line breaks come back whole from several small files."""
    monkeypatch.setattr(S, "FILE_ROWS", 4)
    path = str(tmp_path / "curated")
    rows = [(f"line {i}\nnext, \"quoted\"", i % 2, "en-IN", "why") for i in range(11)]
    assert S.append_labels(spark.createDataFrame(rows, COLS).coalesce(1), path) == 11
    assert len(spark.read.text(path).select("_metadata.file_path").distinct().collect()) == 3
    assert sorted(tuple(r) for r in S.read_curated_strict(spark, path).collect()) == sorted(rows)
