"""Evaluation (A10–A17, A19): everything derives from one confusion-count
aggregation, so each report is a single pass over the scored table, and
per-slice / per-model variants are the same aggregation with a grouping key
or more conditional counts (no loop of passes per model or per slice).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import metrics as M


def confusion(df: DataFrame, y: str = "label", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """A10: ``[[TN, FP], [FN, TP]]`` counts (label order fixed 0, 1)."""
    return df.groupBy(*by).agg(*M.confusion_aggs(y, p))


def confusion_matrix(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """A10 nested: one row with ``confusion array<array<bigint>>``."""
    c = confusion(df, y, p)
    return c.select(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion"))


def per_class(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """Rows ``class, precision, recall, f1, support`` for both classes."""
    c = confusion(df, y, p)
    neg = F.struct(
        F.lit(0).cast("bigint").alias("class"),
        M.safe_ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("precision"),
        M.safe_ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("recall"),
        M.f1_neg("tn", "fp", "fn").alias("f1"),
        (F.col("tn") + F.col("fp")).alias("support"),
    )
    pos = F.struct(
        F.lit(1).cast("bigint").alias("class"),
        M.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        M.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        M.f1_pos("tp", "fp", "fn").alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )
    return c.select(F.explode(F.array(neg, pos)).alias("r")).select("r.*")


def report(df: DataFrame, y: str = "label", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro-F1, per-class structs and the confusion matrix."""
    c = confusion(df, y, p, by)

    def cls(tp, fp, fn, f1):
        return F.struct(
            M.safe_ratio(F.col(tp), F.col(tp) + F.col(fp)).alias("precision"),
            M.safe_ratio(F.col(tp), F.col(tp) + F.col(fn)).alias("recall"),
            f1.alias("f1"),
            (F.col(tp) + F.col(fn)).alias("support"),
        )

    return c.select(
        *by,
        M.accuracy().alias("accuracy"),
        M.macro_f1().alias("macro_f1"),
        cls("tn", "fn", "fp", M.f1_neg("tn", "fp", "fn")).alias("negative"),
        cls("tp", "fp", "fn", M.f1_pos("tp", "fp", "fn")).alias("positive"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion"),
    )


def report_json(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """A14 JSON form (``to_json`` of the nested report)."""
    return report(df, y, p).select(F.to_json(F.struct("*")).alias("report"))


def per_slice_f1(df: DataFrame, y: str = "label", p: str = "pred", slice_col: str = "language_register") -> DataFrame:
    """``register, n, macro_f1`` per slice (NULL slices skipped), ascending."""
    c = df.where(F.col(slice_col).isNotNull()).groupBy(slice_col).agg(
        F.count(F.lit(1)).alias("n"), *M.confusion_aggs(y, p)
    )
    return c.select(F.col(slice_col).alias("register"), "n", M.macro_f1().alias("macro_f1")).orderBy("register")


def compare_slices(
    df: DataFrame, preds: Mapping[str, str], y: str = "label", slice_col: str = "language_register"
) -> DataFrame:
    """One row per slice, one macro-F1 column per model (single aggregation)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, col in preds.items():
        aggs += M.confusion_aggs(y, col, prefix=f"{name}__")
    c = df.where(F.col(slice_col).isNotNull()).groupBy(slice_col).agg(*aggs)
    return c.select(
        F.col(slice_col).alias("register"),
        "n",
        *[
            M.macro_f1(f"{m}__tn", f"{m}__fp", f"{m}__fn", f"{m}__tp").alias(m)
            for m in preds
        ],
    ).orderBy("register")


def to_long(df: DataFrame, preds: Mapping[str, str], keep: Sequence[str] = ("label",)) -> DataFrame:
    """Wide ``pred_<m>`` columns -> long ``(keep..., model, pred)`` rows."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in preds.items()])
    return df.select(*keep, F.explode(arr).alias("mp")).select(*keep, "mp.model", "mp.pred")


def leaderboard(df: DataFrame, preds: Mapping[str, str], y: str = "label") -> DataFrame:
    """``model, accuracy, macro_f1, f1_positive, f1_negative``."""
    long = to_long(df, preds, keep=(y,))
    c = long.groupBy("model").agg(*M.confusion_aggs(y, "pred"))
    return c.select(
        "model",
        M.accuracy().alias("accuracy"),
        M.macro_f1().alias("macro_f1"),
        M.f1_pos("tp", "fp", "fn").alias("f1_positive"),
        M.f1_neg("tn", "fp", "fn").alias("f1_negative"),
    )


def eval_set_table(
    df: DataFrame, preds: Mapping[str, str], y: str = "label", set_col: str = "eval_set",
    sets: Sequence[str] = ("test", "probe"),
) -> DataFrame:
    """Models x eval sets macro-F1, pivoted to ``<set>_macro_f1`` columns."""
    long = to_long(df, preds, keep=(y, set_col))
    c = long.groupBy("model", set_col).agg(*M.confusion_aggs(y, "pred"))
    scored = c.select("model", set_col, M.macro_f1().alias("f1"))
    piv = scored.groupBy("model").pivot(set_col, list(sets)).agg(F.first("f1"))
    return piv.select("model", *[F.col(s).alias(f"{s}_macro_f1") for s in sets])
