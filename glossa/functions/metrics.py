"""Metric arithmetic on confusion counts (Column expressions).

Macro-F1 follows the reference's library default: the mean runs over the
classes present in ``y_true`` or ``y_pred`` (a one-class slice predicted
perfectly scores 1.0, not 0.5); zero division gives 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_neg(tn, fp, fn) -> Column:
    tn, fp, fn = _c(tn), _c(fp), _c(fn)
    return safe_ratio(2 * tn, 2 * tn + fp + fn)


def f1_pos(tp, fp, fn) -> Column:
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def macro_f1(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    tn, fp, fn, tp = _c(tn), _c(fp), _c(fn), _c(tp)
    k0 = (2 * tn + fp + fn > 0).cast("int")
    k1 = (2 * tp + fp + fn > 0).cast("int")
    return safe_ratio(f1_neg(tn, fp, fn) * k0 + f1_pos(tp, fp, fn) * k1, k0 + k1)


def accuracy(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    tn, fp, fn, tp = _c(tn), _c(fp), _c(fn), _c(tp)
    return safe_ratio(tn + tp, tn + fp + fn + tp)


def confusion_aggs(y: Column | str, p: Column | str, prefix: str = "") -> list[Column]:
    """Four conditional counts for one model — combinable in one aggregation."""
    y, p = _c(y), _c(p)
    return [
        F.count_if((y == 0) & (p == 0)).alias(f"{prefix}tn"),
        F.count_if((y == 0) & (p == 1)).alias(f"{prefix}fp"),
        F.count_if((y == 1) & (p == 0)).alias(f"{prefix}fn"),
        F.count_if((y == 1) & (p == 1)).alias(f"{prefix}tp"),
    ]
