"""Error analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import whitespace_token_count

# Token-length bins of the error analysis, (lo, hi] with labels.
LENGTH_BINS = (
    (0, 5, "1-5"),
    (5, 10, "6-10"),
    (10, 15, "11-15"),
    (15, 20, "16-20"),
    (20, 30, "21-30"),
    (30, 50, "31-50"),
    (50, None, "50+"),
)


def join_predictions(base: DataFrame, others: Sequence[DataFrame], key: str | Sequence[str] = "doc_id") -> DataFrame:
    """Inner equi-join of per-model prediction tables on ``key``.

    Each ``other`` contributes its non-key columns (``pred_<m>``, ``prob_<m>``).
    Joining on a unique row key keeps the join 1:1; joining on the text multiplies
    repeated texts (``join_predictions_on_text``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = base
    for o in others:
        out = out.join(o, keys, "inner")
    return out


#: Output rows that one compact row of a join on texts yields in one task.
EXPAND = 1 << 16


def join_predictions_on_text(base: DataFrame, others: Sequence[DataFrame], text: str = "text") -> DataFrame:
    """J1 on ``text``: rows multiply as in an SQL inner join (NULL texts do not join).

    Texts meet by digest (192 bits).  Equal rows of a side become one row with its number before
    they are shuffled, so a text that fills a third of a table is one row per distinct prediction
    from every task; numbers multiply in the join, and rows come apart only at the end, dealt out
    in runs of ``EXPAND``."""
    def counted(df: DataFrame, n: str, *carried) -> DataFrame:
        values = [c for c in df.columns if c != text]
        marked = df.where(F.col(text).isNotNull()).withColumns({"_d": F.xxhash64(text), "_m": F.md5(text)})
        return marked.groupBy("_d", "_m", *values).agg(F.count(F.lit(1)).alias(n), *carried)

    out = counted(base, "_n", F.any_value(text).alias(text))
    for other in others:
        out = out.join(counted(other, "_k"), ["_d", "_m"]).withColumn("_n", F.col("_n") * F.col("_k")).drop("_k")
    runs = F.sequence(F.lit(0).cast("bigint"), (F.col("_n") - 1).cast("bigint"), F.lit(EXPAND).cast("bigint"))
    dealt = out.withColumn("_from", F.explode(runs)).repartition("_d", "_m", "_from")
    each = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_n") - F.col("_from"), F.lit(EXPAND)).cast("bigint"))
    columns = [text] + [c for df in (base, *others) for c in df.columns if c != text]
    return dealt.withColumn("_each", F.explode(each)).select(*columns)


def confident_mistakes(
    df: DataFrame, pred: str, prob: str, kind: str, k: int = 10, y: str = "label",
    cols: Sequence[str] = ("doc_id", "text", "language_register"), tie: str = "doc_id",
) -> DataFrame:
    """K2: top-k most confident false positives (kind='fp') or negatives ('fn').

    confidence = prob if pred == 1 else 1 - prob; order desc, ties by ``tie``."""
    want = 1 if kind == "fp" else 0
    wrong = df.where((F.col(y) != F.col(pred)) & (F.col(pred) == want))
    conf = F.when(F.col(pred) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    return (
        wrong.select(*cols, conf.alias("confidence"))
        .orderBy(F.col("confidence").desc(), F.col(tie).asc())
        .limit(k)
    )


def length_bin(n_tokens) -> tuple:
    """(ordinal, label) Columns for the (lo, hi] token-length bins; NULL for 0."""
    ordc, lab = None, None
    for i, (lo, hi, name) in enumerate(LENGTH_BINS):
        cond = (n_tokens > lo) if hi is None else ((n_tokens > lo) & (n_tokens <= hi))
        ordc = F.when(cond, F.lit(i + 1)) if ordc is None else ordc.when(cond, F.lit(i + 1))
        lab = F.when(cond, F.lit(name)) if lab is None else lab.when(cond, F.lit(name))
    return ordc, lab


def accuracy_by_length(df: DataFrame, pred: str, y: str = "label", text: str = "text") -> DataFrame:
    """``bin_ord, length_bin, n, accuracy`` for observed bins in order."""
    # The token count is its own column: the CASE branches below reference it
    # many times and must not re-run the regex per branch.
    counted = df.select(whitespace_token_count(text).alias("_n"), F.col(y), F.col(pred))
    o, lab = length_bin(F.col("_n"))
    t = counted.select(o.alias("bin_ord"), lab.alias("length_bin"),
                       (F.col(y) == F.col(pred)).cast("int").alias("correct"))
    # Empty texts (no bin) are dropped after the aggregation, by an aggregate
    # column: a filter on the bin itself would be pushed below the projection
    # and re-run the token regex inside every CASE branch.
    return (
        t.groupBy("bin_ord", "length_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"),
             F.count("bin_ord").alias("_binned"))
        .where(F.col("_binned") > 0)
        .drop("_binned")
        .orderBy("bin_ord")
    )
