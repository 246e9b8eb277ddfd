"""Corpus statistics.

All grouped statistics are single hash aggregations with map-side partial
aggregation; "totals" are one-row aggregates joined back (a one-row broadcast,
bounded by construction).  Exact percentiles run on integer lengths, whose
aggregation buffer is bounded by the number of distinct lengths, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import char_count, eda_words, whitespace_token_count
from glossa.schemas import LABEL, REGISTER, SOURCE, TEXT
from glossa.operators.validate import validate_dataframe

# Log-odds smoothing prior and histogram bins of the EDA.
LOG_ODDS_ALPHA = 0.5
HIST_BINS = 40


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A1: ``label, n, pct`` (pct of all rows, 2 decimals)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        F.col(label), F.col("n"), F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct")
    )


def crosstab(df: DataFrame, row: str = SOURCE, label: str = LABEL, values=(0, 1)) -> DataFrame:
    """A2: ``row`` x label counts, zero-filled; columns ``label_<v>``."""
    piv = df.groupBy(row).pivot(label, list(values)).agg(F.count(F.lit(1)))
    return piv.select(
        F.col(row), *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(f"label_{v}") for v in values]
    )


def register_breakdown(df: DataFrame, register: str = REGISTER, text: str = TEXT, label: str = LABEL) -> DataFrame:
    """Per register ``n`` (non-null text), ``n_positive``, ``pct_positive``."""
    g = df.groupBy(register).agg(
        F.count(text).alias("n"), F.sum(label).cast("bigint").alias("n_positive")
    )
    return g.withColumn("pct_positive", F.round(F.try_divide(F.col("n_positive") * 100.0, F.col("n")), 2))


def length_rows(df: DataFrame, by: list[str], text: str = TEXT) -> DataFrame:
    """(by..., metric, v): token and char counts in long form."""
    both = F.array(F.struct(F.lit("n_tokens").alias("metric"), whitespace_token_count(text).alias("v")),
                   F.struct(F.lit("n_chars").alias("metric"), char_count(text).alias("v")))
    return df.select(*by, F.explode(both).alias("m")).select(*by, "m.metric", "m.v")


def sketch_rank_error(k: int) -> float:
    """Error of a KLL sketch's ranks, as a share of all rows, that 99 % of estimates keep."""
    return 2.296 / k ** 0.9723


def length_sketches(df: DataFrame, by: list[str], text: str = TEXT, k: int = 800) -> DataFrame:
    """A4 for unbounded domains: (by..., metric, n, sketch), a KLL quantile sketch of a few kB per
    group.  Sketches of parts (days, sources, files) can be stored and merged later."""
    return length_rows(df, by, text).groupBy(*by, "metric").agg(
        F.count("v").alias("n"), F.kll_sketch_agg_bigint("v", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list[str], probabilities=(0.25, 0.5, 0.75), k: int = 800) -> DataFrame:
    """(by..., metric, n, q, value) of the merged sketches of each group."""
    merged = sketches.groupBy(*by, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    each = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("value"))
                     for q in probabilities))
    return merged.where("n > 0").select(*by, "metric", "n", F.explode(each).alias("e")).select(*by, "metric", "n", "e.q", "e.value")


def quantile_ranks(values: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """``quantiles`` with the shares of rows below (``below``) and up to (``up_to``) each value."""
    keys = [*by, "metric"]
    found = values.where("v is not null").join(F.broadcast(quantiles), keys)  # groups x probabilities rows
    return found.groupBy(*keys, "n", "q", "value").agg(
        (F.count_if(F.col("v") < F.col("value")) / F.col("n")).alias("below"),
        (F.count_if(F.col("v") <= F.col("value")) / F.col("n")).alias("up_to"))


def length_describe(df: DataFrame, by: str = LABEL, text: str = TEXT, approx: bool = False) -> DataFrame:
    """A4: grouped describe of token and char counts, long form.

    Columns: by, metric, count, mean, std (sample), min, p25, p50, p75, max.
    ``approx=True`` uses ``percentile_approx`` for unbounded value domains.
    """
    long = length_rows(df, [by], text)
    if approx:
        q = F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).cast("array<double>")
    else:
        q = F.percentile(F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy(by, "metric").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").cast("double").alias("min"),
        q.alias("q"),
        F.max("v").cast("double").alias("max"),
    )
    return g.select(
        by, "metric", "count", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def length_histogram(df: DataFrame, by: str = LABEL, text: str = TEXT, bins: int = HIST_BINS) -> DataFrame:
    """A5: per-class density histogram with shared edges (per-class norm).

    bin = floor(bins*(x-min)/(max-min)) + 1, the maximum falls in the last bin.
    Columns: by, metric, bin, n, bin_start, bin_width, density.
    """
    # one pass over the texts: (class, metric, value, n) is bounded by the distinct lengths
    values = df.select(
        F.col(by),
        F.explode(
            F.array(
                F.struct(F.lit("n_tokens").alias("metric"), whitespace_token_count(text).alias("v")),
                F.struct(F.lit("n_chars").alias("metric"), char_count(text).alias("v")),
            )
        ).alias("m"),
    ).select(by, "m.metric", "m.v").groupBy(by, "metric", "v").agg(F.count(F.lit(1)).alias("n"))
    per_metric, per_class = Window.partitionBy("metric"), Window.partitionBy("metric", by)
    span = (F.col("hi") - F.col("lo"))
    counts = values.select(
        by, "metric", "v", "n", F.min("v").over(per_metric).alias("lo"), F.max("v").over(per_metric).alias("hi"),
        F.sum("n").over(per_class).alias("n_class"),
    ).withColumn(
        "bin",
        F.when(span == 0, F.lit(1)).otherwise(
            F.least(F.floor((F.col("v") - F.col("lo")) * bins / span).cast("bigint") + 1, F.lit(bins))
        ).cast("bigint"),
    ).groupBy(by, "metric", "bin", "lo", "hi", "n_class").agg(F.sum("n").alias("n"))
    width = F.when(span == 0, F.lit(1.0)).otherwise(span / bins)
    return counts.select(
        by, "metric", "bin", "n",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        width.alias("bin_width"),
        (F.col("n") / (F.col("n_class") * width)).alias("density"),
    )


def token_counts(df: DataFrame, text: str = TEXT, label: str = LABEL) -> DataFrame:
    """A6 + M2: per token ``n_pos``, ``n_neg`` (lower-cased ``[A-Za-z']+``).

    One aggregation with conditional counts replaces the outer join of two
    counters; missing = 0 by construction."""
    toks = df.select(F.col(label), F.explode(eda_words(text)).alias("token"))
    return toks.groupBy("token").agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def log_odds(counts: DataFrame, alpha: float = LOG_ODDS_ALPHA) -> DataFrame:
    """Smoothed log-odds per token over the union vocabulary.

    ln(((p+a)/(P+a V)) / ((n+a)/(N+a V))); totals are a one-row aggregate.
    """
    tot = counts.agg(
        F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"), F.count(F.lit(1)).alias("V")
    )
    a = F.lit(alpha)
    return counts.crossJoin(F.broadcast(tot)).select(
        "token", "n_pos", "n_neg",
        F.ln(
            ((F.col("n_pos") + a) / (F.col("P") + a * F.col("V")))
            / ((F.col("n_neg") + a) / (F.col("N") + a * F.col("V")))
        ).alias("log_odds"),
    )


def top_tokens(scores: DataFrame, k: int = 20, ascending: bool = False) -> DataFrame:
    """K1: top-k (or bottom-k) tokens by log-odds, ties by token; adds rank.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: per-partition top-k,
    then a k x partitions merge — bounded by k, not by data."""
    order = F.col("log_odds").asc() if ascending else F.col("log_odds").desc()
    top = scores.orderBy(order, F.col("token").asc()).limit(k)
    w = Window.orderBy(order, F.col("token").asc())
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def curation_summary(df: DataFrame, validate: bool = True) -> DataFrame:
    """One row: total, n_positive, n_negative, pct_positive, by_register
    (map), avg_rationale_length; validates the table first."""
    if validate:
        validate_dataframe(df)
    reg = df.groupBy("register").agg(F.count(F.lit(1)).alias("n"))
    by_reg = reg.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("register", "n")))).alias("by_register")
    )
    main = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.avg(F.length("rationale")).alias("avg_len"),
    )
    return main.crossJoin(by_reg).select(
        "total",
        "n_positive",
        (F.col("total") - F.col("n_positive")).alias("n_negative"),
        F.when(F.col("total") > 0, F.round(F.col("n_positive") * 100.0 / F.col("total"), 2))
        .otherwise(F.lit(0.0)).alias("pct_positive"),
        F.coalesce(F.col("by_register"), F.create_map().cast("map<string,bigint>")).alias("by_register"),
        F.coalesce(F.round(F.col("avg_len"), 1), F.lit(0.0)).alias("avg_rationale_length"),
    )
