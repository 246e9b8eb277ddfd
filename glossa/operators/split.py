"""Exact, seeded, stratified splits.

A row's place in its class is ``md5(seed:key)`` (then key); the first
``quota(class)`` rows are the test set.  Quotas: test total = ceil(share * N),
spread over classes by largest remainder (ties by label).

A NULL label is a class of its own.

No window over a whole class: rows are counted per (class, hash-prefix bucket)
(classes x 65,536 rows, bounded), and cumulative counts locate the one boundary
bucket per class.  A boundary bucket of more than ``RANK_ROWS`` rows is counted
again by the next digits of the hash, until it is small enough (or its rows share
the whole hash); only its rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import materialized

PREFIX_HEX = 4  # 16**4 = 65,536 buckets per class
RANK_ROWS = 4096  # rows of a class that one task ranks, at most (rows of one hash apart)
HASH_HEX = 32


def hash_order(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_quotas(df: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """``label, n, quota`` — exact test rows per class (tiny table)."""
    return quotas_from_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, test_size)


def quotas_from_counts(counts: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """Quotas from per-class counts ``label, n`` (one row per class)."""
    w_all = Window.partitionBy()
    tot = F.sum("n").over(w_all)
    n_test = F.ceil(F.lit(test_size) * tot)
    c = counts.withColumn("cont", F.col("n") * n_test / tot).withColumn("fl", F.floor("cont"))
    c = c.withColumn("need", n_test - F.sum("fl").over(w_all)).withColumn("rem", F.col("cont") - F.col("fl"))
    rk = F.row_number().over(Window.orderBy(F.col("rem").desc(), F.col(label).asc()))
    return c.select(label, "n", (F.col("fl") + (rk <= F.col("need")).cast("bigint")).cast("bigint").alias("quota"))


def _boundaries(hist: DataFrame, quotas: DataFrame, label: str) -> DataFrame:
    """(label, prefix, rows, need): per class the bucket where its quota is filled, the bucket's
    size and how many of its rows still count."""
    cum = F.sum("_cnt").over(Window.partitionBy(label).orderBy("_b"))
    hist = hist.withColumn("_cum", cum).withColumn("_before", F.col("_cum") - F.col("_cnt"))
    return (hist.withColumnRenamed(label, "_l").join(quotas, F.col("_l").eqNullSafe(F.col(label)))
            .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_cum")))
            .select(label, F.col("_b").alias("prefix"), F.col("_cnt").alias("rows"), (F.col("quota") - F.col("_before")).alias("need")))


def boundary_buckets(
    df: DataFrame, key: str = "doc_id", label: str = "label", test_size: float = 0.2, seed: int = 42, rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """``label, prefix, rows, need``: the prefix of the hash at which each class's test rows end (one
    row per class; classes with quota 0 have none).  Test are the rows below the prefix and the
    first ``need`` of the ``rows`` rows that have it."""
    spark = df.sparkSession
    base = df.select(label, hash_order(key, seed).alias("_h"))
    hist = materialized(base.groupBy(label, F.substring("_h", 1, PREFIX_HEX).alias("_b")).agg(F.count(F.lit(1)).alias("_cnt")),
                        "split-buckets")
    # Class sizes come from the (class, bucket) histogram: no extra pass over the input.
    quotas = quotas_from_counts(hist.groupBy(label).agg(F.sum("_cnt").alias("n")), label, test_size)
    found = _boundaries(hist, quotas.select(label, "quota"), label)
    schema = found.schema
    rows = found.collect()  # one row per class
    length = PREFIX_HEX
    while length < HASH_HEX and any(r["rows"] > rank_rows and len(r["prefix"]) == length for r in rows):
        large = [r for r in rows if r["rows"] > rank_rows and len(r["prefix"]) == length]
        length += PREFIX_HEX
        edge = spark.createDataFrame(large, schema).select(F.col(label).alias("_l"), "prefix", F.col("need").alias("quota"))
        inside = base.join(F.broadcast(edge), base[label].eqNullSafe(edge["_l"]) & F.startswith("_h", "prefix"))
        finer = inside.groupBy(label, F.substring("_h", 1, length).alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
        quota = edge.select(F.col("_l").alias(label), "quota")
        rows = [r for r in rows if r not in large] + _boundaries(finer, quota, label).collect()
    return spark.createDataFrame(rows, schema)


def stratified_split(
    df: DataFrame, key: str = "doc_id", label: str = "label", test_size: float = 0.2,
    seed: int = 42, split_col: str = "split", rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Adds ``split`` in {'train', 'test'}."""
    bounds = boundary_buckets(df, key, label, test_size, seed, rank_rows)
    # one row per class; classes with quota 0 have none: everything is train
    edge_of = F.broadcast(bounds.select(F.col(label).alias("_l"), F.col("prefix").alias("_p"), F.col("need").alias("_need")))
    base = df.withColumn("_h", hash_order(key, seed))
    tagged = base.join(edge_of, base[label].eqNullSafe(edge_of["_l"]), "left").drop("_l")
    tagged = tagged.withColumn("_own", F.substr("_h", F.lit(1), F.coalesce(F.length("_p"), F.lit(1))))
    at = F.coalesce(F.col("_own") == F.col("_p"), F.lit(False))
    clear = tagged.where(~at).withColumn(
        split_col, F.when(F.col("_own") < F.col("_p"), F.lit("test")).otherwise(F.lit("train")))
    rn = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    edge = tagged.where(at).withColumn(split_col, F.when(rn <= F.col("_need"), F.lit("test")).otherwise(F.lit("train")))
    return clear.unionByName(edge).drop("_h", "_p", "_need", "_own")


def class_weights(df: DataFrame, label: str = "label", mode: str | dict | None = "balanced") -> DataFrame:
    """``label, n, weight``; balanced = N / (n_classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy()
    if mode == "balanced":
        wt = F.sum("n").over(w_all) / (F.count(F.lit(1)).over(w_all) * F.col("n"))
    elif isinstance(mode, dict):
        wt = F.lit(None).cast("double")
        for k, v in mode.items():
            wt = F.when(F.col(label) == k, F.lit(float(v))).otherwise(wt)
        wt = F.coalesce(wt, F.lit(1.0))
    else:
        wt = F.lit(1.0)
    return counts.select(label, "n", wt.cast("double").alias("weight"))


def with_probe(
    df: DataFrame, is_probe: F.Column, key: str = "doc_id", label: str = "label", text: str = "text",
    test_size: float = 0.2, seed: int = 42,
) -> DataFrame:
    """T1+T2: ``eval_set`` in {'train','test','probe'}; probe rows never train.

    Training rows whose exact text also occurs in the probe set are removed, by an
    anti-join on the text's digest and then the text."""
    probe = df.where(is_probe).withColumn("eval_set", F.lit("probe"))
    split = stratified_split(df.where(~is_probe), key, label, test_size, seed, "eval_set")
    held = probe.select(F.xxhash64(text).alias("_d"), F.col(text).alias("_held")).distinct()
    seen = (F.xxhash64(split[text]) == held["_d"]) & (split[text] == held["_held"]) & (split["eval_set"] == "train")
    return split.join(held, seen, "left_anti").unionByName(probe)
