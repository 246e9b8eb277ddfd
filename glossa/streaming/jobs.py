"""Streaming scoring and streaming first-arrival dedup.

Both run as ordinary Structured Streaming queries with a checkpoint in the
shared checkpoint folder.  A micro-batch that is run again after a failure writes
to the folder of its own batch id again, in place of what it wrote before, so each
row is scored once; tests use a finite file source with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import models as MO
from glossa.operators.scorers import LinearScorer, Scorer
from glossa.operators.validate import payload_reason
from glossa.session import materialized
from glossa.sources.corpus import path_exists


def score_batch(batch: DataFrame, model: MO.LinearTextModel | Scorer, out_path: str, quarantine_path: str,
                key: str = "doc_id", text: str = "text", epoch: int = 0) -> None:
    """R1 micro-batch body: V4 checks, score valid rows with any scorer, quarantine the rest.

    The same code scores a static table.  The source is read once."""
    tagged = materialized(batch.select(key, text, payload_reason(text).alias("reason")), "batch")
    valid = tagged.where(F.col("reason").isNull()).select(key, text)
    bad = tagged.where(F.col("reason").isNotNull()).select(key, "reason")
    scorer = LinearScorer(model) if isinstance(model, MO.LinearTextModel) else model
    scored = MO.with_decision(scorer.score(valid, text, [key]), scorer)
    scored.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
    bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={epoch}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that the batches have written (none: an empty frame)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def stream_score(
    spark: SparkSession, source: DataFrame, model: MO.LinearTextModel | Scorer, out_path: str,
    quarantine_path: str, checkpoint: str, key: str = "doc_id", text: str = "text",
    available_now: bool = True,
):
    """``readStream`` source -> foreachBatch(score_batch) -> parquet sinks."""
    w = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda b, epoch: score_batch(b, model, out_path, quarantine_path, key, text, epoch))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_dedup(
    source: DataFrame, out_path: str, checkpoint: str, event_time: str, delay: str = "1 hour",
    text: str = "text", available_now: bool = True,
):
    """R2: first arrival of each exact text wins, state bounded by the watermark.  The state
    holds two digests of a text (192 bits), not the text.

    A duplicate arriving later than the watermark (event time + delay) is no
    longer recognised and passes through; rows later than the watermark
    itself are dropped by the engine."""
    marked = source.withColumns({"_d": F.xxhash64(text), "_m": F.md5(text)})
    dedup = marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_d", "_m"]).drop("_d", "_m")
    w = dedup.writeStream.format("parquet").option("path", out_path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ----------------------------------------------------------------------------- R2 with late rows

ARRIVAL_STATE = "_d long, _m string, at timestamp"
ARRIVAL_MARK = "mark timestamp, state_rows long, late_rows long, rows long"


def arrivals_batch(batch: DataFrame, folder: str, epoch: int, event_time: str, delay_seconds: int,
                   key: str = "doc_id", text: str = "text") -> None:
    """One micro-batch of ``stream_arrivals``: every row of ``batch`` goes to ``rows/batch=<epoch>``
    with its ``status``.

    ``late``: older than the watermark, the latest event time of all earlier batches less the delay.
    ``first``: the first on-time row of its text (by event time, then key), if no text of the state is
    equal.  ``duplicate``: any other.  The state holds a digest and a time per text, in the shared
    folder; what the new watermark has passed by more than the delay leaves it.  A batch that
    runs again reads the state of the batch before and writes the same again."""
    spark = batch.sparkSession
    before = f"batch={epoch - 1}"
    own = batch.withColumns({"_d": F.xxhash64(text), "_m": F.coalesce(F.md5(text), F.lit("")), "_at": F.col(event_time)})
    own = materialized(own.select(key, "_d", "_m", "_at"), "arrivals")
    seen = spark.createDataFrame([], ARRIVAL_STATE)
    mark = None
    if epoch > 0 and path_exists(spark, f"{folder}/marks/{before}"):
        seen = spark.read.schema(ARRIVAL_STATE).parquet(f"{folder}/state/{before}")
        mark = spark.read.schema(ARRIVAL_MARK).parquet(f"{folder}/marks/{before}").first()["mark"]
    limit = F.lit(mark).cast("timestamp")
    is_late = F.coalesce(F.col("_at") < limit, F.lit(False)) | F.col("_at").isNull()
    delay = F.make_interval(secs=F.lit(delay_seconds))
    firsts = own.where(~is_late).groupBy("_d", "_m").agg(F.min(F.struct(F.col("_at").alias("at"), F.col(key).alias("k"))).alias("f"))
    fresh = materialized(firsts.join(seen, ["_d", "_m"], "left_anti").select("_d", "_m", "f.at", "f.k"), "fresh")
    met = own.join(fresh, ["_d", "_m"], "left")
    is_first = (F.col("_at") == F.col("at")) & F.col(key).eqNullSafe(F.col("k"))
    status = F.when(is_late, "late").when(is_first, "first").otherwise("duplicate")
    met.select(key, status.alias("status")).write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch}")
    newest = own.agg((F.max("_at") - delay).alias("m")).select(F.greatest("m", limit).alias("mark"))
    known = seen.unionByName(fresh.drop("k")).crossJoin(F.broadcast(newest))
    kept = known.where(F.col("mark").isNull() | (F.col("at") + delay >= F.col("mark"))).drop("mark")
    kept.write.mode("overwrite").parquet(f"{folder}/state/batch={epoch}")
    state_rows = spark.read.schema(ARRIVAL_STATE).parquet(f"{folder}/state/batch={epoch}").agg(F.count("*").alias("state_rows"))
    counts = own.agg(F.count_if(is_late).alias("late_rows"), F.count("*").alias("rows"))
    newest.crossJoin(state_rows).crossJoin(counts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={epoch}")


def stream_arrivals(source: DataFrame, folder: str, checkpoint: str, event_time: str, delay_seconds: int = 3600,
                    key: str = "doc_id", text: str = "text", available_now: bool = True):
    """R2 with a side output: ``arrivals_batch`` on every micro-batch.  No row is dropped in silence,
    and the state holds the texts of about one delay."""
    w = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda b, epoch: arrivals_batch(b, folder, epoch, event_time, delay_seconds, key, text))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
