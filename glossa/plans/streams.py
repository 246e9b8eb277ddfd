"""Queries on streams with late rows and bounded state (R2).

The documents arrive in four parts, one micro-batch each, through one checkpointed query that is
started again for every part.  Event times follow from the ids: a part is an hour after the one
before, and every tenth row is two hours older than its part.  The delay is half an hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans import data as D
from glossa.session import scratch_path
from glossa.streaming import jobs as J

# Fixed values of the streaming queries; their oracle uses them too.
PARTS, PART_SECONDS, LATE_SECONDS, DELAY_SECONDS = 4, 3600, 7200, 1800


def event_seconds() -> F.Column:
    own = F.pmod("doc_id", F.lit(PARTS)) * PART_SECONDS + F.pmod("doc_id", F.lit(600))
    return own - F.when(F.pmod("doc_id", F.lit(10)) == 7, LATE_SECONDS).otherwise(0) + LATE_SECONDS


def _arrived(spark: SparkSession, sf: str) -> str:
    docs = D.documents(spark, sf).select("doc_id", "text").withColumn("event_time", F.timestamp_seconds(event_seconds()))
    inbox, folder, checkpoint = (scratch_path(spark, n) for n in ("inbox", "arrivals", "ck"))
    for part in range(PARTS):
        docs.where(F.pmod("doc_id", F.lit(PARTS)) == part).write.mode("append").parquet(inbox)
        source = spark.readStream.schema(docs.schema).parquet(inbox)
        J.stream_arrivals(source, folder, checkpoint, "event_time", DELAY_SECONDS).awaitTermination()
    return folder


def stream_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """R2: every document with its micro-batch and whether it was first, a duplicate or late."""
    return J.read_batches(spark, f"{_arrived(spark, sf)}/rows", "doc_id long, status string, batch int")


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """R2: rows, late rows and rows of state after each micro-batch; the state follows the delay, not
    the number of texts seen."""
    marks = J.read_batches(spark, f"{_arrived(spark, sf)}/marks", J.ARRIVAL_MARK + ", batch int")
    return marks.select("batch", "rows", "late_rows", "state_rows", F.unix_timestamp("mark").alias("mark"))


QUERIES = {"stream_arrivals": stream_arrivals, "stream_state": stream_state}
