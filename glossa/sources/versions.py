"""Versioned folders with a log that is written last.

A save writes a fresh folder below ``<path>/versions`` and then appends one row to the table
``<path>/log``.  Readers follow the log, so a save that dies half-way leaves what was saved
before, whole.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from glossa.sources.corpus import path_exists

LOG = "seq long, folder string, note string"


def new_folder(path: str) -> str:
    return f"{path}/versions/{uuid.uuid4().hex[:12]}"


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The rows of the log in order, each with its folder's path and its note (one per save)."""
    if not path_exists(spark, f"{path}/log"):
        return []
    rows = spark.read.schema(LOG).parquet(f"{path}/log").orderBy("seq").collect()
    return [{"seq": r["seq"], "folder": f"{path}/versions/{r['folder']}", "note": json.loads(r["note"])} for r in rows]


def publish(spark: SparkSession, path: str, folder: str, note: dict | None = None) -> None:
    """Make ``folder`` the current version.  The row becomes visible as a whole."""
    seq = max((e["seq"] for e in entries(spark, path)), default=0) + 1
    row: DataFrame = spark.createDataFrame([(seq, folder.rsplit("/", 1)[1], json.dumps(note or {}))], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the latest version, or None."""
    known = entries(spark, path)
    return known[-1]["folder"] if known else None
