"""Corpus sources and sinks.

Paths are checked through the Hadoop file system of the session, so the same
code works for local paths and shared cluster storage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.normalize import empty_corpus, normalize
from glossa.operators.validate import check_columns, check_domain, row_violation
from glossa.schemas import CURATION, CURATION_COLUMNS
from glossa.session import materialized

FILE_ROWS = 100_000


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_corpus(spark: SparkSession, path: str, source: str, register: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parquet corpus -> normalised corpus; missing path raises."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no corpus table at {path}")
    return normalize(spark.read.parquet(path), source=source, register=register, keep=keep)


def _read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


def read_curated_lenient(
    spark: SparkSession, path: str, source: str = "curated", register: str = "en-IN",
    register_col: str | None = None,
) -> DataFrame:
    """S3: curated CSV as a corpus; a missing file gives an empty typed frame.

    Every row is tagged ``register`` unless ``register_col`` names the CSV's
    own register column."""
    if not path_exists(spark, path):
        return empty_corpus(spark)
    df = _read_csv(spark, path)
    if register_col:
        return normalize(df, source=source, register_col=register_col)
    return normalize(df, source=source, register=register)


def read_curated_strict(spark: SparkSession, path: str) -> DataFrame:
    """Curated CSV with schema and domain validation; missing file raises."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no curated table at {path}")
    raw = _read_csv(spark, path)
    check_columns(raw, CURATION_COLUMNS, path)
    df = raw.select(F.col("text"), F.col("label").cast("bigint").alias("label"), "register", "rationale")
    check_domain(df, source=path)
    return df


def append_labels(df: DataFrame, path: str) -> int:
    """Append validated curation rows to a CSV folder (header per file).

    The batch is computed once, validated as a whole and appended as validated; any
    violation raises and nothing is written.  Returns the number of rows appended.  Files hold at most
    ``FILE_ROWS`` rows: texts may hold line breaks, so one task reads a file."""
    check_columns(df, CURATION_COLUMNS)
    out = materialized(df.select(*[F.col(f.name).cast(f.dataType) for f in CURATION.fields]), "append")
    checked = out.agg(F.count(F.lit(1)).alias("n"), F.count(row_violation()).alias("bad")).head()
    if checked["bad"]:
        raise ValueError(f"{checked['bad']} of {checked['n']} rows break the curation rules; nothing was appended")
    (out.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", FILE_ROWS).csv(path))
    return checked["n"]


def first_usable(
    spark: SparkSession, candidates: Sequence[str], required: Sequence[str] = ("tweet", "sarcastic"),
    fmts: Sequence[str] = ("csv", "json"),
) -> tuple[DataFrame, str]:
    """First candidate that reads to its end, in the first format in which it does, with the
    required columns; NULL text dropped, renamed and cast to (text, label).

    The rows are written once, so a broken body shows here and not later.  Returns
    (frame, path)."""
    text, label = required
    tried = []
    for p in candidates:
        for fmt in fmts:
            try:
                df = _read_csv(spark, p) if fmt == "csv" else spark.read.format(fmt).load(p)
                if not set(required) <= set(df.columns):
                    raise ValueError(f"columns {df.columns}")
                rows = df.na.drop(subset=[text]).select(
                    F.col(text).cast("string").alias("text"), F.col(label).cast("bigint").alias("label"))
                return materialized(rows, "usable"), p
            except (PySparkException, ValueError) as e:
                tried.append(f"{p} as {fmt}: {str(e)[:80]}")
    raise RuntimeError("no usable corpus: " + "; ".join(tried))


def materialize(df: DataFrame, path: str, force: bool = False) -> str:
    """Write a table to parquet; skip if present unless ``force``."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return path


def read_predictions(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Per-model prediction parquet; every path must exist."""
    out = {}
    for name, p in paths.items():
        if not path_exists(spark, p):
            raise FileNotFoundError(f"no predictions of {name} at {p}")
        out[name] = spark.read.parquet(p)
    return out
