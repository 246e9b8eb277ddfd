"""Schema normalisation, filters, derived columns and first-wins merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from glossa.schemas import CORPUS, CORPUS_COLUMNS, LABEL, REGISTER, SOURCE, TEXT

# Accepted upstream column names, in priority order.
TEXT_ALIASES = ("text", "tweet", "content", "sentence")
LABEL_ALIASES = ("label", "sarcastic", "is_sarcastic", "target")


class UnresolvedColumn(KeyError):
    """A table has none of the names under which a column is known."""


def resolve(df: DataFrame, role: str, names: Sequence[str]) -> Column:
    """The column that plays ``role``, by the first of its known names that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    raise UnresolvedColumn(f"no {role} column among {', '.join(df.columns)} (known as {', '.join(names)})")


def normalize(
    df: DataFrame,
    *,
    source: str | None = None,
    register: str | None = None,
    source_col: str | None = None,
    register_col: str | None = None,
    keep: Sequence[str] = (),
    null_labels: str = "fail",
) -> DataFrame:
    """Resolve text/label aliases, cast, tag source/register.

    Output columns: ``keep`` (e.g. a row key) followed by
    ``text, label, source, language_register``.  The tag is a literal
    (``source=``/``register=``) or taken from a column (``*_col=``).  A NULL label
    fails the job that meets it, unless ``null_labels="keep"``.
    """
    def tag(lit_value: str | None, col_name: str | None, what: str) -> Column:
        if col_name is not None:
            return F.col(col_name).cast("string")
        if lit_value is None:
            raise ValueError(f"give either {what}= or {what}_col=")
        return F.lit(lit_value)

    text, label = resolve(df, "text", TEXT_ALIASES), resolve(df, "label", LABEL_ALIASES)
    if null_labels == "fail":
        label = F.when(label.isNull(), F.raise_error(F.lit("a label is NULL"))).otherwise(label)
    return df.select(
        *[F.col(k) for k in keep],
        text.cast("string").alias(TEXT),
        label.cast("bigint").alias(LABEL),
        tag(source, source_col, "source").alias(SOURCE),
        tag(register, register_col, "register").alias(REGISTER),
    )


def empty_corpus(spark: SparkSession) -> DataFrame:
    """Empty frame with the corpus schema."""
    return spark.createDataFrame([], CORPUS)


def drop_null_text(df: DataFrame, column: str = TEXT) -> DataFrame:
    """N3."""
    return df.na.drop(subset=[column])


def merge_corpora(
    frames: Sequence[tuple[DataFrame, Sequence[str]]],
    *,
    deduplicate: bool = True,
    spark: SparkSession | None = None,
) -> DataFrame:
    """M1: UNION ALL of normalised frames with optional first-wins dedup on text.

    ``frames`` is a list of ``(frame, order_columns)``; the frame position and the
    order columns (any number, any ordered type; compared one after the other) define
    "first", as Spark rows have no order of their own.  Rows are grouped by 192 bits of
    digests of the text, so the (sort-based) aggregation compares short keys, not texts.
    Partial aggregation leaves one row per task of a text that fills a third of all rows.

    Output: ``text, label, source, language_register, frame_ord, row_key, row_sub``
    (row_key/row_sub = the first two order columns as bigint where they are numbers, else 0).
    """
    if not frames:
        if spark is None:
            raise ValueError("spark is required for an empty merge")
        return empty_corpus(spark).withColumns({
            "frame_ord": F.lit(1), "row_key": F.lit(0).cast("bigint"), "row_sub": F.lit(0).cast("bigint")})

    # Every frame compares by its own typed columns: rows of other frames hold NULL there, and the
    # position of the frame has decided before.
    slots = [(i, j, name, df.schema[name].dataType) for i, (df, order) in enumerate(frames) for j, name in enumerate(order)]
    merged = None
    for i, (df, order) in enumerate(frames):
        keys = [*order, *[None] * max(0, 2 - len(order))]
        part = df.select(
            *[F.col(c) for c in CORPUS_COLUMNS],
            F.lit(i + 1).cast("int").alias("frame_ord"),
            *[_as_long(df, k).alias(name) for k, name in zip(keys, ("row_key", "row_sub"))],
            *[(F.col(name) if own == i else F.lit(None).cast(kind)).alias(f"_o{own}_{j}") for own, j, name, kind in slots],
        )
        merged = part if merged is None else merged.unionByName(part)
    order = ["frame_ord", *[c for c in merged.columns if c.startswith("_o")]]
    if not deduplicate:
        return merged.drop(*order[1:])
    rest = [c for c in merged.columns if c not in (TEXT, *order[1:])]
    rows = merged.withColumn("_d", F.xxhash64(TEXT))
    payload = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in rest])
    best = rows.groupBy("_d", F.md5(TEXT).alias("_m")).agg(F.min(payload).alias("f"), F.any_value(TEXT).alias(TEXT))
    return best.select(TEXT, *[F.col(f"f._v_{c}").alias(c) for c in rest])


def _as_long(df: DataFrame, name: str | None) -> Column:
    """The order column as a bigint, 0 where it is no number, NULL where it does not fit."""
    if name and isinstance(df.schema[name].dataType, NumericType):
        return F.col(name).try_cast("bigint")
    return F.lit(0).cast("bigint")


def with_lengths(df: DataFrame, column: str = TEXT) -> DataFrame:
    """Whitespace-token and character counts."""
    from glossa.functions.text import char_count, whitespace_token_count

    return df.withColumns({"n_tokens": whitespace_token_count(column), "n_chars": char_count(column)})
