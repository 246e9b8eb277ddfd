"""How the driver tables map onto the corpus model.

text = documents.text, label = labels.quality, language_register =
documents.lang, source = documents.source.  Two prediction stand-ins make the
evaluation queries runnable without training:
  model a: pred_a = n_chars >= 400, prob_a = n_chars / (n_chars + 400)
  model b: pred_b = 1 - toxic,      prob_b = 0.1 if toxic else 0.9
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import read_table

# Fixed values of the synthetic-input queries.
PROBE_SOURCE = "src0"
SYNTH_PREFIX = "see https://x.io/"
# Entities outside the basic table, and what they stand for.
RARE_ENTITIES = ("caf&eacute; &#8217;tis na&iuml;ve &#x1F600; &Uuml;ber &hearts;ily &notit; ",
                 "caf\u00e9 \u2019tis na\u00efve \U0001F600 \u00dcber \u2665ily \u00acit; ")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select(
        "doc_id",
        "text",
        F.col("quality").cast("bigint").alias("label"),
        "source",
        F.col("lang").alias("language_register"),
        F.col("toxic").cast("bigint").alias("toxic"),
        "n_chars",
    )


def with_stand_ins(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "pred_a": (F.col("n_chars") >= 400).cast("bigint"),
            "prob_a": F.col("n_chars") / (F.col("n_chars") + F.lit(400.0)),
            "pred_b": (F.lit(1) - F.col("toxic")).cast("bigint"),
            "prob_b": F.when(F.col("toxic") == 1, F.lit(0.1)).otherwise(F.lit(0.9)),
        }
    )


def synthetic_text(df: DataFrame) -> F.Column:
    """Document text with a URL, a mention, a hashtag and a letter run in front."""
    return F.concat(
        F.lit(SYNTH_PREFIX), F.col("doc_id").cast("string"), F.lit("  @user"), F.col("doc_id").cast("string"),
        F.lit(" #"), F.col("lang"), F.lit(" soooooo "), F.col("text"),
    )


def curation_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Curation-shaped rows from documents (left join labels): registers
    en->en-IN, fr->hi-en, others unchanged (so invalid); rationale blank for
    toxic rows, else the source name."""
    d = documents(spark, sf).select("doc_id", "text", "lang", "source")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id",
        "text",
        F.col("quality").cast("bigint").alias("label"),
        F.when(F.col("lang") == "en", F.lit("en-IN")).when(F.col("lang") == "fr", F.lit("hi-en"))
        .otherwise(F.col("lang")).alias("register"),
        F.when(F.col("toxic") == 1, F.lit(" ")).otherwise(F.col("source")).alias("rationale"),
    )
