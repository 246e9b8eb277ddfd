"""Spark schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LABEL, SOURCE, REGISTER = "text", "label", "source", "language_register"
CORPUS_COLUMNS = (TEXT, LABEL, SOURCE, REGISTER)

CORPUS = T.StructType(
    [
        T.StructField(TEXT, T.StringType()),
        T.StructField(LABEL, T.LongType()),
        T.StructField(SOURCE, T.StringType()),
        T.StructField(REGISTER, T.StringType()),
    ]
)

CURATION_COLUMNS = ("text", "label", "register", "rationale")
CURATION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.LongType()),
        T.StructField("register", T.StringType()),
        T.StructField("rationale", T.StringType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ]
)

PER_CLASS = T.StructType(
    [
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("support", T.LongType()),
    ]
)

TOKEN_WEIGHT = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("weight", T.DoubleType())]
)

# Label domain and register domains, as in the reference.
VALID_LABELS = (0, 1)
CURATION_REGISTERS = ("en-IN", "hi-en")
CORPUS_REGISTERS = ("en", "en-IN", "hi-en")
LABEL_NAMES = ("NOT_SARCASTIC", "SARCASTIC")
