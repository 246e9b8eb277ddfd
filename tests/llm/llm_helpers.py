"""Builders shared by the tests of this folder."""
import random

# Extra columns whose names clash with those that the operators use inside.
CLASH = ["k", "s", "r", "n", "body", "base", "spans", "label", "token", "row", "part", "_text", "_k", "c", "first"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    ends = ["", "", "", "", ",", "."]
    return " ".join(f"w{rng.randrange(vocabulary):x}é"[:rng.randint(2, 5)] + rng.choice(ends) for _ in range(n))


def build(spark, texts, lang="en"):
    rows = [(i, t, lang, "src", None if t is None else len(t), *["x"] * len(CLASH)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_row(df, key="doc_id"):
    """Results by key, a list for each (keys repeat)."""
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
