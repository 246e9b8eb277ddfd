import os
import random
import sys

import pytest
from llm_helpers import build, prose

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Spark's workers

@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, single words, repeated rows, exact and near copies, shared
    passages, periodic text, a very long text, and non-ASCII words."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 70)
    words = base.split(" ")
    near = words[:]
    near[60] = "changed"
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "two words"),
        (10, base), (11, base), (11, base), (12, " ".join(near)), (13, base.upper()),
        (20, prose(rng, 90) + " " + passage + " " + prose(rng, 40)), (21, passage + "\n" + prose(rng, 80)),
        (22, prose(rng, 10) + " " + passage), (23, passage), (30, "same " * 300), (31, "ab cd " * 200),
        (40, prose(rng, 6000)), (41, "Größe ÇA été naïve — «ok» " * 30), (42, "日本語 テキスト " * 40), (43, "!!! ... ???"),
        (44, "x" * 700), (45, "a<|endoftext|>b <|ENDOFTEXT|> it's 1234 ²½ ΑΣ. ΑΣ"),
    ]
    texts += [(100 + i, prose(rng, rng.randint(1, 200))) for i in range(30)]
    return texts


@pytest.fixture(scope="session")
def edge(spark, edge_texts):
    return build(spark, edge_texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return build(spark, [(1, "x")]).where("doc_id < 0")
