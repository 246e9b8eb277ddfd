"""N-grams counted in Arrow batches: against plain counting, evaluated once, in bounded slices."""
import html
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.functions import clean as C
from glossa.functions import text as TX
from glossa.operators import explain as X
from glossa.operators import features as FE

TOKENS = [["a", "b", "a", "b", "a"], [], ["a"], ["b", "b", "b", "c"], ["é", "\U0001F600", "é"]]


def plain(tokens, low, high):
    return Counter(" ".join(tokens[i:i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1))


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 2), (1, 4), (3, 3)])
def test_packed_counts_are_the_plain_ones(low, high):
    packed, sizes = TX.count_slice(pa.array(TOKENS, pa.list_(pa.string())), low, high)
    ends = np.cumsum(sizes)
    for tokens, end, size in zip(TOKENS, ends, sizes):
        got = Counter()
        for c in packed[end - size:end].tolist():
            at, n, tf = c >> TX.PLACE_SHIFT, c >> TX.N_SHIFT & 0xFF, c & (1 << TX.N_SHIFT) - 1
            got[" ".join(tokens[at:at + n])] += tf
        assert got == plain(tokens, low, high) and size == len(got)


def test_codes_too_wide_for_one_key():
    row, code = np.array([0, 0, 0, 1, 1]), np.array([5, 3, 5, 3, 3])
    for size in (8, 1 << 62):
        first, counts = TX._distinct_in_rows(row, code, size)
        assert first.tolist() == [1, 0, 3] and counts.tolist() == [1, 2, 2]


@pytest.mark.parametrize("tokens_a_slice", [1, 3, 1 << 18])
def test_terms_do_not_depend_on_slices(spark, tokens_a_slice, monkeypatch):
    monkeypatch.setattr(TX, "SLICE_TOKENS", tokens_a_slice)
    docs = spark.createDataFrame(list(enumerate(TOKENS)) + [(9, None)], "doc_id long, t array<string>")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in FE.doc_terms(docs, tokens_col="t", ngram_range=(1, 3)).collect()}
    assert got == {(i, g): n for i, t in enumerate(TOKENS) for g, n in plain(t, 1, 3).items()}
    kept = FE.doc_terms(docs, tokens_col="t", keep_empty=True).where("term is null")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 9]
    dealt = FE.terms_by_key(docs, tokens_col="t", ngram_range=(1, 3))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in dealt.collect()} == got


def test_texts_are_cleaned_and_counted_once(spark):
    docs = spark.createDataFrame([(1, "see www.x.io &amp; soooooo #ok @me  b_1 b_1")], "doc_id long, text string")
    terms = FE.doc_terms(docs)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(regexp_replace") == 1 and plan.count("ArrowEvalPython [count") == 1
    assert {r["term"]: r["tf"] for r in terms.collect()}["b_1 b_1"] == 1


def test_only_references_go_to_python(spark):
    texts = ["&amp;&lt", "&notit; x &#x1F600;&#128;&bogus; & &&gt;", "no reference", "", None, "&", "a&eacute;" * 50, "&#xD800;|&" + "q" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", C.decode_html("t", "full").alias("d"))
    assert {r["i"]: r["d"] for r in df.collect()} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_decoded(coalesce(CASE WHEN Contains" in plan and "regexp_extract_all" in plan


@pytest.mark.parametrize("flags_a_slice", [1, 200, 1 << 20])
def test_masks_are_packed_in_arrow_batches(spark, flags_a_slice, monkeypatch):
    monkeypatch.setattr(X, "PACKED_FLAGS", flags_a_slice)
    rng = np.random.default_rng(7)
    masks = [rng.random(n) < 0.5 for n in (0, 1, 64, 65, 0, 300)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(masks)], "i long, mask array<boolean>").coalesce(1)
    got = df.select("i", X.packed("mask").alias("m"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in got.collect():
        want = masks[r["i"]]
        assert len(r["m"]) == max(1, -(-len(want) // 64))
        assert np.array_equal(X._unpacked(np.array([r["m"]], np.int64), len(want))[0], want.astype(float))
