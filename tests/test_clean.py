import html

import pytest
from pyspark.sql import functions as F

from glossa.functions import clean as C


def run(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col_fn("t")).collect()]


def test_url_replaced(spark):
    out = run(spark, C.replace_urls, ["see https://t.co/abc now", "WWW.example.com x", "HTTP://A.B/c"])
    assert out == ["see <URL> now", "<URL> x", "<URL>"]


def test_mention_replaced_and_email_quirk(spark):
    out = run(spark, C.replace_mentions, ["hi @bob_1!", "mail me at a@b.com"])
    assert out == ["hi <USER>!", "mail me at a<USER>.com"]


def test_hashtag_hash_stripped_unicode(spark):
    out = run(spark, C.strip_hashtags, ["#sarcasm #नमस्ते #", "a#b"])
    assert out == ["sarcasm नमस्ते #", "ab"]


def test_repeats_three_kept_four_collapsed(spark):
    out = run(spark, C.collapse_repeats, ["sooo", "soooo", "!!!!!!!", "aaaa\n\n\n\n"])
    assert out == ["sooo", "sooo", "!!!", "aaa\n\n\n\n"]


def test_whitespace_python_semantics(spark):
    out = run(spark, C.collapse_whitespace, ["  a \t\n b c d\x0be  ", "​"])
    assert out == ["a b c d e", "​"]


def test_html_basic_and_full(spark):
    vals = ["a &amp; b &lt;3", "&amp;lt;", "&eacute;&#233;&#x41;"]
    basic = run(spark, lambda c: C.decode_html(c, "basic"), vals)
    full = run(spark, lambda c: C.decode_html(c, "full"), vals)
    assert basic[:2] == ["a & b <3", "&lt;"]
    assert full == [html.unescape(v) for v in vals]


def test_full_chain_and_opt_out(spark):
    s = "Wow &amp; sooooo  great @user #blessed https://x.io/y"
    assert run(spark, C.clean_col, [s]) == ["Wow & sooo great <USER> blessed <URL>"]
    kept = run(spark, lambda c: C.clean_col(c, skip=("urls", "repeats")), [s])
    assert kept == ["Wow & sooooo great <USER> blessed https://x.io/y"]


def test_devanagari_and_hinglish_preserved(spark):
    s = "यह बहुत अच्छा है yaar"
    assert run(spark, C.clean_col, [s]) == [s]


def test_null_stays_null_or_none(spark):
    assert run(spark, C.clean_col, [None]) == [None]
    assert run(spark, lambda c: C.clean_col(c, null_as="None"), [None]) == ["None"]


@pytest.mark.parametrize("s,blank", [("", True), ("   \t", True), ("x", False), (None, True)])
def test_is_blank(spark, s, blank):
    assert run(spark, C.is_blank, [s]) == [blank]


def test_matches_python_re_on_nasty_strings(spark):
    import re

    nasty = ["a　　b", "x\x1cy", "tab\t\tend", "\u0085lead", "é́́́",
             "😀😀😀😀😀", "mixed   \r\n  lines"]
    ws = run(spark, C.collapse_whitespace, nasty)
    assert ws == [re.sub(r"\s+", " ", s).strip() for s in nasty]
    rep = run(spark, C.collapse_repeats, nasty)
    assert rep == [re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in nasty]
