"""Spark side of the query catalogue: one callable ``(spark, sf_dir) -> DataFrame``
per operator of the inventory.  Every query reads whole driver tables.

Doubles are rounded to 6 places in the final projection only (see
``ROUNDED``), so that results compare exactly with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import clean as C
from glossa.operators import errors as E
from glossa.operators import evaluate as EV
from glossa.operators import features as FE
from glossa.operators import models as MO
from glossa.operators import split as SP
from glossa.operators import stats as ST
from glossa.operators import validate as V
from glossa.operators.normalize import drop_null_text, merge_corpora, normalize
from glossa.plans import data as D
from glossa.plans import flagship as FL
from glossa.plans.storage import QUERIES as STORAGE
from glossa.plans.streams import QUERIES as STREAMS
from glossa.plans.training import QUERIES as TRAINING
from glossa.session import materialized, read_table

PREDS = {"model_a": "pred_a", "model_b": "pred_b"}


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ----------------------------------------------------------------------------- N, M

def normalize_corpus(spark: SparkSession, sf: str) -> DataFrame:
    raw = D.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"), "lang")
    return normalize(raw, source="documents", register_col="lang", keep=["doc_id"])


def normalize_aliases(spark: SparkSession, sf: str) -> DataFrame:
    raw = D.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("content"), F.upper("text").alias("sentence"),
        F.col("toxic").alias("is_sarcastic"), F.col("quality").alias("target"))
    return normalize(raw, source="aliases", register="en", keep=["doc_id"])


def _merge_frames(spark: SparkSession, sf: str):
    docs = D.documents(spark, sf)
    lab = read_table(spark, sf, "labels")
    f1 = normalize(docs.join(lab, "doc_id").select("doc_id", "text", F.col("quality").alias("label"), "lang"),
                   source="labelled", register_col="lang", keep=["doc_id"])
    f2 = normalize(docs.select("doc_id", "text", F.lit(0).alias("label"), "lang"),
                   source="documents", register_col="lang", keep=["doc_id"])
    conv = read_table(spark, sf, "conversations")
    f3 = normalize(conv.select("conv_id", "turn", "text", F.lit(0).alias("label")),
                   source="conversations", register="und", keep=["conv_id", "turn"])
    return [(f1, ["doc_id"]), (f2, ["doc_id"]), (f3, ["conv_id", "turn"])]


def merge_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return merge_corpora(_merge_frames(spark, sf), deduplicate=True)


def merge_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    return merge_corpora(_merge_frames(spark, sf), deduplicate=False)


def null_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Drop NULL text (that of one source is nulled here), rename/select, filter
    positives, derive lengths."""
    raw = D.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id")
    text = F.when(F.col("source") != D.PROBE_SOURCE, F.col("text"))
    df = drop_null_text(raw.select("doc_id", text.alias("tweet"), F.col("quality").alias("sarcastic"))
                        .withColumnsRenamed({"tweet": "text", "sarcastic": "label"}))
    pos = df.where(F.col("label") == 1)
    return pos.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                      E.whitespace_token_count("text").alias("n_tokens"))


# ----------------------------------------------------------------------------- C

def _synth(spark, sf):
    d = D.documents(spark, sf)
    return d.select("doc_id", D.synthetic_text(d).alias("text"))


def clean_coerced(spark, sf):
    """Numbers and NULLs become text under both policies."""
    number = F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("n_chars"))
    return D.documents(spark, sf).select("doc_id", C.coerce_text(number).alias("kept"), C.coerce_text(number, "None").alias("cleaned"))


def clean_url(spark, sf):
    return _synth(spark, sf).select("doc_id", C.replace_urls("text").alias("cleaned"))


def clean_mention(spark, sf):
    return _synth(spark, sf).select("doc_id", C.replace_mentions("text").alias("cleaned"))


def clean_hashtag(spark, sf):
    return _synth(spark, sf).select("doc_id", C.strip_hashtags("text").alias("cleaned"))


def clean_repeat(spark, sf):
    return _synth(spark, sf).select("doc_id", C.collapse_repeats("text").alias("cleaned"))


def clean_space(spark, sf):
    return D.documents(spark, sf).select("doc_id", C.collapse_whitespace("text").alias("cleaned"))


def clean_html_basic(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", C.decode_html("html", "basic").alias("cleaned"))


def clean_all(spark, sf):
    return _synth(spark, sf).select("doc_id", C.clean_col("text", html="basic").alias("cleaned"))


def clean_html_full(spark, sf):
    """C1 full entity table: entities outside the basic table are put in front of each page."""
    page = F.concat(F.lit(D.RARE_ENTITIES[0]), F.col("html"))
    return read_table(spark, sf, "pages").select("page_id", C.decode_html(page, "full").alias("cleaned"))


def entity_terms(spark, sf):
    """F1/F2 on texts with rare and numeric entities: terms come from the decoded text."""
    docs = D.documents(spark, sf)
    return FE.doc_terms(docs.select("doc_id", F.concat(F.lit(D.RARE_ENTITIES[0]), "text").alias("text")))


# ----------------------------------------------------------------------------- V

def validate_rows(spark, sf):
    cur = D.curation_frame(spark, sf)
    return cur.select("doc_id", V.row_violation().alias("violation"))


def validate_domain(spark, sf):
    return V.domain_violations(D.curation_frame(spark, sf))


def validate_payload(spark, sf):
    d = D.documents(spark, sf)
    return d.select("doc_id", "n_chars", V.payload_reason("text").alias("reason"))


def alignment_check(spark, sf):
    return V.check_alignment(D.documents(spark, sf), read_table(spark, sf, "labels"), "doc_id")


def alignment_duplicates(spark, sf):
    """V5 on a key that repeats on both sides (language): counts must agree, not only values."""
    docs, lab = D.documents(spark, sf), D.labelled(spark, sf)
    return V.check_alignment(docs.select(F.col("lang").alias("key")), lab.select(F.col("language_register").alias("key")), "key")


# ----------------------------------------------------------------------------- A

def class_balance(spark, sf):
    return ST.class_balance(D.labelled(spark, sf))


def source_label_crosstab(spark, sf):
    return ST.crosstab(D.labelled(spark, sf))


def register_breakdown(spark, sf):
    return ST.register_breakdown(D.labelled(spark, sf))


def curation_summary(spark, sf):
    valid, _ = V.split_valid(D.curation_frame(spark, sf).drop("doc_id"))
    s = ST.curation_summary(valid)
    return s.select("total", "n_positive", "n_negative", "pct_positive",
                    F.to_json("by_register").alias("by_register"), "avg_rationale_length")


def length_describe(spark, sf):
    return _round(ST.length_describe(D.labelled(spark, sf)))


def length_sketch_quantiles(spark, sf):
    """A4 by sketches: one per class and source, merged by class; whether each quantile's true rank
    lies within twice the stated error."""
    lab = D.labelled(spark, sf)
    found = ST.sketch_quantiles(ST.length_sketches(lab, ["label", "source"]), ["label"])
    ranks = ST.quantile_ranks(ST.length_rows(lab, ["label"]), materialized(found, "quantiles"), ["label"])
    spread = F.lit(2 * ST.sketch_rank_error(800)) + 1 / F.col("n")
    return ranks.select("label", "metric", "n", "q", ((F.col("below") <= F.col("q") + spread)
                                                     & (F.col("up_to") >= F.col("q") - spread)).alias("within_error"))


def length_histogram(spark, sf):
    return _round(ST.length_histogram(D.labelled(spark, sf)))


def length_coverage(spark, sf):
    return _round(FE.length_coverage(D.documents(spark, sf)))


def token_counts(spark, sf):
    return ST.token_counts(D.labelled(spark, sf))


def _log_odds(spark, sf):
    return ST.log_odds(ST.token_counts(D.labelled(spark, sf)))


def log_odds_top(spark, sf):
    return _round(ST.top_tokens(_log_odds(spark, sf), 20, ascending=False))


def log_odds_bottom(spark, sf):
    return _round(ST.top_tokens(_log_odds(spark, sf), 20, ascending=True))


# ----------------------------------------------------------------------------- F

def ngram_terms(spark, sf):
    return FE.doc_terms(D.documents(spark, sf), "doc_id", "text", (1, 2))


def _vocab(df):
    terms = FE.doc_terms(df.select("doc_id", "text"), "doc_id", "text", (1, 2))
    return terms, FE.vocabulary(terms, FE.count_docs(df), 2, 50_000)


def vocabulary_idf(spark, sf):
    _, v = _vocab(D.documents(spark, sf))
    return _round(v)


def vocabulary_uncapped(spark, sf):
    """F3 without ``max_features``: every term of two documents or more."""
    docs = D.documents(spark, sf)
    return _round(FE.vocabulary(FE.doc_terms(docs.select("doc_id", "text")), FE.count_docs(docs), 2, None))


def tfidf_weights(spark, sf):
    docs = D.documents(spark, sf)
    v = materialized(_vocab(docs)[1], "vocabulary")
    return _round(FE.text_tfidf(docs, v))


# ----------------------------------------------------------------------------- T

def stratified_split(spark, sf):
    return SP.stratified_split(D.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", 0.2, 42)


def class_weights(spark, sf):
    s = SP.stratified_split(D.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", 0.2, 42)
    return _round(SP.class_weights(s.where(F.col("split") == "train"), "label"))


def _eval_sets(spark, sf):
    lab = D.labelled(spark, sf)
    return SP.with_probe(lab, F.col("source") == D.PROBE_SOURCE, "doc_id", "label", "text", 0.2, 42)


def probe_holdout(spark, sf):
    return _eval_sets(spark, sf).select("doc_id", "label", "eval_set")


# ----------------------------------------------------------------------------- metrics

def _scored(spark, sf):
    return D.with_stand_ins(D.labelled(spark, sf))


def confusion(spark, sf):
    return EV.confusion(_scored(spark, sf), "label", "pred_a")


def per_class_report(spark, sf):
    return _round(EV.per_class(_scored(spark, sf), "label", "pred_a"))


def accuracy(spark, sf):
    from glossa.functions import metrics as M

    c = EV.confusion(_scored(spark, sf), "label", "pred_a")
    return _round(c.select(M.accuracy().alias("accuracy"),
                           (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n")))


def macro_f1(spark, sf):
    from glossa.functions import metrics as M

    c = EV.confusion(_scored(spark, sf), "label", "pred_a")
    return _round(c.select(M.macro_f1().alias("macro_f1")))


def evaluation_report(spark, sf):
    r = EV.report(_scored(spark, sf), "label", "pred_a")
    return _round(r.select(
        "accuracy", "macro_f1",
        *[F.col(f"{c}.{m}").alias(f"{c}_{m}") for c in ("negative", "positive")
          for m in ("precision", "recall", "f1", "support")],
        F.col("confusion")[0][0].alias("tn"), F.col("confusion")[0][1].alias("fp"),
        F.col("confusion")[1][0].alias("fn"), F.col("confusion")[1][1].alias("tp"),
    ))


def per_register_f1(spark, sf):
    return _round(EV.per_slice_f1(_scored(spark, sf), "label", "pred_a", "language_register"))


def compare_models(spark, sf):
    return _round(EV.compare_slices(_scored(spark, sf), PREDS, "label", "language_register"))


def leaderboard(spark, sf):
    return _round(EV.leaderboard(_scored(spark, sf), PREDS, "label"))


def test_vs_probe(spark, sf):
    es = _eval_sets(spark, sf)
    return _round(EV.eval_set_table(D.with_stand_ins(es), PREDS, "label", "eval_set", ("test", "probe")))


# ----------------------------------------------------------------------------- errors

def prediction_join(spark, sf):
    s = _scored(spark, sf)
    a = s.select("doc_id", "label", "language_register", "pred_a", "prob_a")
    b = s.select("doc_id", "pred_b", "prob_b")
    return _round(E.join_predictions(a, [b], "doc_id"))


def prediction_join_text(spark, sf):
    """J1 on the text: repeated texts multiply."""
    s = _scored(spark, sf)
    a = s.select("text", "label", "language_register", "pred_a", "prob_a")
    return _round(E.join_predictions_on_text(a, [s.select("text", "pred_b", "prob_b")]))


def confident_fp(spark, sf):
    return _round(E.confident_mistakes(_scored(spark, sf), "pred_a", "prob_a", "fp", 10))


def confident_fn(spark, sf):
    return _round(E.confident_mistakes(_scored(spark, sf), "pred_a", "prob_a", "fn", 10))


def accuracy_by_length(spark, sf):
    return _round(E.accuracy_by_length(_scored(spark, sf), "pred_a"))


# ----------------------------------------------------------------------------- linear scoring

def _fixed_model(spark, sf):
    lab = D.labelled(spark, sf)
    model, _ = MO.labelled_log_count_ratio_model(lab, "doc_id", "label", "text", (1, 2), None, 2, 50_000)
    model.params = materialized(model.params, "params")
    return lab, model


def linear_score(spark, sf):
    lab, m = _fixed_model(spark, sf)
    s = MO.score(lab, m, "doc_id", "text")
    return _round(s.select("doc_id", "probability", MO.predict_class("probability").alias("pred")))


def decision(spark, sf):
    lab, m = _fixed_model(spark, sf)
    s = MO.with_decision(MO.score(lab, m, "doc_id", "text"), m)
    return _round(s.select("doc_id", "probability", "decision", "threshold", "model_version"))


def linear_contributions(spark, sf):
    lab, m = _fixed_model(spark, sf)
    terms = FE.terms_by_key(lab.select("doc_id", "text"), "doc_id", "text", (1, 2))
    return _round(MO.term_contributions(terms, m, "doc_id", 10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_corpus": normalize_corpus,
    "normalize_aliases": normalize_aliases,
    "null_text_filter": null_text_filter,
    "merge_first_wins": merge_first_wins,
    "merge_keep_all": merge_keep_all,
    "clean_coerced": clean_coerced,
    "clean_url": clean_url,
    "clean_mention": clean_mention,
    "clean_hashtag": clean_hashtag,
    "clean_repeat": clean_repeat,
    "clean_space": clean_space,
    "clean_html_basic": clean_html_basic,
    "clean_html_full": clean_html_full,
    "clean_all": clean_all,
    "entity_terms": entity_terms,
    "validate_rows": validate_rows,
    "validate_domain": validate_domain,
    "validate_payload": validate_payload,
    "alignment_check": alignment_check,
    "alignment_duplicates": alignment_duplicates,
    "class_balance": class_balance,
    "source_label_crosstab": source_label_crosstab,
    "register_breakdown": register_breakdown,
    "curation_summary": curation_summary,
    "length_describe": length_describe,
    "length_histogram": length_histogram,
    "length_sketch_quantiles": length_sketch_quantiles,
    "length_coverage": length_coverage,
    "token_counts": token_counts,
    "log_odds_top": log_odds_top,
    "log_odds_bottom": log_odds_bottom,
    "ngram_terms": ngram_terms,
    "vocabulary_idf": vocabulary_idf,
    "vocabulary_uncapped": vocabulary_uncapped,
    "tfidf_weights": tfidf_weights,
    "stratified_split": stratified_split,
    "class_weights": class_weights,
    "probe_holdout": probe_holdout,
    "confusion": confusion,
    "per_class_report": per_class_report,
    "accuracy": accuracy,
    "macro_f1": macro_f1,
    "evaluation_report": evaluation_report,
    "per_register_f1": per_register_f1,
    "compare_models": compare_models,
    "leaderboard": leaderboard,
    "test_vs_probe": test_vs_probe,
    "prediction_join": prediction_join,
    "prediction_join_text": prediction_join_text,
    "confident_fp": confident_fp,
    "confident_fn": confident_fn,
    "accuracy_by_length": accuracy_by_length,
    "linear_score": linear_score,
    "decision": decision,
    "linear_contributions": linear_contributions,
    # rows-only (training, iterative or streaming; no SQL equivalent)
    "train_lr_report": lambda spark, sf: _round(FL.train_lr_report(spark, sf)),
    "select_best_model": lambda spark, sf: _round(FL.select_best_model(spark, sf)),
    "embedding_lr_report": lambda spark, sf: _round(FL.embedding_lr_report(spark, sf)),
    "batch_udf_score": lambda spark, sf: _round(
        FL.batch_udf_score(spark, sf).select("vec_id", "label", "split", F.col("batched").alias("probability"))),
    "batch_udf_agrees": FL.batch_udf_agrees,
    "explain_decisions": lambda spark, sf: _round(FL.explain_decisions(spark, sf)),
    "explain_tokens": FL.explain_tokens,
    "stream_score": lambda spark, sf: _round(FL.stream_score(spark, sf)),
    "stream_dedup": lambda spark, sf: FL.stream_dedup(spark, sf).select("text"),
    **{name: (lambda q: lambda spark, sf: _round(q(spark, sf)))(q) for name, q in STORAGE.items()},
    **TRAINING,
    **STREAMS,
}
