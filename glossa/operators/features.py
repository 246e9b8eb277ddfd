"""TF-IDF features as relational tables.

Plan shape (per document row, no shuffle until the vocabulary):
  clean -> tokens -> distinct n-grams as packed counts (Arrow) -> explode (doc, term, tf)
Vocabulary: one aggregation by term (map-side partial counts, so a term that
occurs in a third of all documents costs one row per task), min_df filter,
then the top ``max_features`` by corpus frequency (ties by term): histograms
find the frequency of the last term kept, only terms of that frequency are
ranked, and ranks come from ranges of terms.  No task sees all terms.  Whether
a join broadcasts the vocabulary is left to its measured size.
Weights of texts: tokens and packed counts are dealt by key before they become
terms, so that the norm of a text needs no exchange of (text, term) rows.

Weights follow the reference vectorizer: case-sensitive terms, sublinear tf
``1 + ln(tf)``, smoothed idf ``ln((1 + N) / (1 + df)) + 1``, row L2 norm.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.clean import clean_col
from glossa.functions.text import gram_counts, gram_frequency, gram_term, word_tokens
from glossa.session import materialized

# Features and scores decode every HTML entity unless told otherwise.
FULL_CLEAN = {"html": "full"}
CUT_BUCKETS = 4096  # counts that one turn of the vocabulary cut brings to the driver, at most
RANGE_ROWS = 100_000  # terms that one task ranks, about


def doc_tokens(df: DataFrame, text: str = "text", clean: dict | None = None,
               max_length: int | None = None) -> Column:
    """F1 on cleaned text (+F7 truncation)."""
    flags = dict(FULL_CLEAN if clean is None else clean)
    # runs of spaces and a single one part tokens alike
    flags["skip"] = (*flags.get("skip", ()), "spaces")
    return word_tokens(clean_col(text, **flags), max_length)


def doc_terms(
    df: DataFrame,
    key: str | list[str] = "doc_id",
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 2),
    clean: dict | None = None,
    tokens_col: str | None = None,
    keep_empty: bool = False,
    max_length: int | None = None,
) -> DataFrame:
    """``(key..., term, tf)`` rows; counts are taken inside the row.  Only the first
    ``max_length`` tokens of a text count (F7).

    ``tokens_col`` skips cleaning/tokenising (pre-tokenised input, e.g.
    perturbed documents).  ``keep_empty`` keeps documents with no terms as one
    row with NULL term (for scoring every document)."""
    keys = [key] if isinstance(key, str) else list(key)
    return _terms(_counted(df, keys, text, ngram_range, clean, tokens_col, max_length), keys, ngram_range, keep_empty)


def _counted(df: DataFrame, keys: list[str], text: str, ngram_range: tuple[int, int], clean: dict | None,
             tokens_col: str | None, max_length: int | None) -> DataFrame:
    """(keys..., _tok, _g): the tokens of every text and its distinct n-grams as packed counts."""
    toks = F.col(tokens_col) if tokens_col else doc_tokens(df, text, clean)
    if max_length is not None:
        toks = F.slice(toks, 1, max_length)
    counted = df.select(*keys, gram_counts(toks, *ngram_range).alias("_c"))
    return counted.select(*keys, F.col("_c.tokens").alias("_tok"), F.col("_c.grams").alias("_g"))


def _terms(counted: DataFrame, keys: list[str], ngram_range: tuple[int, int], keep_empty: bool = False) -> DataFrame:
    # for ``explode`` the planner adds a filter on the array and computes all that is below it twice
    grams = counted.select(*keys, "_tok", F.explode_outer("_g").alias("_g"))
    return (grams if keep_empty else grams.where(F.col("_g").isNotNull())).select(
        *keys, gram_term("_tok", "_g", *ngram_range).alias("term"), gram_frequency("_g").alias("tf"))


def terms_by_key(
    df: DataFrame, key: str | list[str] = "doc_id", text: str = "text", ngram_range: tuple[int, int] = (1, 2),
    clean: dict | None = None, tokens_col: str | None = None, keep_empty: bool = False, max_length: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """``doc_terms`` partitioned by key (or the part ``by`` of it).  What is dealt is a text's tokens,
    as one string, and eight bytes for each distinct n-gram; they become terms behind the exchange."""
    keys = [key] if isinstance(key, str) else list(key)
    counted = _counted(df, keys, text, ngram_range, clean, tokens_col, max_length)
    if tokens_col:  # tokens of any kind: as they are
        return _terms(counted.repartition(*(by or keys)), keys, ngram_range, keep_empty)
    dealt = counted.select(*keys, F.array_join("_tok", " ").alias("_tok"), "_g").repartition(*(by or keys))
    return _terms(dealt.withColumn("_tok", F.split("_tok", " ")), keys, ngram_range, keep_empty)


def term_stats(terms: DataFrame, key: str | list[str] = "doc_id", label: str | None = None) -> DataFrame:
    """per term document frequency and total count; with ``label`` (a
    column carried on the term rows) also the document frequency per class,
    ``df_pos`` / ``df_neg``, in the same aggregation."""
    aggs = [F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_total")]
    if label is not None:
        aggs += [F.count_if(F.col(label) == 1).alias("df_pos"), F.count_if(F.col(label) == 0).alias("df_neg")]
    return terms.where(F.col("term").isNotNull()).groupBy("term").agg(*aggs)


def vocabulary(
    terms: DataFrame,
    n_docs: DataFrame,
    min_df: int = 2,
    max_features: int | None = 50_000,
) -> DataFrame:
    """F3+K4: ``term, df, tf_total, idf, index``.

    ``n_docs`` is a one-row DataFrame with column ``n_docs`` (documents with no
    terms count too).  ``index`` = position in term order, as a vectorizer
    assigns feature columns."""
    return vocabulary_from_stats(term_stats(terms), n_docs, min_df, max_features)


def vocabulary_from_stats(
    stats: DataFrame,
    n_docs: DataFrame,
    min_df: int = 2,
    max_features: int | None = 50_000,
) -> DataFrame:
    """``vocabulary`` on an existing ``term_stats`` table.  The terms of ``min_df`` documents are
    written to the shared folder, as several jobs read them."""
    return indexed_vocabulary(materialized(stats.select("term", "df", "tf_total").where(F.col("df") >= min_df), "term-stats"),
                              n_docs, max_features)


def indexed_vocabulary(st: DataFrame, n_docs: DataFrame, max_features: int | None = 50_000) -> DataFrame:
    """``vocabulary`` of a written table of the terms of ``min_df`` documents."""
    st = term_index(st if max_features is None else most_frequent(st, max_features))
    idf = F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    return st.crossJoin(F.broadcast(n_docs)).select(
        "term", "df", "tf_total", idf.alias("idf"), "index"
    )


def frequency_cut(stats: DataFrame, k: int, count: str = "tf_total", buckets: int = CUT_BUCKETS) -> tuple[int, int] | None:
    """(cut, above): the ``k``-th largest value of ``count`` and how many rows lie above it, or
    None if there are at most ``k`` rows.

    Each turn counts the rows of one range of values in at most ``buckets`` equal parts and
    goes on with the part that holds the ``k``-th; the driver sees that many counts."""
    size = stats.agg(F.min(count).alias("lo"), F.max(count).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if size["n"] <= k:
        return None
    lo, hi, above = size["lo"], size["hi"], 0
    while lo < hi:
        width = -(-(hi - lo + 1) // buckets)
        part = F.expr(f"({count} - {lo}) div {width}").alias("part")
        parts = stats.where(F.col(count).between(lo, hi)).groupBy(part).count().collect()
        for row in sorted(parts, key=lambda r: -r["part"]):
            if above + row["count"] >= k:
                lo, hi = lo + row["part"] * width, min(hi, lo + (row["part"] + 1) * width - 1)
                break
            above += row["count"]
    return lo, above


def most_frequent(stats: DataFrame, k: int, count: str = "tf_total", name: str = "term") -> DataFrame:
    """The ``k`` rows of largest ``count`` (ties: smallest ``name``), without a task that sees ``k``
    rows of every other: all above the cut, and the first of those at it."""
    cut = frequency_cut(stats, k, count)
    if cut is None:
        return stats
    value, above = cut
    tied = term_index(stats.where(F.col(count) == value), name).where(F.col("index") < k - above).drop("index")
    return stats.where(F.col(count) > value).unionByName(tied)


def term_index(terms: DataFrame, name: str = "term", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``index``, the position in order of ``name``, without one task for all terms: terms are
    dealt into ranges of about ``rows``, ranked inside each, and shifted by the sizes of the ranges
    before (one number per range)."""
    n = terms.count() // rows + 1
    # the id of a row is its partition, and in the lower 33 bits its place there
    ranged = materialized(terms.repartitionByRange(n, name).sortWithinPartitions(name).withColumn(
        "_at", F.monotonically_increasing_id()), "ranked-terms")
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy(part.alias("_p")).count().collect()}
    before = list(accumulate((sizes.get(i, 0) for i in range(n)), initial=0))
    shift = F.get(F.array(*(F.lit(b) for b in before)), part)
    return ranged.withColumn("index", (place + shift).cast("int")).drop("_at")


def count_docs(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))


def tfidf(
    terms: DataFrame,
    vocab: DataFrame,
    key: str | list[str] = "doc_id",
    sublinear_tf: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """``(key..., term, index, weight)`` for in-vocabulary terms."""
    keys = [key] if isinstance(key, str) else list(key)
    tfw = (1.0 + F.ln(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    j = terms.join(vocab.select("term", "idf", "index"), "term")
    w = j.select(*keys, "term", "index", (tfw * F.col("idf")).alias("w"))
    if not normalize:
        return w.withColumnRenamed("w", "weight")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", "index", (F.col("w") / norm).alias("weight"))


def text_tfidf(
    df: DataFrame, vocab: DataFrame, key: str | list[str] = "doc_id", text: str = "text",
    ngram_range: tuple[int, int] = (1, 2), clean: dict | None = None, max_length: int | None = None,
) -> DataFrame:
    """F1-F5 from texts: ``tfidf`` with one exchange, that of tokens and packed counts.  Those of a key
    become terms in the task that sums their norm; terms are many times the size of their texts."""
    keys = [key] if isinstance(key, str) else list(key)
    return tfidf(terms_by_key(df, keys, text, ngram_range, clean, max_length=max_length), vocab, keys)


def length_coverage(df: DataFrame, lengths=(64, 128, 160, 512), text: str = "text",
                    clean: dict | None = None) -> DataFrame:
    """share of documents whose token count fits ``max_length``."""
    n = F.size(doc_tokens(df, text, clean))
    counted = df.select(n.alias("n"))
    aggs = []
    for L in lengths:
        aggs.append(F.count_if(F.col("n") <= L).alias(f"w{L}"))
    one = counted.agg(F.count(F.lit(1)).alias("n_docs"), *aggs)
    arr = F.array(*[F.struct(F.lit(L).cast("bigint").alias("max_length"),
                             F.col(f"w{L}").alias("n_within")) for L in lengths])
    return one.select("n_docs", F.explode(arr).alias("c")).select(
        "c.max_length", "n_docs", "c.n_within",
        F.coalesce(F.try_divide(F.col("c.n_within").cast("double"), F.col("n_docs").cast("double")),
                   F.lit(0.0)).alias("share"),
    )
