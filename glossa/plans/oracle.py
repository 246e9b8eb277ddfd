"""SQL side of the query catalogue: ANSI SQL (DuckDB dialect) over the
pre-registered driver tables, one string per query of ``catalog.QUERIES``
that has a relational equivalent.  Column names and types match the Spark
results; doubles are rounded to 6 places in the final projection.

DuckDB's RE2 has no back-references, so the repeat-collapse step is written
as a character-list filter: a character is dropped when it equals the three
before it (and is not a newline) — the same rule, stated without regex.
"""

from __future__ import annotations

from glossa.functions.clean import (
    HASHTAG_PATTERN,
    HTML_BASIC_ENTITIES,
    MENTION_PATTERN,
    NON_SPACE_PATTERN,
    URL_PATTERN,
    USER_PLACEHOLDER,
    URL_PLACEHOLDER,
    WHITESPACE_PATTERN,
)
from glossa.functions.text import EDA_WORD_PATTERN, TERM_PATTERN
from glossa.plans.streams import DELAY_SECONDS, LATE_SECONDS, PART_SECONDS, PARTS
from glossa.plans.data import PROBE_SOURCE, RARE_ENTITIES, SYNTH_PREFIX


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def html_basic(e: str) -> str:
    for ent, ch in HTML_BASIC_ENTITIES:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    return e


def url(e: str) -> str:
    return f"regexp_replace({e}, {q(URL_PATTERN)}, {q(URL_PLACEHOLDER)}, 'g')"


def mention(e: str) -> str:
    return f"regexp_replace({e}, {q(MENTION_PATTERN)}, {q(USER_PLACEHOLDER)}, 'g')"


def hashtag(e: str) -> str:
    return f"regexp_replace({e}, {q(HASHTAG_PATTERN)}, '\\1', 'g')"


def space(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WHITESPACE_PATTERN)}, ' ', 'g'))"


def repeat_from_chars(chars: str) -> str:
    """Collapse runs of >= 4 equal characters given a column of characters."""
    keep = (f"lambda x, i: i < 4 OR x = chr(10) OR x <> {chars}[i-1] "
            f"OR x <> {chars}[i-2] OR x <> {chars}[i-3]")
    return f"array_to_string(list_filter({chars}, {keep}), '')"


def clean_rows(src: str, keys: str, text: str, repeat: bool = True, html: bool = True,
               urls: bool = True, mentions: bool = True, hashtags: bool = True, ws: bool = True) -> str:
    """Sub-select ``(keys, cleaned)`` applying the cleaning chain in order."""
    e = text
    if html:
        e = html_basic(e)
    if urls:
        e = url(e)
    if mentions:
        e = mention(e)
    if hashtags:
        e = hashtag(e)
    inner = f"SELECT {keys}, {e} AS _t FROM {src}"
    if repeat:
        step = (f"SELECT {keys}, {repeat_from_chars('_c')} AS _t FROM "
                f"(SELECT {keys}, string_split(_t, '') AS _c FROM ({inner}))")
    else:
        step = inner
    last = space("_t") if ws else "_t"
    return f"(SELECT {keys}, {last} AS cleaned FROM ({step}))"


def ws_tokens(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, {q(NON_SPACE_PATTERN + '+')})) AS BIGINT)"


def terms_of(tokens: str) -> str:
    """Unigrams and bigrams of a token list, as a list."""
    return (f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
            f"lambda i: {tokens}[i] || ' ' || {tokens}[i+1]))")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS BIGINT) AS label, d.source, d.lang AS language_register,
         CAST(l.toxic AS BIGINT) AS toxic, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED = LABELLED + """,
scored AS (
  SELECT *, CAST(n_chars >= 400 AS BIGINT) AS pred_a, n_chars / (n_chars + 400.0::DOUBLE) AS prob_a,
         CAST(1 - toxic AS BIGINT) AS pred_b, CASE WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS prob_b
  FROM labelled)"""

SYNTH = f"""synth AS (
  SELECT doc_id, {q(SYNTH_PREFIX)} || CAST(doc_id AS VARCHAR) || '  @user' || CAST(doc_id AS VARCHAR)
         || ' #' || lang || ' soooooo ' || text AS text FROM documents)"""

CURATION = """cur AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS BIGINT) AS label,
         CASE d.lang WHEN 'en' THEN 'en-IN' WHEN 'fr' THEN 'hi-en' ELSE d.lang END AS register,
         CASE WHEN l.toxic = 1 THEN ' ' ELSE d.source END AS rationale
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, {q(NON_SPACE_PATTERN)}))"


VIOLATION = f"""CASE WHEN {blank('text')} THEN 'text'
  WHEN label IS NULL OR label NOT IN (0, 1) THEN 'label'
  WHEN register IS NULL OR register NOT IN ('en-IN', 'hi-en') THEN 'register'
  WHEN {blank('rationale')} THEN 'rationale' END"""


def counts(y: str, p: str, prefix: str = "") -> str:
    return (f"count_if({y} = 0 AND {p} = 0) AS {prefix}tn, count_if({y} = 0 AND {p} = 1) AS {prefix}fp, "
            f"count_if({y} = 1 AND {p} = 0) AS {prefix}fn, count_if({y} = 1 AND {p} = 1) AS {prefix}tp")


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0::DOUBLE ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


def f1n(p: str = "") -> str:
    return ratio(f"2*{p}tn", f"2*{p}tn + {p}fp + {p}fn")


def f1p(p: str = "") -> str:
    return ratio(f"2*{p}tp", f"2*{p}tp + {p}fp + {p}fn")


def macro(p: str = "") -> str:
    k0 = f"CAST(2*{p}tn + {p}fp + {p}fn > 0 AS INTEGER)"
    k1 = f"CAST(2*{p}tp + {p}fp + {p}fn > 0 AS INTEGER)"
    return ratio(f"{f1n(p)} * {k0} + {f1p(p)} * {k1}", f"{k0} + {k1}")


def acc(p: str = "") -> str:
    return ratio(f"{p}tn + {p}tp", f"{p}tn + {p}fp + {p}fn + {p}tp")


# ----------------------------------------------------------------------------- term tables

def doc_terms_sql(src: str, keys: str = "doc_id") -> str:
    """(keys, term, tf) over cleaned text of ``src`` (a table with keys + text)."""
    cleaned = clean_rows(src, keys, "text")
    toks = f"regexp_extract_all(cleaned, {q(TERM_PATTERN)})"
    return (f"(SELECT {keys}, term, CAST(count(*) AS BIGINT) AS tf FROM ("
            f"SELECT {keys}, unnest({terms_of('_tok')}) AS term FROM "
            f"(SELECT {keys}, {toks} AS _tok FROM {cleaned})) GROUP BY {keys}, term)")


def vocab_sql(terms: str, n_docs: str, min_df: int = 2, max_features: int = 50_000) -> str:
    return f"""(SELECT term, df, tf_total, ln((1 + n_docs) / (1 + df)) + 1 AS idf,
       CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf_total
        FROM {terms} GROUP BY term HAVING count(*) >= {min_df}
        ORDER BY tf_total DESC, term LIMIT {max_features}) v,
       (SELECT CAST(count(*) AS DOUBLE) AS n_docs FROM {n_docs}) n)"""


def split_sql(src: str, test: float = 0.2, seed: int = 42) -> str:
    """(doc_id, label, split) exact stratified split of ``src`` (doc_id, label)."""
    return f"""(WITH c AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
  t AS (SELECT sum(n) AS tot, CAST(ceil({test}::DOUBLE * sum(n)) AS BIGINT) AS nt FROM c),
  f AS (SELECT label, n, CAST(n AS DOUBLE) * nt / tot AS cont, floor(CAST(n AS DOUBLE) * nt / tot) AS fl, nt FROM c, t),
  g AS (SELECT *, nt - sum(fl) OVER () AS need, cont - fl AS rem FROM f),
  qt AS (SELECT label, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= need THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g),
  r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM {src})
  SELECT r.doc_id, r.label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN qt ON r.label = qt.label)"""


EVAL_SETS = LABELLED + f""",
pool AS (SELECT doc_id, label FROM labelled WHERE source <> {q(PROBE_SOURCE)}),
sp AS {split_sql('pool')},
probe AS (SELECT doc_id, label, text FROM labelled WHERE source = {q(PROBE_SOURCE)}),
es AS (
  SELECT s.doc_id, s.label, 'train' AS eval_set FROM sp s JOIN labelled l ON s.doc_id = l.doc_id
   WHERE s.split = 'train' AND l.text NOT IN (SELECT text FROM probe)
  UNION ALL SELECT doc_id, label, 'test' FROM sp WHERE split = 'test'
  UNION ALL SELECT doc_id, label, 'probe' FROM probe)"""

FIXED_MODEL = LABELLED + f""",
lterms AS {doc_terms_sql('labelled')},
vocab AS {vocab_sql('lterms', 'labelled')},
cls AS (SELECT count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg FROM labelled),
dfs AS (SELECT t.term, count_if(l.label = 1) AS df_pos, count_if(l.label = 0) AS df_neg
        FROM lterms t JOIN labelled l ON t.doc_id = l.doc_id GROUP BY t.term),
params AS (SELECT v.term, v.idf, ln((df_pos + 1.0::DOUBLE) / (n_pos + 2.0::DOUBLE))
                  - ln((df_neg + 1.0::DOUBLE) / (n_neg + 2.0::DOUBLE)) AS coef
           FROM dfs JOIN vocab v ON dfs.term = v.term, cls),
icpt AS (SELECT ln(CAST(n_pos AS DOUBLE) / n_neg) AS b FROM cls),
wts AS (SELECT t.doc_id, t.term, (1 + ln(t.tf)) * p.idf AS w, p.coef FROM lterms t JOIN params p ON t.term = p.term),
agg AS (SELECT doc_id, sum(w * coef) AS dot, sum(w * w) AS ss FROM wts GROUP BY doc_id),
prob AS (SELECT l.doc_id, 1.0 / (1.0 + exp(-((CASE WHEN coalesce(a.ss, 0) > 0 THEN a.dot / sqrt(a.ss) ELSE 0.0 END) + icpt.b))) AS probability
         FROM labelled l LEFT JOIN agg a ON l.doc_id = a.doc_id, icpt)"""


# ----------------------------------------------------------------------------- catalogue

def _clean_query(step_sql: str) -> str:
    return f"WITH {SYNTH} SELECT doc_id, {step_sql} AS cleaned FROM synth"


def _arrivals_sql() -> str:
    """The micro-batches one after the other: mark, late rows, first rows of new texts, state."""
    steps = [f"""docs AS (SELECT doc_id, text, doc_id % {PARTS} AS part, (doc_id % {PARTS}) * {PART_SECONDS} + doc_id % 600
  - CASE WHEN doc_id % 10 = 7 THEN {LATE_SECONDS} ELSE 0 END + {LATE_SECONDS} AS ts FROM documents),
mark0 AS (SELECT NULL::BIGINT AS m)"""]
    for p in range(PARTS):
        seen = f"AND NOT EXISTS (SELECT 1 FROM state{p - 1} s WHERE s.text IS NOT DISTINCT FROM o.text)" if p else ""
        before = f"SELECT text, ts FROM state{p - 1} UNION ALL" if p else ""
        steps.append(f"""part{p} AS (SELECT doc_id, text, ts FROM docs WHERE part = {p}),
on{p} AS (SELECT doc_id, text, ts, row_number() OVER (PARTITION BY text ORDER BY ts, doc_id) AS place FROM part{p}, mark{p}
  WHERE m IS NULL OR ts >= m),
new{p} AS MATERIALIZED (SELECT doc_id, text, ts FROM on{p} o WHERE place = 1 {seen}),
mark{p + 1} AS (SELECT greatest((SELECT max(ts) FROM part{p}) - {DELAY_SECONDS}, m)::BIGINT AS m FROM mark{p}),
state{p} AS MATERIALIZED (SELECT text, ts FROM ({before} SELECT text, ts FROM new{p}), mark{p + 1} WHERE m IS NULL OR ts + {DELAY_SECONDS} >= m),
rows{p} AS (SELECT doc_id, CASE WHEN ts < m THEN 'late' WHEN doc_id IN (SELECT doc_id FROM new{p}) THEN 'first' ELSE 'duplicate' END
  AS status FROM part{p}, mark{p})""")
    return "WITH " + ",\n".join(steps)


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["normalize_corpus"] = """SELECT d.doc_id, CAST(d.text AS VARCHAR) AS text, CAST(l.quality AS BIGINT) AS label,
  'documents' AS source, d.lang AS language_register FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    s["normalize_aliases"] = """SELECT d.doc_id, d.text AS text, CAST(l.toxic AS BIGINT) AS label,
  'aliases' AS source, 'en' AS language_register FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    s["null_text_filter"] = f"""SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, {ws_tokens('d.text')} AS n_tokens
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.source <> {q(PROBE_SOURCE)}"""
    union = """WITH u AS (
  SELECT d.text, CAST(l.quality AS BIGINT) AS label, 'labelled' AS source, d.lang AS language_register,
         1 AS frame_ord, CAST(d.doc_id AS BIGINT) AS row_key, CAST(0 AS BIGINT) AS row_sub
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT text, CAST(0 AS BIGINT), 'documents', lang, 2, doc_id, CAST(0 AS BIGINT) FROM documents
  UNION ALL SELECT text, CAST(0 AS BIGINT), 'conversations', 'und', 3, conv_id, turn FROM conversations)"""
    s["merge_first_wins"] = union + """
SELECT text, label, source, language_register, frame_ord, row_key, row_sub FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY frame_ord, row_key, row_sub) AS rn FROM u) WHERE rn = 1"""
    s["merge_keep_all"] = union + "\nSELECT text, label, source, language_register, frame_ord, row_key, row_sub FROM u"
    s["clean_url"] = _clean_query(url("text"))
    s["clean_mention"] = _clean_query(mention("text"))
    s["clean_hashtag"] = _clean_query(hashtag("text"))
    s["clean_repeat"] = (f"WITH {SYNTH} SELECT doc_id, {repeat_from_chars('_c')} AS cleaned FROM "
                         f"(SELECT doc_id, string_split(text, '') AS _c FROM synth)")
    s["clean_space"] = f"SELECT doc_id, {space('text')} AS cleaned FROM documents"
    s["clean_html_basic"] = f"SELECT page_id, {html_basic('html')} AS cleaned FROM pages"
    s["clean_html_full"] = f"SELECT page_id, {q(RARE_ENTITIES[1])} || {html_basic('html')} AS cleaned FROM pages"
    decoded = f"(SELECT doc_id, {q(RARE_ENTITIES[1])} || text AS text FROM documents)"
    s["entity_terms"] = f"SELECT doc_id, term, tf FROM {doc_terms_sql(decoded)}"
    s["clean_all"] = f"WITH {SYNTH} SELECT doc_id, cleaned FROM {clean_rows('synth', 'doc_id', 'text')}"
    s["validate_rows"] = f"WITH {CURATION} SELECT doc_id, {VIOLATION} AS violation FROM cur"
    s["validate_domain"] = f"""WITH {CURATION}
SELECT DISTINCT 'label' AS field, CAST(label AS VARCHAR) AS bad_value FROM cur WHERE label IS NULL OR label NOT IN (0, 1)
UNION SELECT DISTINCT 'register', register FROM cur WHERE register IS NULL OR register NOT IN ('en-IN', 'hi-en')"""
    s["validate_payload"] = f"""SELECT doc_id, n_chars, CASE WHEN text IS NULL THEN 'missing'
  WHEN length(text) < 1 THEN 'too_short' WHEN length(text) > 4000 THEN 'too_long'
  WHEN NOT regexp_matches(text, {q(NON_SPACE_PATTERN)}) THEN 'blank' END AS reason FROM documents"""
    aligned = """SELECT CAST(coalesce(sum(greatest(nl - nr, 0)), 0) AS BIGINT) AS n_left_only,
  CAST(coalesce(sum(greatest(nr - nl, 0)), 0) AS BIGINT) AS n_right_only, coalesce(bool_and(nl = nr), true) AS aligned
  FROM (SELECT k, sum(l) AS nl, sum(r) AS nr FROM ({}) GROUP BY k)"""
    s["alignment_check"] = aligned.format(
        "SELECT doc_id AS k, 1 AS l, 0 AS r FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels")
    s["alignment_duplicates"] = aligned.format(
        "SELECT lang AS k, 1 AS l, 0 AS r FROM documents UNION ALL "
        "SELECT d.lang, 0, 1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    s["class_balance"] = f"""WITH {LABELLED} SELECT label, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM labelled GROUP BY label"""
    s["source_label_crosstab"] = f"""WITH {LABELLED} SELECT source, count_if(label = 0) AS label_0,
  count_if(label = 1) AS label_1 FROM labelled GROUP BY source"""
    s["register_breakdown"] = f"""WITH {LABELLED} SELECT language_register, count(text) AS n,
  CAST(sum(label) AS BIGINT) AS n_positive, round(CAST(sum(label) AS DOUBLE) * 100.0 / count(text), 2) AS pct_positive
  FROM labelled GROUP BY language_register"""
    s["curation_summary"] = f"""WITH {CURATION}, valid AS (SELECT text, label, register, rationale FROM cur WHERE ({VIOLATION}) IS NULL),
  reg AS (SELECT register, count(*) AS n FROM valid GROUP BY register)
SELECT count(*) AS total, count_if(label = 1) AS n_positive, count(*) - count_if(label = 1) AS n_negative,
  CASE WHEN count(*) > 0 THEN round(CAST(count_if(label = 1) AS DOUBLE) * 100.0 / count(*), 2) ELSE 0.0 END AS pct_positive,
  (SELECT '{{' || coalesce(string_agg('"' || register || '":' || CAST(n AS VARCHAR), ',' ORDER BY register), '') || '}}' FROM reg) AS by_register,
  coalesce(round(avg(length(rationale)), 1), 0.0) AS avg_rationale_length FROM valid"""
    long = f"""{LABELLED}, lng AS (
  SELECT label, 'n_tokens' AS metric, {ws_tokens('text')} AS v FROM labelled
  UNION ALL SELECT label, 'n_chars', CAST(length(text) AS BIGINT) FROM labelled)"""
    s["length_describe"] = f"""WITH {long}
SELECT label, metric, count(v) AS count, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std,
  {r6('min(v)')} AS min, {r6('quantile_cont(v, 0.25)')} AS p25, {r6('quantile_cont(v, 0.5)')} AS p50,
  {r6('quantile_cont(v, 0.75)')} AS p75, {r6('max(v)')} AS max FROM lng GROUP BY label, metric"""
    s["length_histogram"] = f"""WITH {long},
  rng AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM lng GROUP BY metric),
  pc AS (SELECT label, metric, count(*) AS n_class FROM lng GROUP BY label, metric),
  b AS (SELECT l.label, l.metric, r.lo, r.hi,
          CAST(CASE WHEN r.hi = r.lo THEN 1 ELSE least(CAST(floor((l.v - r.lo) * 40 / CAST(r.hi - r.lo AS DOUBLE)) AS BIGINT) + 1, 40) END AS BIGINT) AS bin
        FROM lng l JOIN rng r ON l.metric = r.metric),
  c AS (SELECT label, metric, bin, lo, hi, count(*) AS n FROM b GROUP BY label, metric, bin, lo, hi)
SELECT c.label, c.metric, c.bin, c.n,
  {r6('c.lo + (c.bin - 1) * (CASE WHEN c.hi = c.lo THEN 1.0 ELSE (c.hi - c.lo) / 40.0 END)')} AS bin_start,
  {r6('CASE WHEN c.hi = c.lo THEN 1.0 ELSE (c.hi - c.lo) / 40.0 END')} AS bin_width,
  {r6('c.n / (pc.n_class * (CASE WHEN c.hi = c.lo THEN 1.0 ELSE (c.hi - c.lo) / 40.0 END))')} AS density
FROM c JOIN pc ON c.label = pc.label AND c.metric = pc.metric"""
    cov = f"SELECT doc_id, len(regexp_extract_all(cleaned, {q(TERM_PATTERN)})) AS n FROM {clean_rows('documents', 'doc_id', 'text')}"
    s["length_coverage"] = f"""WITH n AS ({cov}), L AS (SELECT unnest([64, 128, 160, 512]) AS max_length)
SELECT CAST(L.max_length AS BIGINT) AS max_length, (SELECT count(*) FROM n) AS n_docs,
  (SELECT count_if(n.n <= L.max_length) FROM n) AS n_within,
  {r6('(SELECT count_if(n.n <= L.max_length) FROM n) / (SELECT count(*) FROM n)')} AS share FROM L"""
    tc = f"""{LABELLED}, toks AS (SELECT label, unnest(regexp_extract_all(lower(text), {q(EDA_WORD_PATTERN)})) AS token FROM labelled),
  tc AS (SELECT token, count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg FROM toks GROUP BY token)"""
    s["token_counts"] = f"WITH {tc} SELECT token, n_pos, n_neg FROM tc"
    lo = f"""{tc}, tot AS (SELECT sum(n_pos) AS P, sum(n_neg) AS N, count(*) AS V FROM tc),
  lo AS (SELECT token, n_pos, n_neg, ln(((n_pos + 0.5) / (P + 0.5 * V)) / ((n_neg + 0.5) / (N + 0.5 * V))) AS log_odds FROM tc, tot)"""
    for name, order in (("log_odds_top", "DESC"), ("log_odds_bottom", "ASC")):
        s[name] = f"""WITH {lo} SELECT token, n_pos, n_neg, {r6('log_odds')} AS log_odds, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY log_odds {order}, token) AS BIGINT) AS rank FROM lo) WHERE rank <= 20"""
    s["ngram_terms"] = f"SELECT doc_id, term, tf FROM {doc_terms_sql('documents')}"
    s["vocabulary_idf"] = (f"WITH t AS {doc_terms_sql('documents')}, v AS {vocab_sql('t', 'documents')} "
                           f"SELECT term, df, tf_total, {r6('idf')} AS idf, index FROM v")
    s["vocabulary_uncapped"] = s["vocabulary_idf"].replace("LIMIT 50000", "")
    s["tfidf_weights"] = f"""WITH t AS {doc_terms_sql('documents')}, v AS {vocab_sql('t', 'documents')},
  w AS (SELECT t.doc_id, t.term, v.index, (1 + ln(t.tf)) * v.idf AS w FROM t JOIN v ON t.term = v.term)
SELECT doc_id, term, index, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w"""
    s["stratified_split"] = f"WITH {LABELLED}, src AS (SELECT doc_id, label FROM labelled) SELECT * FROM {split_sql('src')}"
    s["class_weights"] = f"""WITH {LABELLED}, src AS (SELECT doc_id, label FROM labelled), sp AS {split_sql('src')},
  c AS (SELECT label, count(*) AS n FROM sp WHERE split = 'train' GROUP BY label)
SELECT label, n, {r6('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM c"""
    s["probe_holdout"] = f"WITH {EVAL_SETS} SELECT doc_id, label, eval_set FROM es"
    s["confusion"] = f"WITH {SCORED} SELECT {counts('label', 'pred_a')} FROM scored"
    cnt = f"(SELECT {counts('label', 'pred_a')} FROM scored)"
    s["per_class_report"] = f"""WITH {SCORED}, c AS {cnt}
SELECT CAST(0 AS BIGINT) AS class, {r6(ratio('tn', 'tn + fn'))} AS precision, {r6(ratio('tn', 'tn + fp'))} AS recall,
  {r6(f1n())} AS f1, tn + fp AS support FROM c
UNION ALL SELECT CAST(1 AS BIGINT), {r6(ratio('tp', 'tp + fp'))}, {r6(ratio('tp', 'tp + fn'))}, {r6(f1p())}, tp + fn FROM c"""
    s["accuracy"] = f"WITH {SCORED}, c AS {cnt} SELECT {r6(acc())} AS accuracy, tn + fp + fn + tp AS n FROM c"
    s["macro_f1"] = f"WITH {SCORED}, c AS {cnt} SELECT {r6(macro())} AS macro_f1 FROM c"
    s["evaluation_report"] = f"""WITH {SCORED}, c AS {cnt}
SELECT {r6(acc())} AS accuracy, {r6(macro())} AS macro_f1,
  {r6(ratio('tn', 'tn + fn'))} AS negative_precision, {r6(ratio('tn', 'tn + fp'))} AS negative_recall,
  {r6(f1n())} AS negative_f1, tn + fp AS negative_support,
  {r6(ratio('tp', 'tp + fp'))} AS positive_precision, {r6(ratio('tp', 'tp + fn'))} AS positive_recall,
  {r6(f1p())} AS positive_f1, tp + fn AS positive_support, tn, fp, fn, tp FROM c"""
    s["per_register_f1"] = f"""WITH {SCORED}, c AS (SELECT language_register AS register, count(*) AS n, {counts('label', 'pred_a')}
  FROM scored WHERE language_register IS NOT NULL GROUP BY language_register)
SELECT register, n, {r6(macro())} AS macro_f1 FROM c"""
    s["compare_models"] = f"""WITH {SCORED}, c AS (SELECT language_register AS register, count(*) AS n,
  {counts('label', 'pred_a', 'a_')}, {counts('label', 'pred_b', 'b_')}
  FROM scored WHERE language_register IS NOT NULL GROUP BY language_register)
SELECT register, n, {r6(macro('a_'))} AS model_a, {r6(macro('b_'))} AS model_b FROM c"""
    s["leaderboard"] = f"""WITH {SCORED}, lg AS (SELECT 'model_a' AS model, label, pred_a AS pred FROM scored
  UNION ALL SELECT 'model_b', label, pred_b FROM scored),
  c AS (SELECT model, {counts('label', 'pred')} FROM lg GROUP BY model)
SELECT model, {r6(acc())} AS accuracy, {r6(macro())} AS macro_f1, {r6(f1p())} AS f1_positive, {r6(f1n())} AS f1_negative FROM c"""
    s["test_vs_probe"] = f"""WITH {EVAL_SETS}, sc AS (
  SELECT e.eval_set, e.label, CAST(l.n_chars >= 400 AS BIGINT) AS pred_a, CAST(1 - l.toxic AS BIGINT) AS pred_b
  FROM es e JOIN labelled l ON e.doc_id = l.doc_id),
  lg AS (SELECT 'model_a' AS model, eval_set, label, pred_a AS pred FROM sc UNION ALL SELECT 'model_b', eval_set, label, pred_b FROM sc),
  c AS (SELECT model, eval_set, {counts('label', 'pred')} FROM lg GROUP BY model, eval_set),
  m AS (SELECT model, eval_set, {macro()} AS f1 FROM c)
SELECT model, {r6("max(f1) FILTER (WHERE eval_set = 'test')")} AS test_macro_f1,
  {r6("max(f1) FILTER (WHERE eval_set = 'probe')")} AS probe_macro_f1 FROM m GROUP BY model"""
    s["prediction_join"] = f"""WITH {SCORED} SELECT a.doc_id, a.label, a.language_register, a.pred_a, {r6('a.prob_a')} AS prob_a,
  b.pred_b, {r6('b.prob_b')} AS prob_b FROM scored a JOIN scored b ON a.doc_id = b.doc_id"""
    for name, want in (("confident_fp", 1), ("confident_fn", 0)):
        s[name] = f"""WITH {SCORED} SELECT doc_id, text, language_register,
  {r6('CASE WHEN pred_a = 1 THEN prob_a ELSE 1 - prob_a END')} AS confidence FROM scored
  WHERE label <> pred_a AND pred_a = {want}
  ORDER BY CASE WHEN pred_a = 1 THEN prob_a ELSE 1 - prob_a END DESC, doc_id LIMIT 10"""
    s["accuracy_by_length"] = f"""WITH {SCORED}, t AS (SELECT {ws_tokens('text')} AS nt, CAST(label = pred_a AS INTEGER) AS correct FROM scored),
  b AS (SELECT CASE WHEN nt > 0 AND nt <= 5 THEN 1 WHEN nt > 5 AND nt <= 10 THEN 2 WHEN nt > 10 AND nt <= 15 THEN 3
     WHEN nt > 15 AND nt <= 20 THEN 4 WHEN nt > 20 AND nt <= 30 THEN 5 WHEN nt > 30 AND nt <= 50 THEN 6
     WHEN nt > 50 THEN 7 END AS bin_ord, correct FROM t)
SELECT bin_ord, ['1-5','6-10','11-15','16-20','21-30','31-50','50+'][bin_ord] AS length_bin, count(*) AS n,
  {r6('avg(correct)')} AS accuracy FROM b WHERE bin_ord IS NOT NULL GROUP BY bin_ord"""
    s["linear_score"] = f"WITH {FIXED_MODEL} SELECT doc_id, {r6('probability')} AS probability, CAST(probability >= 0.5 AS BIGINT) AS pred FROM prob"
    s["decision"] = f"""WITH {FIXED_MODEL} SELECT doc_id, {r6('probability')} AS probability,
  CASE WHEN probability >= 0.5 THEN 'SARCASTIC' ELSE 'NOT_SARCASTIC' END AS decision, 0.5::DOUBLE AS threshold,
  'v0.1.0' AS model_version FROM prob"""
    s["linear_contributions"] = f"""WITH {FIXED_MODEL}, c AS (SELECT doc_id, term, w * coef / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS contribution FROM wts),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, term) AS BIGINT) AS rank FROM c)
SELECT doc_id, rank, term, {r6('contribution')} AS contribution FROM r WHERE rank <= 10"""
    s["stream_dedup"] = "SELECT DISTINCT text FROM documents WHERE text IS NOT NULL"
    every = FIXED_MODEL + f""",
dterms AS {doc_terms_sql('documents')},
dw AS (SELECT t.doc_id, (1 + ln(t.tf)) * p.idf AS w, p.coef FROM dterms t JOIN params p ON t.term = p.term),
dagg AS (SELECT doc_id, sum(w * coef) AS dot, sum(w * w) AS ss FROM dw GROUP BY doc_id),
dprob AS (SELECT d.doc_id, d.text, 1.0 / (1.0 + exp(-((CASE WHEN coalesce(a.ss, 0) > 0 THEN a.dot / sqrt(a.ss) ELSE 0.0 END) + icpt.b))) AS probability
          FROM documents d LEFT JOIN dagg a ON d.doc_id = a.doc_id, icpt),
st AS (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'too_short' WHEN length(text) > 4000 THEN 'too_long'
  WHEN NOT regexp_matches(text, {q(NON_SPACE_PATTERN)}) THEN 'blank' ELSE 'scored' END AS status FROM dprob)"""
    s["stream_score"] = f"""WITH {every} SELECT doc_id, status, CASE WHEN status = 'scored' THEN {r6('probability')} END AS probability,
  CASE WHEN status <> 'scored' THEN NULL WHEN probability >= 0.5 THEN 'SARCASTIC' ELSE 'NOT_SARCASTIC' END AS decision FROM st"""
    s["explain_decisions"] = f"""WITH {FIXED_MODEL} SELECT p.doc_id, CAST(length(l.text) AS BIGINT) AS n_chars, {r6('probability')} AS probability,
  CASE WHEN probability >= 0.5 THEN 'SARCASTIC' ELSE 'NOT_SARCASTIC' END AS decision, 0.5::DOUBLE AS threshold,
  'v0.1.0' AS model_version FROM prob p JOIN labelled l ON p.doc_id = l.doc_id"""
    s["batch_udf_agrees"] = f"""WITH src AS (SELECT vec_id AS doc_id, CAST(label >= 5 AS BIGINT) AS label FROM embeddings)
SELECT doc_id AS vec_id, label, split, true AS agrees FROM {split_sql('src')}"""
    s["corpus_round_trip"] = """SELECT d.doc_id, d.text, CAST(l.toxic AS BIGINT) AS label, 'stored' AS source,
  'en' AS language_register FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    valid = f"WITH {CURATION}, valid AS (SELECT * FROM cur WHERE ({VIOLATION}) IS NULL)"
    s["curated_round_trip"] = f"{valid} SELECT text, label, register, rationale FROM valid"
    s["curated_lenient"] = f"{valid} SELECT text, label, 'curated' AS source, register AS language_register FROM valid"
    s["usable_candidate"] = f"WITH {LABELLED} SELECT text, label FROM labelled WHERE source <> {q(PROBE_SOURCE)}"
    s["stored_predictions"] = s["prediction_join"]
    s["saved_model_score"] = s["linear_score"]
    s["train_checks"] = f"""WITH {LABELLED}, src AS (SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM labelled) WHERE rn = 1),
  sp AS {split_sql('src')}
SELECT count_if(split = 'test') AS n_test, count_if(split = 'test' AND label = 0) AS n_negative,
  count_if(split = 'test' AND label = 1) AS n_positive, true AS same_score, count_if(split = 'train') AS n_train, true AS converged FROM sp"""
    corpus = (f"WITH {LABELLED}, src AS (SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY text "
              "ORDER BY doc_id) AS rn FROM labelled) WHERE rn = 1)")
    parts = (f"{corpus}, sp AS {split_sql('src')}, tr AS (SELECT doc_id, label FROM sp WHERE split = 'train'), "
             f"va AS {split_sql('tr', 0.15)}")
    s["tuned_by_macro_f1"] = f"""{parts} SELECT 3::BIGINT AS n_candidates, true AS metric_is_macro_f1, true AS winner_is_argmax,
  count(*) AS n_rows, count_if(label = 1) AS n_positive FROM tr"""
    s["early_stopping"] = f"""{parts} SELECT true AS stops_by_patience, true AS best_is_argmax, true AS score_is_best_epoch,
  true AS restart_is_same, count(*) AS n_validation, count_if(label = 1) AS n_positive FROM va WHERE split = 'test'"""
    s["prediction_join_text"] = f"""WITH {SCORED} SELECT a.text, a.label, a.language_register, a.pred_a, {r6('a.prob_a')} AS prob_a,
  b.pred_b, {r6('b.prob_b')} AS prob_b FROM scored a JOIN scored b ON a.text = b.text"""
    s["length_sketch_quantiles"] = f"""WITH {LABELLED} SELECT label, metric, count(text) AS n, q, true AS within_error
FROM labelled, (VALUES ('n_tokens'), ('n_chars')) m(metric), (VALUES (0.25::DOUBLE), (0.5), (0.75)) p(q)
GROUP BY label, metric, q HAVING count(text) > 0"""
    s["family_checks"] = f"""{parts} SELECT family, count_if(split = 'test') AS n_scored, true AS in_unit_interval, true AS scores_differ,
  true AS classes_weigh_alike FROM va, (VALUES ('naive_bayes'), ('linear_svc'), ('dense_lr')) f(family) GROUP BY family"""
    s["perturbation_checks"] = f"""WITH {LABELLED}, t AS (SELECT doc_id, cleaned FROM {clean_rows('labelled', 'doc_id', 'text')})
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(cleaned, {q(TERM_PATTERN)}))) AS BIGINT) AS n_words, 8::BIGINT AS n_samples,
  true AS intact_is_whole, true AS others_drop FROM t"""
    s["clean_coerced"] = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS VARCHAR) END AS kept,
  coalesce(CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS VARCHAR) END, 'None') AS cleaned FROM documents"""
    emptied = "(SELECT doc_id, CASE WHEN doc_id % 20 <> 3 THEN text END AS text FROM documents)"
    s["text_batches_agree"] = f"""WITH src AS {emptied}, t AS (SELECT doc_id, cleaned FROM {clean_rows('src', 'doc_id', 'text')})
SELECT doc_id, CAST(CASE WHEN cleaned IS NULL THEN 0 ELSE least(len(regexp_extract_all(cleaned, {q(TERM_PATTERN)})), 128) END AS BIGINT) AS n_tokens, true AS agrees FROM t"""
    s["stream_arrivals"] = _arrivals_sql() + " SELECT doc_id, status, batch FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, status, {p}::INTEGER AS batch FROM rows{p}" for p in range(PARTS)) + ")"
    s["stream_state"] = _arrivals_sql() + " UNION ALL ".join(
        f" SELECT {p}::INTEGER AS batch, (SELECT count(*) FROM part{p}) AS rows, (SELECT count(*) FROM part{p}, mark{p} "
        f"WHERE ts < m) AS late_rows, (SELECT count(*) FROM state{p}) AS state_rows, (SELECT m FROM mark{p + 1}) AS mark"
        for p in range(PARTS))
    return s
