"""License scan: ordered signature rules, in DataFrame functions only.

A text is first tested for trigger strings; only texts with one are normalised to
folded words.  Each rule is gated by its keyword before its regex runs.  A match is
a detection, an interval of words.  A detection is suppressed when it lies inside
an earlier, better ordered one (start, longer first, priority, rule order) of the
same or better priority.  The base phrases are counted at all their places and
never suppressed.

Null counts as empty; texts without matches give 0, nulls and empty label lists.
Repeated rows get one result each.  Empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.license_rules import compiled, rules, triggers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = (1, 2, 3, 4)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def normalised(text: Column) -> Column:
    """Folded words, each between two spaces of its own."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def triggered(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for t in triggers():
        out = out | F.contains(low, F.lit(t))
    return out


def _rule_table(spark) -> DataFrame:
    """One row per rule and keyword; its size is that of the rule list."""
    rows = [(r.order, r.label, r.priority, k, compiled(r.pattern), r.base)
            for r in rules() for k in r.keyword.split("|")]
    return spark.createDataFrame(rows, "rule int, label string, priority int, keyword string, regex string, base boolean")


def _words_in(piece: Column) -> Column:
    """Words of a part of the normalised text (two spaces each)."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, rule, label, priority, base, first, last, suppressed): every match of every
    rule, once per distinct (key, text)."""
    table = _rule_table(docs.sparkSession)
    keywords = sorted({k for r in rules() for k in r.keyword.split("|")})
    own = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_text")).where(triggered(F.col("_text")))
    own = own.select("_k", F.md5("_text").alias("_d"), normalised(F.col("_text")).alias("_n"))
    gates = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("_n"), F.concat(
        F.lit(" "), k, F.when(k == "licen", F.lit("")).otherwise(F.lit(" ")))))
    tried = own.withColumn("keyword", F.explode(gates)).join(F.broadcast(table), "keyword").where("_n rlike regex")
    matched = tried.select("_k", "_d", "rule", "label", "priority", "base", F.posexplode(F.arrays_zip(
        F.expr("split(_n, regex, -1)").alias("gap"), F.expr("regexp_extract_all(_n, regex, 0)").alias("hit"))))
    matched = matched.where(F.col("col.hit").isNotNull()).distinct()  # rules with two keywords, repeated rows
    each = Window.partitionBy("_k", "_d", "rule").orderBy("pos")
    size = _words_in(F.col("col.hit"))
    last = F.sum(_words_in(F.col("col.gap")) + size).over(each) / 2
    placed = matched.select("_k", "_d", "rule", "label", "priority", "base", (last - size / 2).cast("long").alias("first"),
                            last.cast("long").alias("last"))
    by_place = Window.partitionBy("_k", "_d").orderBy("first", F.desc("last"), "priority", "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for level in reversed(LEVELS):
        best = F.max(F.when((F.col("priority") <= level) & ~F.col("base"), F.col("last"))).over(by_place)
        reach = F.when(F.col("priority") <= level, best).otherwise(reach)
    inside = ~F.col("base") & F.coalesce(reach >= F.col("last"), F.lit(False))
    return placed.select(F.col("_k").alias(key), F.col("_d").alias("digest"), "rule", "label", "priority", "base",
                         "first", "last", inside.alias("suppressed"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``labels`` are the base labels and those of detections that stand; the score is
    s / (s + 4) where s adds 5 - priority of each standing label's strongest detection.
    """
    found = detections(docs, key, text)
    stands = ~F.col("suppressed")
    by_label = (found.groupBy(F.col(key).alias("_k"), F.col("digest").alias("_d"), "label")
                .agg(F.count_if("base").alias("n"),
                     F.min(F.when(F.col("base"), F.col("first"))).alias("first"),
                     F.max(F.when(F.col("base"), F.col("first"))).alias("last"),
                     F.bool_or(stands).alias("stands"),
                     F.min(F.when(stands & ~F.col("base"), F.col("priority"))).alias("best")))
    by_text = by_label.groupBy("_k", "_d").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("stands"), F.col("label")))), ",").alias("labels"),
        F.sum(F.coalesce(5 - F.col("best"), F.lit(0))).cast("double").alias("s"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias(key), word_count(body).alias("n_words"),
                       F.when(triggered(body), F.md5(body)).alias("_own"))
    out = rows.join(by_text, rows[key].eqNullSafe(by_text["_k"]) & (rows["_own"] == by_text["_d"]), "left")
    return out.select(
        key, "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"),
        F.col("first").alias("first_word"), F.col("last").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce(F.col("s") / (F.col("s") + 4), F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same result in DuckDB SQL, every rule tried on every text, with positions from the
    normalised text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({r.order}, {quoted(r.label)}, {r.priority}, {quoted(compiled(r.pattern))}, {str(r.base).lower()})"
                        for r in rules())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    levels = " ".join(f"WHEN {p} THEN max(CASE WHEN priority <= {p} AND NOT base THEN last END) OVER w" for p in LEVELS)
    return f"""
WITH rules(rule, label, priority, regex, base) AS (VALUES {values}),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS ws FROM documents),
n AS (SELECT r, doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM d),
hit AS (SELECT r, rule, label, priority, base, regexp_extract_all(t, regex) AS hits, string_split_regex(t, regex) AS gaps
        FROM n JOIN rules ON regexp_matches(t, regex)),
pos AS (SELECT r, rule, label, priority, base, unnest(range(len(hits))) AS i, hits, gaps FROM hit),
place AS (SELECT r, rule, label, priority, base, hits[i + 1] AS h,
        array_to_string(gaps[1:i + 1], '') || array_to_string(hits[1:i], '') AS before FROM pos),
span AS (SELECT r, rule, label, priority, base, (length(before) - length(replace(before, ' ', ''))) // 2 AS first,
        (length(before || h) - length(replace(before || h, ' ', ''))) // 2 AS last FROM place),
sup AS (SELECT *, NOT base AND coalesce((CASE priority {levels} END) >= last, false) AS gone FROM span
        WINDOW w AS (PARTITION BY r ORDER BY first, last DESC, priority, rule
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lab AS (SELECT r, label, count(*) FILTER (base) AS n, min(first) FILTER (base) AS first, max(first) FILTER (base) AS last,
        bool_or(NOT gone) AS stands, min(priority) FILTER (NOT gone AND NOT base) AS best FROM sup GROUP BY r, label),
agg AS (SELECT r, sum(n) AS n, min(first) AS first, max(last) AS last,
        string_agg(label, ',' ORDER BY label) FILTER (n > 0) AS base_labels,
        string_agg(label, ',' ORDER BY label) FILTER (stands) AS labels,
        sum(coalesce(5 - best, 0))::DOUBLE AS s FROM lab GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word,
  last::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(s / (s + 4), 0.0)::DOUBLE AS score
FROM n LEFT JOIN agg USING (r)"""
