"""DuckDB SQL for the queries of this subpackage that SQL can express (the license scan's is
beside its rules)."""

from __future__ import annotations

from glossa.llm import license_scan
from glossa.llm.license_scan import LOWER, UPPER
from glossa.llm.spelling import CRC_TABLE

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NONSPACE = r"[^\x20\x09-\x0D]+"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED}, '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLDED}, '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
        FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT * FROM d, sizes WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, n, item FROM dw JOIN win USING (n, k)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN ids USING (r)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED}, '{NONSPACE}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i)
      WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM both_ JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT r, r AS m FROM d UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.m)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.m
                                   GROUP BY reach.r) c USING (r)"""

PASSAGES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{NONSPACE}') AS w FROM documents),
win AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k
        FROM (SELECT * FROM d WHERE len(w) >= 50), unnest(range(1, len(w) - 48)) AS t(i)),
seen AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM win JOIN seen USING (k) WHERE f < doc_id)),
word AS (SELECT r, i AS p, w[i] AS t FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT r, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM (SELECT * FROM n WHERE n >= 200), unnest(range(1, n - 198)) AS t(i)),
hit AS (SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
mark AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -201) + 200 AS fresh FROM hit),
run AS (SELECT r, min(i) AS a, max(i) + 199 AS b FROM (SELECT r, i, count_if(fresh) OVER (PARTITION BY r ORDER BY i) AS island FROM mark)
        GROUP BY r, island),
piece AS (SELECT r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1,
                 2 * (a - 1 - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS t FROM run JOIN n USING (r)),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last, string_agg(t, '' ORDER BY a) AS kept FROM piece GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.r IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM n LEFT JOIN cut USING (r)"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT r, i, w[i] AS t, translate(regexp_replace(regexp_replace(w[i], '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                                        '{UPPER}', '{LOWER}') AS k FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
often AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(t, chr(10) ORDER BY i) AS t FROM l ANTI JOIN often USING (k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_lines, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_dropped,
  sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_CRC_BYTES = ("flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] "
              "ELSE [195, ord(c) - 64] END))")
SPELLING = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS w
                     FROM documents),
u AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS c FROM t WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, c, xor(4294967295, list_reduce({_CRC_BYTES}::BIGINT[],
        lambda a, b: xor(a >> 8, ({CRC_TABLE.tolist()}::BIGINT[])[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM u),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM h),
v AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS n FROM x WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2),
gap AS MATERIALIZED (SELECT DISTINCT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM v, unnest(range(1, length(w) + 1)) AS t(i)),
near AS (SELECT a.w, b.w AS o FROM gap a JOIN gap b ON a.i = b.i AND a.k = b.k AND a.w <> b.w
         UNION SELECT gap.w, v.w FROM gap JOIN v ON gap.k = v.w UNION SELECT v.w, gap.w FROM gap JOIN v ON gap.k = v.w),
best AS (SELECT near.w, o, v.n, count(*) OVER (PARTITION BY near.w) AS n_near,
                row_number() OVER (PARTITION BY near.w ORDER BY v.n DESC, o) AS place FROM near JOIN v ON v.w = o),
f AS MATERIALIZED (SELECT v.w AS word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 10 * v.n THEN o END AS form,
             CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.w = v.w AND place = 1),
way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
root AS (SELECT way.word, way.root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def _clustering(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    distance = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))".format(d=dims)
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {distance}::BIGINT, 'c': c.c}}) AS m FROM v, c{i} c GROUP BY r)")
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT m.c AS c, j, sum(q[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN v USING (r), "
                f"unnest(range(1, {dims} + 1)) AS t(j) GROUP BY ALL), "
                f"n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM s{i} GROUP BY c), "
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN n{i} USING (c))")
    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(x, lambda y: floor(greatest(least(y * 1024, {1 << 27}), -{1 << 27}))::BIGINT) AS q FROM raw
      WHERE len(x) = {dims} AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS c, q FROM
      (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k})),
{", ".join(steps)},
last AS (SELECT vec_id, m.c AS cluster, m.d AS distance FROM a{rounds} JOIN v USING (r))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM last JOIN c{rounds} c ON c.c = cluster"""


ORACLE = {
    "op1_decontamination": DECONTAMINATION,
    "op2_license_scan": license_scan.oracle(),
    "op5_suffix_dedup": REPEATS,
    "op6_ngram_join": JACCARD,
    "op7_recompression": PASSAGES,
    "op11_spelling_variants": SPELLING,
    "op12_line_dedup": LINES,
    "op13_centroid_clustering": _clustering(),
}
