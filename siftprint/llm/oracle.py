"""SQL for the queries that it can express; written from the definitions of the results."""

from __future__ import annotations

from . import quality, warc

_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

LINES = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM t),
wd AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM ln),
u AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS u, array_to_string(w, ' ') AS s, len(w) AS c,
             sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM wd WHERE len(w) > 0),
-- runs of 50 words or more that no line can be taken off at the end, or at the start
e AS (SELECT a.doc_id, a.u, min(b.u) AS v FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.u >= a.u AND b.total - a.total + a.c >= 50 GROUP BY ALL
      UNION SELECT b.doc_id, max(a.u) AS u, b.u AS v FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.u >= a.u AND b.total - a.total + a.c >= 50 GROUP BY ALL),
win AS (SELECT e.doc_id, e.u, e.v, list(s ORDER BY x.u) AS lines FROM e JOIN u x ON x.doc_id = e.doc_id AND x.u BETWEEN e.u AND e.v GROUP BY ALL),
pl AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(u) OVER o AS u0, first_value(v) OVER o AS v0
       FROM win WINDOW o AS (PARTITION BY lines ORDER BY doc_id, u)),
sp AS (SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(u, v0 + 1) ELSE u END AS f, v AS z FROM pl WHERE (doc_id, u) <> (d0, u0)),
gone AS (SELECT DISTINCT u.doc_id, u.u, u.k, u.c FROM sp JOIN u ON u.doc_id = sp.doc_id AND u.u BETWEEN f AND z),
blank AS (SELECT a.doc_id, wd.k FROM gone a JOIN gone b ON a.doc_id = b.doc_id AND b.u = a.u + 1 JOIN wd ON wd.doc_id = a.doc_id AND wd.k > a.k AND wd.k < b.k),
dropped AS (SELECT doc_id, k FROM gone UNION SELECT doc_id, k FROM blank),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM ln ANTI JOIN dropped USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
       (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed_lines,
       (SELECT coalesce(sum(c), 0)::BIGINT FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed_words
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES,
        "op6_minhash_near_dedup": NEAR_DUPLICATES,
        "op7_warc": warc.SQL,
        "op8_quality_rules": quality.SQL,
    }
