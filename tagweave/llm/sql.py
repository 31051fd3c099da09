"""DuckDB SQL that gives the rows of numbered queries, written without their methods."""

from __future__ import annotations


def _part_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e
  FROM (SELECT q.n, q.p, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.x, b.x)]) AS d
        FROM q JOIN b{r} b USING (p)) GROUP BY n, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % c) + c) % c) / c AS BIGINT) ORDER BY i) AS x
    FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS c
          FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN q USING (n, p)) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n,
         [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (
  SELECT vec_id, label, n, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, n - 1 AS e, x FROM q WHERE n <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT n, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n),
book AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT kept.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (n), book
"""


PART_CODES = _part_codes()

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_DOCUMENTS = f"""
WITH t AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS term FROM documents),
i AS MATERIALIZED (
  SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, docs),
part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS s
  FROM tf JOIN w USING (term) JOIN len USING (doc_id), tot),
scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM i JOIN part USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def _components(k: int, percent: int = 80, more: str = "") -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + {k - 1}], ' ') for i in range(1, greatest(len(w) - {k - 1}, 1) + 1)]) AS s
  FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= {percent} * (x.n + y.n - common)),
reach(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, reach.low FROM reach JOIN l ON l.u = reach.doc_id WHERE reach.low < l.v),
c AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id),
m AS (SELECT u AS doc_id, count(*) AS n_links FROM l GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


JACCARD_COMPONENTS = _components(5, more=", coalesce(n_links, 0) AS n_links")
SHINGLE_COMPONENTS = _components(2, more=", doc_id = component_id AS kept")

PASSAGES = """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) > 12)),
f AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (k) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
