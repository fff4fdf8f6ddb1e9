"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents
), s AS (
  SELECT rid, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0
), t AS (
  SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS words FROM s
), tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM s) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), wt AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS HUGEINT) AS weight
  FROM tf, t GROUP BY term, docs
), scored AS (
  SELECT q.item_id, s.doc_id, rid,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN s USING (rid), t GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""

OP13 = rf"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^ 	]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?
-]')) AS piece
        FROM documents)
), tot AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS HUGEINT) AS a
  FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:m], ' ') AS two
  FROM f, range(1, 5) AS r(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.one JOIN f r ON r.lang = c.lang AND r.phrase = c.two
  JOIN tot ON tot.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.a >= 100 * b.a
    AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLE = {
    "op2_decontamination": OP2,
    "op10_exact_dedup": OP10,
    "op12_lexical_search": OP12,
    "op13_collocations": OP13,
}
