"""The training-data queries that plain SQL can express, for an independent engine."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

def _words(pattern: str) -> str:
    """The words of ``text``, A-Z lower-cased."""
    return f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{pattern}')"


_REACH = """
reach AS (SELECT DISTINCT a AS node, a AS seen FROM links
          UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
          ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH},
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, cast(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN component ON component.node = vec_id
""",
    "op9_minhash": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        ELSE list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
           GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
{_REACH}
SELECT d.doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN component ON component.node = d.doc_id
""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT item_id, {_words(r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')} AS w FROM benchmark),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight
           FROM tf, size GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
scored AS (SELECT item_id, doc_id,
             sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weight USING (term), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op12_importance": rf"""
WITH table_ AS MATERIALIZED (SELECT list(c ORDER BY b) AS crc_of FROM (
  SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
  FROM range(256) t(b))),
d AS (SELECT row_number() OVER () AS row, doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
own AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) GROUP BY ALL),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM i) GROUP BY ALL),
named AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM wanted)),
bytes AS (SELECT word, list_transform(range(1, length(h), 2),
            lambda k: 16 * (instr('123456789ABCDEF', h[k]) ) + instr('123456789ABCDEF', h[k + 1])) AS b FROM named),
hashed AS (SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || b,
             lambda c, x: xor(c >> 8, crc_of[(xor(c, x) % 256) + 1]))) % 10000 AS bucket FROM bytes, table_),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM own JOIN hashed USING (word) GROUP BY ALL),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM wanted JOIN hashed USING (word) GROUP BY ALL),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)
           / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
            FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY ALL),
noise AS (SELECT row, doc_id, len(w) AS n_words, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT::DOUBLE AS h FROM d),
scored AS (SELECT row, doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
           FROM noise LEFT JOIN weighed USING (row)),
drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (row)
""",
}
