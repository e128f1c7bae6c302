"""SQL oracles over vectors, windows and questions: brute force over all pairs."""

from __future__ import annotations

from logspark import fixed
from logspark.plans.inputs import QUESTIONS
from logspark.plans.oracle import lines_of, part, q, query, strings, strip
from logspark.plans.search_queries import KNN_LIMIT


def buckets_of(text: str) -> str:
    tokens = f"regexp_extract_all(lower({text}), {q(fixed.VECTOR_TOKEN)})"
    return f"list_transform({tokens}, lambda t: cast('0x' || substr(sha1(t), 1, 8) AS bigint) % {fixed.VECTOR_DIM})"


def vectors(source: str, keys: str, text: str) -> str:
    """``keys, bucket, n`` rows."""
    return (
        f"SELECT {keys}, b AS bucket, count(*) AS n FROM "
        f"(SELECT {keys}, unnest({buckets_of(text)}) AS b FROM {source}) GROUP BY {keys}, b"
    )


query(
    "hash_embedding",
    [],
    f"""
WITH v AS ({vectors('documents', 'doc_id', 'text')}),
a AS (SELECT doc_id, string_agg(cast(bucket AS varchar) || ':' || cast(n AS varchar), ' ' ORDER BY bucket) AS vector,
        cast(sum(n * n) AS bigint) AS norm2 FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.vector, '') AS vector, coalesce(a.norm2, 0) AS norm2 FROM documents d LEFT JOIN a USING (doc_id)
""",
)

part("template_vectors", ["groups"], vectors("(SELECT DISTINCT template FROM groups)", "template", "template"))
part("template_norms", ["template_vectors"], "SELECT template, cast(sum(n * n) AS bigint) AS norm2, count(*) AS buckets FROM template_vectors GROUP BY template")

query(
    "template_index",
    ["enriched", "template_norms"],
    """
SELECT group_id AS id, user_id, file_id, level, severity, fingerprint, coalesce(buckets, 0) AS buckets, coalesce(norm2, 0) AS norm2
FROM enriched LEFT JOIN template_norms USING (template)
""",
)

query(
    "similar_incidents",
    ["enriched", "template_vectors", "template_norms"],
    f"""
WITH dots AS (SELECT a.template AS t1, b.template AS t2, sum(a.n * b.n) AS dot
              FROM template_vectors a JOIN template_vectors b USING (bucket) GROUP BY ALL),
pairs AS (SELECT t1, t2, cast(dot AS double) / sqrt(cast(x.norm2 * y.norm2 AS double)) AS score
          FROM dots JOIN template_norms x ON x.template = t1 JOIN template_norms y ON y.template = t2),
seeds AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, fingerprint) AS group_rank FROM enriched),
found AS (SELECT s.user_id, s.file_id, s.group_id AS seed_group_id, s.group_rank, h.group_id AS match_group_id,
            h.file_id AS match_file_id, h.template AS match_template, h.severity AS match_severity, p.score,
            row_number() OVER (PARTITION BY s.group_id ORDER BY p.score DESC, h.group_id) AS match_rank
          FROM seeds s JOIN pairs p ON p.t1 = s.template AND p.score >= {fixed.SIMILARITY_THRESHOLD}
          JOIN enriched h ON h.template = p.t2 AND h.user_id = s.user_id AND h.file_id <> s.file_id
          QUALIFY match_rank <= {fixed.SIMILAR_LIMIT}),
once AS (SELECT * EXCLUDE (score), round(score, 3) AS score FROM found
         QUALIFY row_number() OVER (PARTITION BY file_id, match_group_id ORDER BY group_rank, match_rank) = 1)
SELECT user_id, file_id, cast(row_number() OVER (PARTITION BY file_id ORDER BY score DESC, group_rank, match_rank) AS int) AS position,
  seed_group_id, match_group_id, match_file_id, match_template, match_severity, score FROM once
QUALIFY position <= {fixed.SIMILAR_LIMIT}
""",
)

query(
    "vector_upsert",
    [],
    """
SELECT vec_id AS id, label AS user_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS version,
  round(cast(CASE WHEN vec_id % 2 = 0 THEN embedding[-1] ELSE embedding[1] END AS double), 6) AS first_value
FROM embeddings
""",
)

query(
    "vector_knn",
    [],
    f"""
WITH s AS (SELECT a.label AS tenant, a.vec_id AS query_id, b.vec_id AS match_id,
  list_dot_product(a.embedding::double[], b.embedding::double[]) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT cast(tenant AS bigint) AS tenant, query_id, match_id, round(score, 4) AS score,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS int) AS rank
FROM s QUALIFY rank <= {KNN_LIMIT}
""",
)

query(
    "stored_vector_search",
    [],
    f"""
WITH p AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END::double[] AS e FROM embeddings),
s AS (SELECT a.label AS tenant, a.vec_id AS query_id, b.vec_id AS match_id, list_dot_product(a.embedding::double[], b.e) AS score
  FROM embeddings a JOIN p b ON a.label = b.label WHERE a.vec_id % 10 = 0)
SELECT cast(tenant AS bigint) AS tenant, query_id, match_id, round(score, 4) AS score,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS int) AS rank
FROM s QUALIFY rank <= {KNN_LIMIT}
""",
)


def chunks_sql(lines: str) -> str:
    """Windows with text from ``file_id, line_no, raw`` by a range join."""
    return f"""
WITH t AS (SELECT file_id, max(line_no) AS total FROM {lines} GROUP BY file_id),
s AS (SELECT *, 30 AS stride FROM t),
w AS (SELECT *, stride + 10 AS win, greatest(0, cast(ceil((total - stride - 10) / stride) AS bigint)) AS last_chunk FROM s),
c AS (SELECT file_id, total, stride, win, unnest(range(last_chunk + 1)) AS chunk_no FROM w),
r AS (SELECT file_id, chunk_no, chunk_no * stride + 1 AS start_line, least(chunk_no * stride + win, total) AS end_line FROM c)
SELECT r.file_id, r.chunk_no, r.start_line, r.end_line, string_agg(l.raw, chr(10) ORDER BY l.line_no) AS text
FROM r JOIN {lines} l ON l.file_id = r.file_id AND l.line_no BETWEEN r.start_line AND r.end_line
WHERE {strip('l.raw')} <> '' GROUP BY r.file_id, r.chunk_no, r.start_line, r.end_line
"""


part(
    "document_lines",
    [],
    f"""
WITH l AS (SELECT doc_id AS file_id, {lines_of('text')} AS lines FROM documents)
SELECT file_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS raw FROM l
""",
)
part("document_chunks", ["document_lines"], chunks_sql("document_lines"))
part("wide_chunks", ["long_log_lines"], chunks_sql("long_log_lines"))
part("log_chunks", ["log_lines"], chunks_sql("log_lines"))

for _name, _part in (("line_chunks", "document_chunks"), ("line_chunks_wide", "wide_chunks")):
    query(
        _name, [_part], f"SELECT file_id, chunk_no, start_line, end_line, md5(text) AS text_md5 FROM {_part}"
    )

part(
    "questions",
    ["log_lines"],
    f"""
WITH f AS (SELECT DISTINCT file_id FROM log_lines)
SELECT file_id * {len(QUESTIONS)} + i AS question_id, file_id, {strings(QUESTIONS)}[i + 1] AS question
FROM f, range({len(QUESTIONS)}) AS r(i)
""",
)

part(
    "scored_chunks",
    ["log_chunks", "questions"],
    f"""
WITH kinds AS (SELECT DISTINCT question FROM questions),
qk AS (SELECT question, list_filter(list_distinct(regexp_extract_all(lower(question), {q(fixed.RETRIEVAL_TOKEN)})),
         lambda t: NOT list_contains({strings(fixed.STOP_WORDS)}, t)) AS toks FROM kinds),
qt AS (SELECT question, unnest(toks) AS tok FROM qk),
ct AS (SELECT DISTINCT file_id, chunk_no, unnest(regexp_extract_all(lower(text), {q(fixed.RETRIEVAL_TOKEN)})) AS term FROM log_chunks),
terms AS (SELECT DISTINCT term FROM ct),
m AS (SELECT question, tok, term FROM qt JOIN terms ON starts_with(term, tok) OR starts_with(tok, term)),
hits AS (SELECT file_id, chunk_no, question, count(DISTINCT tok) AS hits FROM ct JOIN m USING (term) GROUP BY ALL),
qv AS ({vectors('kinds', 'question', 'question')}),
cv AS ({vectors('log_chunks', 'file_id, chunk_no', 'text')}),
qn AS (SELECT question, cast(sum(n * n) AS bigint) AS n2 FROM qv GROUP BY question),
cn AS (SELECT file_id, chunk_no, cast(sum(n * n) AS bigint) AS n2 FROM cv GROUP BY ALL),
dots AS (SELECT cv.file_id, cv.chunk_no, qv.question, cast(sum(cv.n * qv.n) AS bigint) AS dot FROM cv JOIN qv USING (bucket) GROUP BY ALL)
SELECT qs.question_id, qs.question, c.file_id, c.chunk_no, c.start_line, c.end_line, c.text,
  CASE WHEN len(qk.toks) > 0 THEN cast(coalesce(h.hits, 0) AS double) / len(qk.toks) ELSE 0.0 END
  + {fixed.COSINE_WEIGHT} * coalesce(cast(d.dot AS double) / sqrt(cast(cn.n2 * qn.n2 AS double)), 0.0) AS score
FROM questions qs JOIN log_chunks c USING (file_id) JOIN qk ON qk.question = qs.question
LEFT JOIN hits h ON h.file_id = c.file_id AND h.chunk_no = c.chunk_no AND h.question = qs.question
LEFT JOIN dots d ON d.file_id = c.file_id AND d.chunk_no = c.chunk_no AND d.question = qs.question
LEFT JOIN cn ON cn.file_id = c.file_id AND cn.chunk_no = c.chunk_no LEFT JOIN qn ON qn.question = qs.question
""",
)

part(
    "retrieved",
    ["scored_chunks"],
    f"""
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, start_line) AS rank FROM scored_chunks
WHERE score >= {fixed.MIN_RETRIEVAL_SCORE} QUALIFY rank <= {fixed.TOP_CHUNKS}
""",
)

query(
    "chunk_retrieval",
    ["retrieved"],
    "SELECT question_id, file_id, chunk_no, cast(rank AS int) AS rank, round(score, 4) AS score, start_line, end_line FROM retrieved",
)



def scrub(text: str) -> str:
    return f"regexp_replace({text}, {q(fixed.FENCE_LOOKALIKE)}, {q(fixed.FENCE_REPLACEMENT)}, 'g')"


part(
    "answers",
    ["retrieved", "questions"],
    f"""
WITH r AS (SELECT *, {scrub('text')} AS shown FROM retrieved),
a AS (SELECT question_id, string_agg(start_line || '-' || end_line, ', ' ORDER BY rank) AS citations,
        string_agg('[lines ' || start_line || '-' || end_line || ']' || chr(10) || shown, chr(10) || chr(10) ORDER BY rank) AS body,
        first(struct_pack(s := start_line, e := end_line, t := shown) ORDER BY rank) AS best FROM r GROUP BY question_id)
SELECT qs.question_id, a.question_id IS NOT NULL AS answered, coalesce(a.citations, '') AS citations,
  sha256('Retrieved log excerpts:' || chr(10) || {q(fixed.FENCE_OPEN)} || chr(10) || a.body || chr(10) || {q(fixed.FENCE_CLOSE)}
    || chr(10) || chr(10) || 'Question: ' || {scrub('qs.question')}) AS context_sha,
  CASE WHEN a.question_id IS NULL THEN {q(fixed.REFUSAL)} ELSE
    'Based on [lines ' || best.s || '-' || best.e || '], the log shows: "' || string_split(best.t, chr(10))[1]
    || '". This is the relevant evidence for your question.' END AS answer
FROM questions qs LEFT JOIN a ON a.question_id = qs.question_id
""",
)
query("extractive_answers", ["answers"], "SELECT * FROM answers")
query(
    "stored_messages",
    ["answers", "questions"],
    """
SELECT question_id, cast(0 AS bigint) AS turn, 'user' AS role, md5(question) AS text_md5 FROM questions
UNION ALL SELECT question_id, 1, 'assistant', md5(answer) FROM answers
""",
)
