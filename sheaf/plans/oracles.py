"""The catalog's queries as plain SQL over the same tables, for checking results."""

from __future__ import annotations

from sheaf.functions.terms import STOP_WORDS, WORD
from sheaf.functions.text import STEM_AND_EXTENSION, WHITESPACE
from sheaf.operators.answers import CONTEXT_BREAK, INSTRUCTION, MAX_QUESTION, NO_CONTEXT_REPLY
from sheaf.operators.keywords import CLAUSE
from sheaf.plans import catalog
from sheaf.plans.ingest import NO_TEXT
from sheaf.settings import OBJECT_FINALIZED


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stripped(value: str) -> str:
    return f"trim({value}, {quoted(WHITESPACE)})"


def words(value: str) -> str:
    return f"regexp_extract_all(lower({value}), {quoted(WORD)})"


def stem(word: str) -> str:
    return f"""CASE
      WHEN {word} LIKE '%ies' AND {word} NOT LIKE '%eies' AND {word} NOT LIKE '%aies'
        THEN left({word}, length({word}) - 3) || 'y'
      WHEN {word} LIKE '%es' AND {word} NOT LIKE '%aes' AND {word} NOT LIKE '%ees' AND {word} NOT LIKE '%oes'
        THEN left({word}, length({word}) - 1)
      WHEN {word} LIKE '%s' AND {word} NOT LIKE '%us' AND {word} NOT LIKE '%ss'
        THEN left({word}, length({word}) - 1)
      ELSE {word} END"""


STOPPED = "(" + ", ".join(quoted(word) for word in STOP_WORDS) + ")"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def recursive_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


DOCS = """docs AS (
  SELECT *, doc_id || '.pdf' AS name, source AS bucket, text AS content,
    'gs://' || source || '/' || doc_id || '.pdf' AS gcs_uri,
    sha256('gs://' || source || '/' || doc_id || '.pdf') AS document_id
  FROM documents)"""

LABELLED = """labelled AS (
  SELECT d.* EXCLUDE (content), 'Revised.' || chr(10) || d.content AS content, l.quality, l.toxic
  FROM docs d JOIN labels l USING (doc_id))"""

STORED = f"""stored AS (
  SELECT d.document_id AS id, d.gcs_uri, d.name AS filename, sha256(d.content) AS content_hash,
    CAST(NULL AS BIGINT) AS size_bytes,
    CAST(len(string_split(d.content, chr(10))) AS INTEGER) AS num_pages,
    CASE WHEN coalesce(l.quality, 1) = 1 THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN coalesce(l.quality, 1) <> 1 THEN 'low quality' END AS error,
    '{{}}' AS metadata,
    {quoted(catalog.UPLOADED)} AS uploaded_at,
    {quoted(catalog.INGESTED)} AS processed_at
  FROM docs d LEFT JOIN labels l USING (doc_id))"""

BATCH = """batch AS (
  SELECT 'gs://' || bucket || '/' || name AS gcs_uri, name AS filename,
    sha256(content) AS content_hash,
    CAST(len(string_split(content, chr(10))) AS INTEGER) AS num_pages,
    '{"raw_bucket":"' || bucket || '","raw_object":"' || name || '"}' AS metadata
  FROM (SELECT bucket, name, content FROM labelled
        UNION ALL
        SELECT 'web', 'page-' || page_id || '.pdf', html FROM pages))"""

UPSERTED = f"""upserted AS (
  SELECT coalesce(s.id, sha256(b.gcs_uri)) AS id,
    coalesce(s.gcs_uri, b.gcs_uri) AS gcs_uri,
    coalesce(b.filename, s.filename) AS filename,
    coalesce(b.content_hash, s.content_hash) AS content_hash,
    s.size_bytes,
    coalesce(b.num_pages, s.num_pages) AS num_pages,
    CASE WHEN b.gcs_uri IS NOT NULL THEN 'processing' ELSE s.status END AS status,
    CASE WHEN b.gcs_uri IS NULL THEN s.error END AS error,
    coalesce(b.metadata, s.metadata) AS metadata,
    coalesce(s.uploaded_at, {quoted(catalog.REUPLOADED)}) AS uploaded_at,
    CASE WHEN b.gcs_uri IS NULL THEN s.processed_at END AS processed_at
  FROM stored s FULL JOIN batch b USING (gcs_uri))"""

LINES = f"""lines AS (
  SELECT document_id, name, page_number, {stripped("page")} AS text
  FROM (SELECT document_id, name, unnest(string_split(content, chr(10))) AS page,
          CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS page_number
        FROM docs))"""


def stride_chunks(name: str, source: str, size: int = 2000, overlap: int = 300) -> str:
    step = size - overlap
    return f"""{name} AS (
  SELECT document_id, chunk_index, 1 AS page_number, content,
    sha256(document_id || '#' || chunk_index) AS chunk_id
  FROM (
    SELECT document_id, content,
      CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INTEGER) AS chunk_index
    FROM (
      SELECT document_id, i, {stripped(f"substr(page, i * {step} + 1, {size})")} AS content
      FROM (SELECT document_id, page,
              unnest(range(0, greatest(1, CAST(ceil((length(page) - {overlap}) / {step}.0) AS BIGINT)))) AS i
            FROM (SELECT document_id, {stripped("content")} AS page FROM {source})
            WHERE page <> ''))
    WHERE content <> ''))"""


CHUNKS = stride_chunks("chunks", "docs")


def cut_level(k: int, separator: str, size: int) -> str:
    """Segments of level k cut before each separator: runs of small pieces, and large ones for the next level."""
    n = len(separator)
    sep = "chr(10)" if separator == "\n" else quoted(separator)
    return f"""cut_{k} AS (
  SELECT document_id, page, s, e, unnest(cuts[:-2]) AS l, unnest(cuts[2:]) AS r
  FROM (SELECT * FROM (
    SELECT document_id, page, s, e, [s] || list_filter(list_transform(range(1, len(arr)),
        lambda i: s + CAST(list_sum(list_transform(arr[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * {n}),
        lambda p: p > s) || [e] AS cuts
    FROM (SELECT *, string_split(substr(page, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)), {sep}) AS arr FROM seg_{k})
    WHERE len(arr) > 1))),
run_{k} AS (
  SELECT document_id, page, [min(l)] || list(r ORDER BY l) AS cuts
  FROM (SELECT *, sum(CASE WHEN r - l >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, s ORDER BY l) AS run
        FROM cut_{k})
  WHERE r - l < {size} GROUP BY document_id, page, s, run),
seg_{k + 1} AS (
  SELECT document_id, page, l AS s, r AS e FROM cut_{k} WHERE r - l >= {size}
  UNION ALL
  SELECT * FROM seg_{k}
  WHERE len(string_split(substr(page, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)), {sep})) < 2)"""


def recursive_chunks(name: str, source: str, size: int = 2000, overlap: int = 300) -> str:
    """Greedy packing of each run of pieces, one chunk per step. Pages hold no blank line in the test tables."""
    levels = ",\n".join(cut_level(k, separator, size) for k, separator in enumerate(("\n", ". ", " ")))
    ends = f"list_filter(range(i + 1, len(cuts)), lambda j: cuts[j + 1] - cuts[f + 1] > {size} AND j - 1 > f)"
    firsts = f"""list_filter(range(f, i), lambda g: cuts[i] - cuts[g + 1] <= {overlap}
      AND (cuts[i + 1] - cuts[g + 1] <= {size} OR g >= i - 1))"""
    return f"""page_of AS (
  SELECT document_id, {stripped("content")} AS page FROM {source}),
seg_0 AS (SELECT document_id, page, CAST(0 AS BIGINT) AS s, CAST(length(page) AS BIGINT) AS e FROM page_of WHERE length(page) > {size}),
{levels},
runs AS (
  SELECT row_number() OVER () AS run, document_id, page, cuts FROM (
    SELECT * FROM run_0 UNION ALL SELECT * FROM run_1 UNION ALL SELECT * FROM run_2
    UNION ALL SELECT document_id, page, range(s, e + 1) FROM seg_3)),
packed(run, cuts, f, i, l, r) AS (
  SELECT run, cuts, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM runs
  UNION ALL
  SELECT run, cuts, CASE WHEN i IS NULL THEN NULL ELSE list_min({firsts}) END, i,
    cuts[f + 1], CASE WHEN i IS NULL THEN cuts[len(cuts)] ELSE cuts[i] END
  FROM (SELECT run, cuts, f, list_min({ends}) AS i FROM packed WHERE f IS NOT NULL)),
{name} AS (
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY l, r) - 1 AS INTEGER) AS chunk_index,
    1 AS page_number, content
  FROM (
    SELECT document_id, l, r, {stripped("substr(page, CAST(l + 1 AS INTEGER), CAST(r - l AS INTEGER))")} AS content
    FROM packed JOIN runs USING (run) WHERE l IS NOT NULL
    UNION ALL
    SELECT document_id, 0, length(page), page FROM page_of WHERE length(page) <= {size})
  WHERE content <> '')"""


RECURSIVE = recursive_chunks("recursive_chunks", "docs")


def postings(name: str, source: str, key: str = "chunk_id", text: str = "content") -> str:
    return f"""{name} AS (
  SELECT {stem("word")} AS term, {key}, CAST(pos AS INTEGER) AS pos
  FROM (SELECT {key}, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos
        FROM (SELECT {key}, {words(text)} AS words FROM {source}))
  WHERE word NOT IN {STOPPED})"""


def hashed(name: str, terms: str, key: str, dim: int) -> str:
    """Hashed unit vectors from postings, as ``(key, embedding)``."""
    return f"""{name}_counts AS (
  SELECT {key}, CAST('0x' || left(md5(term), 8) AS UBIGINT) % {dim} AS bucket, count(*) AS n
  FROM {terms} GROUP BY ALL),
{name} AS (
  SELECT {key}, list(value ORDER BY i) AS embedding
  FROM (SELECT g.{key}, g.i, CAST(coalesce(c.n, 0) / g.length AS FLOAT) AS value
        FROM (SELECT {key}, sqrt(sum(n * n)) AS length, unnest(range(0, {dim})) AS i
              FROM {name}_counts GROUP BY {key}) g
        LEFT JOIN {name}_counts c ON c.{key} = g.{key} AND c.bucket = g.i)
  GROUP BY {key})"""


def nearest(name: str, corpus: str, questions: str, k: int) -> str:
    return f"""{name} AS (
  SELECT query_id, chunk_id, distance,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
  FROM (SELECT q.query_id, c.chunk_id,
          round(list_cosine_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS distance
        FROM {corpus} c CROSS JOIN {questions} q)
  QUALIFY rank <= {k})"""


def clauses(questions: str) -> str:
    return f"""tokens AS (
  SELECT query_id, token, CAST(clause AS INTEGER) AS clause,
    CAST(sum(CASE WHEN lower(token) = 'or' THEN 1 ELSE 0 END)
      OVER (PARTITION BY query_id ORDER BY clause) AS INTEGER) AS grp
  FROM (SELECT query_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS clause
        FROM (SELECT query_id, regexp_extract_all(question, {quoted(CLAUSE)}) AS t FROM {questions}))),
clause_terms AS (
  SELECT query_id, grp, clause, negated, CAST(off AS INTEGER) AS "offset", {stem("word")} AS term
  FROM (SELECT query_id, grp, clause, starts_with(token, '-') AS negated, unnest(w) AS word,
          generate_subscripts(w, 1) - 1 AS off
        FROM (SELECT *, {words("token")} AS w FROM tokens WHERE lower(token) <> 'or'))
  WHERE word NOT IN {STOPPED}),
wanted AS (
  SELECT query_id, grp,
    count(DISTINCT CASE WHEN NOT negated THEN clause END) AS n_required,
    count(DISTINCT CASE WHEN NOT negated THEN term END) AS n_slots
  FROM clause_terms GROUP BY ALL),
clauses AS (
  SELECT c.*, count(*) OVER (PARTITION BY query_id, clause) AS n_terms,
    count(*) OVER (PARTITION BY query_id, grp) AS n_group, w.n_required, w.n_slots
  FROM clause_terms c JOIN wanted w USING (query_id, grp))"""


MATCH = """occ AS (
  SELECT * FROM (
    SELECT p.chunk_id, p.pos, c.*,
      count(*) OVER (PARTITION BY query_id, chunk_id, grp, clause, p.pos - c."offset") AS n_found
    FROM posts p JOIN clauses c USING (term))
  WHERE n_found = n_terms),
ok AS (
  SELECT query_id, chunk_id, grp, any_value(n_slots) AS n_slots
  FROM occ GROUP BY query_id, chunk_id, grp
  HAVING count(DISTINCT CASE WHEN NOT negated THEN clause END) = any_value(n_required)
    AND any_value(n_required) > 0 AND NOT bool_or(negated)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id, grp ORDER BY pos) AS hit
  FROM (SELECT DISTINCT o.query_id, o.chunk_id, o.grp, o.pos, o.term, ok.n_slots
        FROM occ o JOIN ok USING (query_id, chunk_id, grp) WHERE NOT o.negated)),
latest AS (
  SELECT e.query_id, e.chunk_id, e.grp, e.pos, e.hit, e.n_slots, h.term,
    max(h.pos) AS last_pos, max(h.hit) AS last_hit
  FROM hits e JOIN hits h USING (query_id, chunk_id, grp)
  WHERE h.pos <= e.pos GROUP BY ALL),
spans AS (
  SELECT query_id, chunk_id, grp, pos, hit, min(last_pos) AS start, min(last_hit) AS start_hit
  FROM latest GROUP BY query_id, chunk_id, grp, pos, hit HAVING count(*) = any_value(n_slots)),
matched AS (
  SELECT query_id, chunk_id, sum(0.1::DOUBLE / (1 + (pos - start) - (hit - start_hit))) AS score
  FROM (SELECT *, lag(start) OVER (PARTITION BY query_id, chunk_id, grp ORDER BY pos) AS before FROM spans)
  WHERE before IS NULL OR start > before
  GROUP BY query_id, chunk_id)"""

KEYWORD_LEG = f"""keyword_leg AS (
  SELECT query_id, chunk_id, round(score, 9) AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank
  FROM matched QUALIFY rank <= {catalog.TOP_K})"""


def fixed_questions(*texts: str) -> str:
    rows = ", ".join(f"('q{i}', {quoted(text)})" for i, text in enumerate(texts, start=1))
    return f"questions AS (SELECT * FROM (VALUES {rows}) AS t(query_id, question))"


BENCHMARK_QUESTIONS = """questions AS (
  SELECT 'b' || item_id AS query_id,
    '"' || regexp_replace(text, '[.\\n]+\\s*', '" OR "', 'g') || '"' AS question
  FROM benchmark)"""


def keyword(select: str, questions: str) -> str:
    return (
        with_(
            DOCS, CHUNKS, postings("posts", "chunks"), questions, clauses("questions"), MATCH, KEYWORD_LEG
        )
        + select
    )


MEANS = """means AS (
  SELECT query_id, list(x ORDER BY i) AS embedding
  FROM (SELECT query_id, i, avg(CAST(x AS DOUBLE)) AS x
        FROM (SELECT {key} AS query_id, unnest(embedding) AS x,
                generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY query_id, i)
  GROUP BY query_id)"""

ALL_MEAN = MEANS.format(key="'all'")
LABEL_MEANS = MEANS.format(key="'label-' || label")
VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding, label FROM embeddings)"


def vector_search(means: str) -> str:
    return (
        with_(VECTORS, means, nearest("found", "vectors", "means", catalog.TOP_K))
        + "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM found"
    )


def hybrid(select: str, questions: str, *tables: str) -> str:
    return (
        with_(
            DOCS,
            *(tables or (CHUNKS, STORED)),
            postings("posts", "chunks"),
            hashed("vectors", "posts", "chunk_id", catalog.DIM),
            questions,
            postings("asked_terms", "questions", "query_id", "question"),
            hashed("asked", "asked_terms", "query_id", catalog.DIM),
            nearest("v", "vectors", "asked", catalog.TOP_K),
            clauses("questions"),
            MATCH,
            KEYWORD_LEG,
            f"""legs AS (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
    v.rank AS vector_rank, k.rank AS keyword_rank,
    coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS rrf_score
  FROM v FULL JOIN keyword_leg k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id),
found AS (
  SELECT l.query_id, l.chunk_id, c.document_id, d.filename, d.gcs_uri, c.page_number, c.content,
    round(l.rrf_score, 9) AS rrf_score, l.vector_rank, l.keyword_rank,
    CAST(row_number() OVER (PARTITION BY l.query_id ORDER BY round(l.rrf_score, 12) DESC, l.chunk_id) AS INTEGER) AS n
  FROM legs l JOIN chunks c USING (chunk_id) JOIN stored d ON d.id = c.document_id
  WHERE d.status = 'completed'
  QUALIFY n <= 8)""",
        )
        + select
    )


ONLY_NOT = f"""free AS (
  SELECT DISTINCT w.query_id, c.chunk_id, 0.0::DOUBLE AS score FROM wanted w CROSS JOIN chunks c
  WHERE w.n_required = 0 AND NOT EXISTS (
    SELECT 1 FROM occ o WHERE o.query_id = w.query_id AND o.grp = w.grp AND o.chunk_id = c.chunk_id)),
leg AS (
  SELECT query_id, chunk_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(score), 9) AS score
        FROM (SELECT * FROM matched UNION ALL SELECT * FROM free) GROUP BY ALL)
  QUALIFY rank <= {catalog.TOP_K})"""

# Cells around the labels' means; a question searches the three nearest.
MEAN_CELLS = f"""near AS (
  SELECT v.chunk_id, v.embedding, m.query_id AS cell
  FROM vectors v CROSS JOIN means m
  QUALIFY row_number() OVER (PARTITION BY chunk_id
    ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), m.embedding) DESC, m.query_id) = 1),
probes AS (
  SELECT q.query_id, m.query_id AS cell FROM means q CROSS JOIN means m
  QUALIFY row_number() OVER (PARTITION BY q.query_id
    ORDER BY list_cosine_similarity(q.embedding, m.embedding) DESC, m.query_id) <= 3),
probed AS (
  SELECT query_id, chunk_id, distance,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
  FROM (SELECT p.query_id, n.chunk_id,
          round(list_cosine_distance(CAST(n.embedding AS DOUBLE[]), q.embedding), 9) AS distance
        FROM probes p JOIN near n USING (cell) JOIN means q USING (query_id))
  QUALIFY rank <= {catalog.TOP_K})"""

WIDTH = catalog.DIM // catalog.PARTS


def unit(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / sqrt(list_inner_product({vector}, {vector})))"


# The search by codes: cells, what is left of the vectors in parts, entries, codes, tables, rerank.
QUANTIZED = f"""cells AS MATERIALIZED (
  SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS cell, {unit("embedding")} AS centre FROM means),
units AS MATERIALIZED (
  SELECT chunk_id, {unit("v")} AS v FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM vectors)),
housed AS MATERIALIZED (
  SELECT chunk_id, v, cell, centre FROM units CROSS JOIN cells
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY list_inner_product(v, centre) DESC, cell) = 1),
left_over AS MATERIALIZED (
  SELECT chunk_id, cell, part, left_[part * {WIDTH} + 1 : (part + 1) * {WIDTH}] AS sub
  FROM (SELECT chunk_id, cell, list_transform(list_zip(v, centre), lambda z: z[1] - z[2]) AS left_,
          unnest(range(0, {catalog.PARTS})) AS part FROM housed)),
entries AS MATERIALIZED (
  SELECT part, sub, row_number() OVER (PARTITION BY part ORDER BY chunk_id) - 1 AS code
  FROM left_over WHERE chunk_id < {catalog.ENTRIES}),
coded AS MATERIALIZED (
  SELECT l.chunk_id, l.cell, l.part, e.code FROM left_over l JOIN entries e USING (part)
  QUALIFY row_number() OVER (PARTITION BY l.chunk_id, l.part ORDER BY list_distance(l.sub, e.sub), e.code) = 1),
inner_products AS MATERIALIZED (
  SELECT q.query_id, e.part, e.code,
    list_inner_product(q.centre[e.part * {WIDTH} + 1 : (e.part + 1) * {WIDTH}], e.sub) AS value
  FROM cells q CROSS JOIN entries e),
probed_cells AS (
  SELECT q.query_id, c.cell, list_inner_product(q.centre, c.centre) AS value FROM cells q CROSS JOIN cells c
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY value DESC, c.cell) <= {catalog.PROBES}),
close AS (
  SELECT p.query_id, c.chunk_id, round(1 - (any_value(p.value) + sum(t.value)), 9) AS distance
  FROM probed_cells p JOIN coded c USING (cell)
  JOIN inner_products t ON t.query_id = p.query_id AND t.part = c.part AND t.code = c.code
  GROUP BY p.query_id, c.chunk_id
  QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY distance, c.chunk_id) <= {catalog.DEPTH}),
probed AS (
  SELECT query_id, chunk_id, distance,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
  FROM (SELECT c.query_id, c.chunk_id,
          round(list_cosine_distance(CAST(v.embedding AS DOUBLE[]), q.embedding), 9) AS distance
        FROM close c JOIN vectors v USING (chunk_id) JOIN means q USING (query_id))
  QUALIFY rank <= {catalog.TOP_K})"""

EVENTS = f"""mapped AS (
  SELECT CASE WHEN event_type = 'purchase' THEN {quoted(OBJECT_FINALIZED)}
              WHEN event_type <> 'view' THEN event_type END AS ce_type,
    lpad(CAST(event_id AS VARCHAR), 12, '0') AS ce_id,
    CASE WHEN value >= 30 THEN 'other' WHEN value >= 1 THEN 'raw' ELSE '' END AS bucket,
    user_id || CASE WHEN k < 50 THEN '.PDF' WHEN k < 80 THEN '.pdf' ELSE '.txt' END AS name, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
judged AS (
  SELECT *,
    CASE WHEN ce_type IS NOT NULL AND ce_type <> '' AND ce_type <> {quoted(OBJECT_FINALIZED)}
           THEN 'unsupported ce-type ' || ce_type
         WHEN bucket = '' OR name = '' THEN 'missing bucket or name'
         WHEN bucket <> 'raw' THEN 'wrong bucket'
         WHEN lower(name) NOT LIKE '%.pdf' THEN 'not a pdf' END AS reason
  FROM mapped)"""

REPLACED = with_(DOCS, LABELLED, CHUNKS, stride_chunks("revised", "labelled"))

STORED_EVENTS = f"""log AS (
  SELECT id AS document_id, gcs_uri, 'started' AS event_type, CAST(NULL AS VARCHAR) AS message,
    '{{"num_pages":' || num_pages || '}}' AS payload, {quoted(catalog.INGESTED)} AS created_at FROM stored
  UNION ALL
  SELECT id, gcs_uri, 'completed', NULL, '{{}}', {quoted(catalog.INGESTED)} FROM stored WHERE error IS NULL
  UNION ALL
  SELECT id, gcs_uri, 'failed', error, '{{}}', {quoted(catalog.INGESTED)} FROM stored WHERE error IS NOT NULL)"""

STREAMED = f"""uploads AS (
  SELECT document_id, gcs_uri, bucket, name, content, {quoted(catalog.UPLOADED)} AS sent FROM docs
  UNION ALL
  SELECT document_id, gcs_uri, bucket, name, content, {quoted(catalog.REUPLOADED)} FROM labelled),
last_upload AS (SELECT * FROM uploads QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sent DESC) = 1),
page_texts AS (
  SELECT document_id, sent, unnest(string_split(content, chr(10))) AS page FROM uploads),
with_text AS (
  SELECT document_id, sent, count(*) AS n FROM page_texts WHERE {stripped("page")} <> '' GROUP BY ALL)"""

# What a store holds after both waves of uploads.
CURRENT = """current AS (
  SELECT d.document_id, d.gcs_uri, d.name, coalesce(l.content, d.content) AS content
  FROM docs d LEFT JOIN labelled l USING (document_id))"""
INGESTED = f"""stored AS (
  SELECT document_id AS id, gcs_uri, name AS filename,
    CASE WHEN {stripped("content")} = '' THEN 'failed' ELSE 'completed' END AS status FROM current)"""
AFTER_INGEST = (LABELLED, CURRENT, stride_chunks("chunks", "current"), INGESTED)


# Both waves as they were written, and the columns of each stored table, by name.
WRITTEN = """uploads AS (
  SELECT document_id, content FROM docs UNION ALL SELECT document_id, content FROM labelled)"""
STORED_COLUMNS = {
    "chunks": "chunk_index,content,created_at,document_id,embedding,id,metadata,n_chars,page_number",
    "documents": "chunks_attempt,content_hash,deleted,error,filename,gcs_uri,id,metadata,num_pages,processed_at,"
    "size_bytes,source_time,status,uploaded_at",
    "events": "created_at,document_id,event_type,gcs_uri,id,message,payload",
    "postings": "chunk_id,document_id,pos,term",
    "rejected": "bucket,ce_id,ce_subject,ce_type,event_time,name,reason,verdict",
    "texts": "document_id,target_name,text",
}
STORED_COUNTS = {
    "chunks": "SELECT count(*) FROM written",
    "documents": "SELECT count(*) FROM uploads",
    "events": "SELECT 2 * count(*) FROM uploads",
    "postings": "SELECT count(*) FROM posts",
    "rejected": "SELECT count(*) FROM uploads WHERE document_id IS NULL",
    "texts": f"SELECT count(*) FROM uploads WHERE {stripped('content')} <> ''",
}


_K = catalog.KEYWORD_QUESTIONS
_RANKED = fixed_questions(*_K.values(), catalog.QUESTION)
_MATCHED = "SELECT query_id, chunk_id FROM matched"
_SCORED = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM keyword_leg"
_STORED = with_(DOCS, STORED)
_FOUND = """SELECT query_id, chunk_id, document_id, filename, gcs_uri, page_number, content,
  rrf_score, vector_rank, keyword_rank FROM found"""
_ANSWERED = f""", answered AS (
SELECT q.query_id,
  'CONTEXT:' || chr(10) || c.context || chr(10) || chr(10) || 'QUESTION: ' || q.question
    || chr(10) || chr(10) || {quoted(INSTRUCTION)} AS prompt,
  CASE WHEN c.context IS NULL THEN {quoted(NO_CONTEXT_REPLY)} END AS reply,
  '[' || coalesce(c.cited, '') || ']' AS citations
FROM questions q LEFT JOIN (
  SELECT query_id,
    string_agg('[' || n || '] ' || filename || ' (' || coalesce('p.' || page_number, 'p.?') || ')' || chr(10)
      || {stripped("content")}, {quoted(CONTEXT_BREAK)} ORDER BY n) AS context,
    string_agg('{{"n":' || n || ',"chunk_id":"' || chunk_id || '","document_id":"' || document_id
      || '","filename":"' || filename || '","gcs_uri":"' || gcs_uri || '","page_number":' || page_number
      || ',"rrf_score":' || rrf_score || coalesce(',"vector_rank":' || vector_rank, '')
      || coalesce(',"keyword_rank":' || keyword_rank, '') || '}}', ',' ORDER BY n) AS cited
  FROM found GROUP BY query_id) c USING (query_id))
"""
_VECTORS_ALL = vector_search(LABEL_MEANS)

ORACLES = {
    "filter_events": with_(EVENTS)
    + """SELECT ce_id, bucket, name,
  CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'missing bucket or name' THEN 'malformed'
       ELSE 'skipped' END AS verdict, reason FROM judged""",
    "latest_event_per_uri": with_(EVENTS)
    + """SELECT 'gs://' || bucket || '/' || name AS gcs_uri, ce_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time
FROM judged WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY bucket, name ORDER BY ts DESC, ce_id DESC) = 1""",
    "document_history": with_(EVENTS)
    + """SELECT 'gs://' || bucket || '/' || name AS gcs_uri, ce_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from,
  strftime(lead(ts) OVER (PARTITION BY bucket, name ORDER BY ts, ce_id), '%Y-%m-%d %H:%M:%S') AS valid_to
FROM judged WHERE reason IS NULL""",
    "documents_as_of": with_(
        EVENTS,
        """versions AS (
  SELECT 'gs://' || bucket || '/' || name AS gcs_uri, ts, max(ce_id) AS ce_id
  FROM judged WHERE reason IS NULL GROUP BY ALL)""",
    )
    + """SELECT e.event_id, e.gcs_uri, v.ce_id, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS valid_from
FROM (SELECT event_id, ts, 'gs://raw/' || user_id || '.pdf' AS gcs_uri FROM events) e
ASOF LEFT JOIN versions v ON e.gcs_uri = v.gcs_uri AND e.ts >= v.ts""",
    "parse_uri": with_(DOCS)
    + """SELECT uri, regexp_extract(uri, '^gs://([^/]*)/(.*)$', 1) AS bucket,
  regexp_extract(uri, '^gs://([^/]*)/(.*)$', 2) AS name,
  CASE WHEN NOT starts_with(uri, 'gs://') THEN 'not a gs:// uri'
       WHEN NOT regexp_matches(uri, '^gs://([^/]*)/(.*)$') THEN 'missing object name' END AS problem
FROM (SELECT gcs_uri AS uri FROM docs UNION ALL SELECT url FROM pages)""",
    "object_names": with_(DOCS)
    + f"""SELECT name, regexp_extract(name, '[^/]*$') AS filename,
  regexp_replace(name, {quoted(STEM_AND_EXTENSION)}, '\\1\\2') || '.txt' AS target_name,
  'gs://raw/' || name AS gcs_uri
FROM (SELECT source || '/' || lang || '/' || name AS name FROM docs UNION ALL SELECT url FROM pages)""",
    "content_hash": with_(DOCS)
    + """SELECT document_id, sha256(content) AS content_hash,
  CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes FROM docs""",
    "dedupe_by_hash": with_(DOCS)
    + """SELECT content_hash, n_copies, id, 'gs://' || source || '/' || id || '.pdf' AS gcs_uri
FROM (SELECT sha256(content) AS content_hash, doc_id AS id, source,
        count(*) OVER (PARTITION BY sha256(content)) AS n_copies,
        row_number() OVER (PARTITION BY sha256(content) ORDER BY doc_id) AS rn FROM docs)
WHERE rn = 1""",
    "split_pages": with_(DOCS, LINES) + "SELECT document_id, page_number, text FROM lines WHERE text <> ''",
    "split_pages_sql": with_(DOCS, LINES) + "SELECT document_id, page_number, text FROM lines WHERE text <> ''",
    "chunk_recursive": recursive_(DOCS, RECURSIVE) + "SELECT * FROM recursive_chunks",
    "chunk_recursive_sql": recursive_(DOCS, RECURSIVE) + "SELECT * FROM recursive_chunks",
    "chunk_lookup": with_(DOCS, CHUNKS)
    + """SELECT chunk_id, document_id, CAST(length(content) AS INTEGER) AS n_chars FROM chunks
WHERE chunk_index = 0 AND document_id IN (SELECT document_id FROM docs WHERE doc_id < 8)""",
    "metadata_paths": with_(DOCS, LABELLED, STORED, BATCH, STORED_EVENTS)
    + """SELECT 'documents' AS kind, json_extract_string(metadata, '$.raw_bucket') AS name, count(*) AS n FROM batch
WHERE json_extract_string(metadata, '$.raw_object') LIKE '%.pdf' GROUP BY name
UNION ALL
SELECT 'pages', split_part(gcs_uri, '/', 3), CAST(sum(n) AS BIGINT)
FROM (SELECT gcs_uri, CAST(json_extract_string(payload, '$.num_pages') AS INTEGER) AS n FROM log WHERE event_type = 'started')
WHERE n > 1 GROUP BY ALL
UNION ALL
SELECT 'keys', key, count(*) FROM (SELECT unnest(json_keys(metadata)) AS key FROM batch) GROUP BY key""",
    "page_counts": with_(DOCS, LINES)
    + """SELECT document_id, CAST(count(*) AS INTEGER) AS num_pages,
  CAST(count(*) FILTER (text <> '') AS INTEGER) AS n_pages_with_text FROM lines GROUP BY document_id""",
    "processed_text": with_(DOCS, LINES)
    + """SELECT left(name, length(name) - 4) || '.txt' AS target_name,
  coalesce(string_agg('[page ' || page_number || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number)
    FILTER (text <> ''), '') AS text FROM lines GROUP BY document_id, name""",
    "chunk_stride": with_(DOCS, CHUNKS)
    + """SELECT document_id, chunk_index, page_number, content, chunk_id,
  CAST(length(content) AS INTEGER) AS n_chars FROM chunks""",
    "chunk_index": with_(DOCS, LINES)
    + f"""SELECT document_id, page_number,
  CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, i) - 1 AS INTEGER) AS chunk_index, content
FROM (SELECT document_id, page_number, i, {stripped("substr(text, i * 170 + 1, 200)")} AS content
      FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 30) / 170.0) AS BIGINT)))) AS i
            FROM lines WHERE text <> ''))
WHERE content <> ''""",
    "prepare_errors": with_(DOCS)
    + f"""SELECT gcs_uri, n > 0 AS is_document, CAST(n AS BIGINT) AS n_bytes,
  CASE WHEN n = 0 THEN 'empty object' WHEN {stripped("content")} = '' THEN 'no extractable text' END AS error,
  {stripped("content")} <> '' AS has_chunks
FROM (SELECT gcs_uri, content, octet_length(encode(content)) AS n FROM (
  SELECT gcs_uri, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || ' ' || chr(10) ELSE content END AS content FROM docs))""",
    "embed_model": with_(DOCS, CHUNKS)
    + "SELECT chunk_id, CAST(length(content) AS INTEGER) AS n_chars, true AS in_batch FROM chunks",
    "constant_vectors": with_(DOCS)
    + f"SELECT document_id, true AS fits, false AS fits_other, sqrt({catalog.DIM} * 0.25::DOUBLE) AS length FROM docs",
    "embed_hashed": with_(DOCS, CHUNKS, postings("posts", "chunks"), hashed("vectors", "posts", "chunk_id", catalog.DIM))
    + """SELECT chunk_id, CAST(bucket - 1 AS INTEGER) AS bucket, round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT chunk_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS bucket FROM vectors)
WHERE value > 0""",
    "vector_topk": vector_search(ALL_MEAN),
    "vector_topk_batch": _VECTORS_ALL,
    "vector_topk_ivf_all": _VECTORS_ALL,
    "vector_topk_means": with_(VECTORS, LABEL_MEANS, MEAN_CELLS)
    + "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM probed",
    "recall_means": with_(VECTORS, LABEL_MEANS, MEAN_CELLS, nearest("exact", "vectors", "means", catalog.TOP_K))
    + """SELECT query_id, count(p.chunk_id) / count(*) AS recall
FROM exact e LEFT JOIN probed p USING (query_id, chunk_id) GROUP BY query_id""",
    "vector_topk_quantized": with_(VECTORS, LABEL_MEANS, QUANTIZED)
    + "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM probed",
    "recall_quantized": with_(VECTORS, LABEL_MEANS, QUANTIZED, nearest("exact", "vectors", "means", catalog.TOP_K))
    + """SELECT query_id, count(p.chunk_id) / count(*) AS recall
FROM exact e LEFT JOIN probed p USING (query_id, chunk_id) GROUP BY query_id""",
    "cosine_to_mean": with_(VECTORS, LABEL_MEANS)
    + """SELECT chunk_id, query_id,
  round(list_cosine_distance(CAST(v.embedding AS DOUBLE[]), m.embedding), 6) AS distance
FROM vectors v JOIN means m ON m.query_id = 'label-' || v.label""",
    "postings": with_(DOCS, CHUNKS, postings("posts", "chunks")) + "SELECT term, chunk_id, pos FROM posts",
    "query_clauses": with_(BENCHMARK_QUESTIONS, clauses("questions"))
    + """SELECT query_id, grp, clause, negated, CAST(n_terms AS INTEGER) AS n_terms,
  CAST(n_group AS INTEGER) AS n_group,
  CAST(n_required AS INTEGER) AS n_required, CAST(n_slots AS INTEGER) AS n_slots, "offset", c.term,
  CASE WHEN negated THEN -1 ELSE s.slot END AS slot
FROM clauses c LEFT JOIN (
  SELECT query_id, grp, term,
    CAST(row_number() OVER (PARTITION BY query_id, grp ORDER BY first_at) - 1 AS INTEGER) AS slot
  FROM (SELECT query_id, grp, term, min(clause * 10000 + "offset") AS first_at
        FROM clause_terms WHERE NOT negated GROUP BY query_id, grp, term)) s USING (query_id, grp, term)""",
    **{key: keyword(_MATCHED, fixed_questions(question)) for key, question in _K.items()},
    "keyword_only_not": with_(
        DOCS, CHUNKS, postings("posts", "chunks"), fixed_questions(*catalog.EXCLUDING), clauses("questions"),
        MATCH, ONLY_NOT,
    )
    + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM leg",
    "keyword_rank": keyword("SELECT query_id, chunk_id, round(score, 6) AS score FROM matched", _RANKED),
    "keyword_topk": keyword(_SCORED, _RANKED),
    "keyword_batch": keyword(_SCORED, BENCHMARK_QUESTIONS),
    "keyword_bitmaps": keyword(
        "SELECT query_id, chunk_id, round(score, 6) AS score FROM matched", fixed_questions(*catalog.FREQUENT_QUESTIONS)
    ),
    "keyword_topk_bounded": keyword(_SCORED, _RANKED),
    "keyword_batch_bounded": keyword(_SCORED, BENCHMARK_QUESTIONS),
    "rrf_fuse": """WITH l AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents QUALIFY rank <= 20),
n AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank
  FROM documents QUALIFY rank <= 20)
SELECT source AS query_id, doc_id AS chunk_id,
  round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.rank), 0), 9) AS rrf_score,
  CAST(l.rank AS INTEGER) AS vector_rank, CAST(n.rank AS INTEGER) AS keyword_rank
FROM l FULL JOIN n USING (source, doc_id)""",
    "hybrid_retrieve": hybrid(_FOUND, fixed_questions(catalog.QUESTION)),
    "hybrid_batch": hybrid(_FOUND, BENCHMARK_QUESTIONS),
    "hybrid_batch_cells": hybrid(_FOUND, BENCHMARK_QUESTIONS),
    "citations": hybrid(
        """SELECT query_id, chunk_id, document_id, filename, gcs_uri, page_number,
  rrf_score, vector_rank, keyword_rank, n FROM found""",
        BENCHMARK_QUESTIONS,
    ),
    "context_prompt": hybrid(
        f"""SELECT q.query_id, q.question, CAST(coalesce(c.n, 0) AS INTEGER) AS n_context,
  'CONTEXT:' || chr(10) || c.context || chr(10) || chr(10) || 'QUESTION: ' || q.question
    || chr(10) || chr(10) || {quoted(INSTRUCTION)} AS prompt,
  CASE WHEN c.context IS NULL THEN {quoted(NO_CONTEXT_REPLY)} END AS reply
FROM questions q LEFT JOIN (
  SELECT query_id, count(*) AS n,
    string_agg('[' || n || '] ' || filename || ' (' || coalesce('p.' || page_number, 'p.?') || ')' || chr(10)
      || {stripped("content")}, {quoted(CONTEXT_BREAK)} ORDER BY n) AS context
  FROM found GROUP BY query_id) c USING (query_id)""",
        BENCHMARK_QUESTIONS,
    ),
    "answer_json": hybrid(_ANSWERED + "SELECT query_id, prompt, reply, citations FROM answered", BENCHMARK_QUESTIONS),
    "streamed_answers": hybrid(
        _ANSWERED
        + """SELECT query_id, coalesce(reply, length(prompt) || ' characters') AS answer, citations,
  true AS timing_adds_up FROM answered""",
        BENCHMARK_QUESTIONS,
        *AFTER_INGEST,
    ),
    "valid_questions": f"""SELECT conv_id || '-' || turn AS query_id,
  CASE WHEN coalesce(length(text), 0) < 1 THEN 'question is empty'
       WHEN length(text) > {MAX_QUESTION} THEN 'question is too long'
       WHEN {stripped("text")} = '' THEN 'empty query' END AS problem
FROM conversations""",
    "upsert_documents": with_(DOCS, LABELLED, STORED, BATCH, UPSERTED) + "SELECT * FROM upserted",
    "replace_chunks": REPLACED
    + """SELECT document_id, chunk_index, page_number, content, chunk_id FROM chunks
WHERE document_id NOT IN (SELECT document_id FROM labelled)
UNION ALL SELECT document_id, chunk_index, page_number, content, chunk_id FROM revised""",
    "status_transition": with_(DOCS, LABELLED, STORED)
    + f"""SELECT s.* REPLACE (
  CASE WHEN l.document_id IS NULL THEN s.status WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN l.document_id IS NULL THEN s.error WHEN l.toxic = 1 THEN 'rejected content' END AS error,
  CASE WHEN l.document_id IS NULL THEN s.processed_at ELSE {quoted(catalog.REUPLOADED)} END AS processed_at)
FROM stored s LEFT JOIN labelled l ON l.document_id = s.id""",
    "cascade_delete": with_(DOCS, LABELLED, STORED, CHUNKS, STORED_EVENTS)
    + """SELECT * FROM (
  SELECT 'documents' AS "table", id AS document_id, count(*) AS n FROM stored GROUP BY ALL
  UNION ALL SELECT 'chunks', document_id, count(*) FROM chunks GROUP BY ALL
  UNION ALL SELECT 'events', document_id, count(*) FROM log GROUP BY ALL)
WHERE document_id NOT IN (SELECT document_id FROM labelled WHERE toxic = 1)""",
    "event_log": with_(DOCS, STORED, STORED_EVENTS) + "SELECT * FROM log",
    "recent_documents": with_(DOCS, LABELLED, STORED, BATCH, UPSERTED)
    + "SELECT id, filename, status, uploaded_at FROM upserted ORDER BY uploaded_at DESC, id LIMIT 5",
    "zip_vectors": REPLACED
    + """SELECT document_id, count(c.chunk_index) AS n_chunks, count(r.chunk_index) AS n_vectors,
  bool_and(c.chunk_index IS NOT NULL AND r.chunk_index IS NOT NULL) AS complete
FROM chunks c FULL JOIN revised r USING (document_id, chunk_index) GROUP BY document_id""",
    "bad_vectors": f"""SELECT chunk_id, width FROM (
  SELECT vec_id AS chunk_id, CAST(len(list_filter(embedding, lambda x: x > -0.2)) AS INTEGER) AS width FROM embeddings)
WHERE width <> {catalog.DIM}""",
    "bad_status": """SELECT event_id AS id, event_type AS status FROM events
WHERE event_type NOT IN ('error', 'purchase')""",
    "duplicate_keys": """SELECT sha256(text) AS content_hash, count(*) AS n FROM documents
GROUP BY ALL HAVING count(*) > 1""",
    "orphan_chunks": with_(DOCS, LABELLED, CHUNKS)
    + """SELECT document_id, chunk_index FROM chunks
WHERE document_id NOT IN (SELECT document_id FROM labelled)""",
    "by_status": _STORED + "SELECT id, gcs_uri, error FROM stored WHERE status = 'failed'",
    "hybrid_stored": hybrid(_FOUND, BENCHMARK_QUESTIONS, *AFTER_INGEST),
    "reingest_changes": with_(
        DOCS,
        """again AS (
  SELECT d.* EXCLUDE (content), CASE WHEN l.toxic = 1 THEN 'Revised.' || chr(10) || d.content
    WHEN l.quality = 1 THEN d.content || chr(10) || 'Revised.' ELSE d.content END AS content
  FROM docs d JOIN labels l USING (doc_id))""",
        stride_chunks("before", "docs"),
        stride_chunks("fresh", "again"),
    )
    + """SELECT document_id, count(*) FILTER (state = 'kept') AS n_kept, count(*) FILTER (state = 'moved') AS n_moved,
  count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'gone') AS n_gone
FROM (
  SELECT f.document_id, CASE WHEN b.content = f.content THEN 'kept'
    WHEN EXISTS (SELECT 1 FROM before x WHERE x.document_id = f.document_id AND x.content = f.content) THEN 'moved'
    ELSE 'new' END AS state
  FROM fresh f LEFT JOIN before b USING (document_id, chunk_index)
  UNION ALL
  SELECT document_id, 'gone' FROM before b WHERE document_id IN (SELECT document_id FROM again)
    AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.document_id = b.document_id AND f.content = b.content))
GROUP BY document_id""",
    "object_retries": with_(DOCS)
    + """SELECT gcs_uri, CASE WHEN n % 11 = 7 THEN 'dead' ELSE 'done' END AS verdict,
  CAST(CASE WHEN n % 11 = 7 THEN 4 WHEN n % 5 = 2 THEN n % 3 + 2 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN n % 11 = 7 THEN n || ' characters at attempt 4' END AS error
FROM (SELECT gcs_uri, coalesce(length(content), 0) AS n FROM docs)""",
    "stored_tables": with_(
        DOCS, LABELLED, CHUNKS, stride_chunks("revised", "labelled"), WRITTEN,
        "written AS (SELECT * FROM chunks UNION ALL SELECT * FROM revised)", postings("posts", "written"),
    )
    + " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{columns}' AS columns, ({STORED_COUNTS[table]}) AS n_rows"""
        for table, columns in STORED_COLUMNS.items()
    ),
    "chunks_of_documents": with_(DOCS, *AFTER_INGEST)
    + """SELECT document_id, count(*) AS n_chunks, 4 AS n_events
FROM chunks WHERE document_id IN (SELECT document_id FROM labelled) GROUP BY document_id""",
    "stream_ingest": with_(DOCS, LABELLED, STREAMED)
    + f"""SELECT u.document_id AS id, u.gcs_uri, u.name AS filename, sha256(u.content) AS content_hash,
  CAST(len(string_split(u.content, chr(10))) AS INTEGER) AS num_pages,
  CASE WHEN t.n IS NULL THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN t.n IS NULL THEN {quoted(NO_TEXT)} END AS error,
  '{{"raw_bucket":"' || u.bucket || '","raw_object":"' || u.name || '"}}' AS metadata,
  u.sent AS source_time,
  (SELECT count(*) FROM uploads a WHERE a.document_id = u.document_id) AS n_started,
  (SELECT count(*) FROM with_text a WHERE a.document_id = u.document_id) AS n_completed,
  t.n AS n_pages_with_chunks
FROM last_upload u LEFT JOIN with_text t USING (document_id, sent)""",
}
