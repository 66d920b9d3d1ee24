"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from sheaf.llm import (
    decontaminate,
    language_id,
    lexical_search,
    merkle_manifest,
    rank_bpe,
    secret_scan,
    sentence_spans,
    simhash_neardup,
    site_lines,
    source_mix,
    token_blocks,
    topk_voronoi,
    toxicity_mil,
)
from sheaf.llm.common import documents


def op1_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op3_simhash_neardup(spark, sf_dir):
    return simhash_neardup.near_duplicates(documents(spark, sf_dir))


def op4_token_blocks(spark, sf_dir):
    return token_blocks.encode_corpus(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_source_mix(spark, sf_dir):
    return source_mix.mix(documents(spark, sf_dir))


def op8_topk_voronoi(spark, sf_dir):
    return topk_voronoi.search_embeddings(spark, sf_dir)


def op6_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(spark, sf_dir)


def op5_toxicity_mil(spark, sf_dir):
    return toxicity_mil.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


def op2_site_lines(spark, sf_dir):
    return site_lines.clean_pages(spark, sf_dir)


def op7_sentence_spans(spark, sf_dir):
    return sentence_spans.dedupe(documents(spark, sf_dir))


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.manifest(documents(spark, sf_dir), merkle_manifest.tampered_leaf())


def op12_lexical_search(spark, sf_dir):
    return lexical_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_rank_bpe(spark, sf_dir):
    return rank_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_site_lines": op2_site_lines,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_token_blocks": op4_token_blocks,
    "op5_toxicity_mil": op5_toxicity_mil,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_topk_voronoi": op8_topk_voronoi,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mix": op10_source_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_rank_bpe": op13_rank_bpe,
}

RULE_SPANS = """
            SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(hit) AS e FROM (
                SELECT doc_id, hits[i] AS hit, groups[i] AS part,
                    list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT
                    + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
                FROM (
                    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, groups, pieces FROM (
                        SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits,
                            regexp_extract_all(text, '{pattern}', {group}) AS groups,
                            regexp_split_to_array(text, '{pattern}') AS pieces
                        FROM documents WHERE regexp_matches(text, '{pattern}')
                    )
                )
            ) WHERE length(part) >= {least}
"""
RULES_SQL = " UNION ALL ".join(
    RULE_SPANS.format(
        rank=rank, kind=rule.kind, pattern=rule.pattern.replace("'", "''"), group=rule.group, least=rule.least
    )
    for rank, rule in enumerate(secret_scan.RULES)
)

LEAF_SQL = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    for c in ("doc_id", "source", "lang", "{n_chars}", "text")
) + ")"
CRC_SQL = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ord(c)::BIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""
TERMS_SQL = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
# One level up: pairs of a tree's nodes, and the way of each row along its siblings.
UP_SQL = """SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {nodes}
            WHERE n > 1 GROUP BY tree, level, idx // 2, n"""
WALK_SQL = """SELECT w.id, w.tree, w.level + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN s.digest IS NULL THEN w.digest
                WHEN w.idx % 2 = 1 THEN s.digest || w.digest ELSE w.digest || s.digest END), w.proof || coalesce(s.digest, '')
            FROM {walk} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.idx, 1)
            WHERE w.n > 1"""

ORACLES = {
    "op12_lexical_search": f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS terms FROM documents
        ), totals AS (
            SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM docs
        ), asked AS MATERIALIZED (
            SELECT item, item_id, term, count(*) AS repeats FROM (
                SELECT item, item_id, unnest(terms) AS term
                FROM (SELECT row_number() OVER () AS item, item_id, {TERMS_SQL} AS terms FROM benchmark)
            ) GROUP BY ALL
        ), posted AS MATERIALIZED (
            SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), totals
        ), scored AS (
            SELECT item, item_id, r, doc_id, sum(repeats * w
                * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * all_docs) // all_terms)))))::BIGINT AS score
            FROM posted JOIN asked USING (term) JOIN weights USING (term), totals GROUP BY item, item_id, r, doc_id
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree,
                {LEAF_SQL.format(n_chars="n_chars")} AS leaf,
                CASE WHEN {CRC_SQL} % 7 = 0 THEN {LEAF_SQL.format(n_chars="(n_chars + 1)")}
                    ELSE {LEAF_SQL.format(n_chars="n_chars")} END AS claimed
            FROM documents
        ), placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                count(*) OVER (PARTITION BY tree) AS n
            FROM leaves
        ), nodes(tree, level, idx, n, digest) AS (
            SELECT tree, 0, idx, n, leaf FROM placed UNION ALL {UP_SQL.format(nodes="nodes")}
        ), subroots AS MATERIALIZED (
            SELECT tree AS of, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
        ), tops(tree, level, idx, n, digest) AS (
            SELECT '', 0, idx, n, digest FROM subroots UNION ALL {UP_SQL.format(nodes="tops")}
        ), walk(id, tree, level, idx, n, digest, proof) AS (
            SELECT id, tree, 0, idx, n, claimed, '' FROM placed UNION ALL {WALK_SQL.format(walk="walk", nodes="nodes")}
        ), last(id, tree, level, idx, n, digest, proof) AS (
            SELECT w.id, '', 0, s.idx, s.n, w.digest, w.proof FROM walk w JOIN subroots s ON s.of = w.tree WHERE w.n = 1
            UNION ALL {WALK_SQL.format(walk="last", nodes="tops")}
        )
        SELECT doc_id, leaf, subroots.digest AS subroot, tops.digest AS root, sha256(proof) AS proof_sha256,
            last.digest AS folded_root, last.digest = tops.digest AS verified
        FROM placed JOIN last USING (id) JOIN subroots ON subroots.of = placed.tree JOIN tops ON tops.n = 1
        WHERE last.n = 1
    """,
    "op2_site_lines": f"""
        WITH split AS (
            SELECT page_id, nullif(lower(regexp_extract(url, '{site_lines.HOST}', 1)), '') AS host,
                list_filter(list_transform(string_split(coalesce(regexp_replace(regexp_replace(regexp_replace(
                    html, '{site_lines.HIDDEN}', '', 'g'), '{site_lines.BLOCKS}', chr(10), 'g'), '{site_lines.TAGS}',
                    '', 'g'), ''), chr(10)), lambda l: regexp_replace(l, '{site_lines.EDGES}', '', 'g')),
                    lambda l: l <> '') AS lines
            FROM pages
        ), seen AS (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM split WHERE host IS NOT NULL),
        totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
        boilerplate AS (
            SELECT host, line FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY ALL) JOIN totals USING (host)
            WHERE n >= 3 AND n > 0.3::DOUBLE * pages
        ), gone AS (
            SELECT page_id, list(line) AS gone FROM seen JOIN boilerplate USING (host, line) GROUP BY page_id
        ), kept AS (
            SELECT page_id, host, lines, list_filter(lines, lambda l: NOT list_contains(coalesce(gone, []), l)) AS kept
            FROM split LEFT JOIN gone USING (page_id)
        )
        SELECT page_id, host, len(lines)::INTEGER AS n_lines, (len(lines) - len(kept))::INTEGER AS n_dropped,
            coalesce(array_to_string(kept, chr(10)), '') AS text
        FROM kept
    """,
    "op9_secret_scan": f"""
        WITH found AS ({RULES_SQL}),
        per AS (
            SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
                count(*) FILTER (rank = 2) AS n_hex,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
            FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
            coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN per USING (doc_id)
    """,
    "op8_topk_voronoi": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), ranked AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM ranked
        )
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
    """,
}
