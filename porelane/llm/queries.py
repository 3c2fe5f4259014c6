"""The registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media

    return media(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import digest, substring_dedup

    return digest(substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toolcalls import conversation_links

    return conversation_links(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_media_chunks, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_substring_dedup, op6_merge_dropout, op7_tool_calls, op8_license_scan, op9_best_fit_packing, op10_lm_scoring, pipeline)
}

ORACLES: dict[str, str] = {
    "op8_license_scan": licenses.oracle(),
    "op7_tool_calls": """
        WITH RECURSIVE said AS (
            SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id,
                   ['calculate', 'lookup', 'search'][1 + turn % 3] AS name,
                   len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::INTEGER AS words
            FROM conversations WHERE role = 'assistant'
        ), ids AS (SELECT DISTINCT conv_id, turn FROM said),
        chain AS (
            SELECT conv_id, turn, 0::BIGINT AS level FROM ids a
            WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
            UNION ALL
            SELECT ids.conv_id, ids.turn, level + 1 FROM chain JOIN ids ON ids.conv_id = chain.conv_id AND ids.turn = chain.turn + 2
        ), answers AS (
            SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM conversations WHERE role = 'user' GROUP BY ALL
        ), limits(name, chars, most) AS (VALUES ('calculate', 400, 80), ('lookup', 200, 40), ('search', 300, 60)),
        judged AS (
            SELECT s.*, level, content, a.turn IS NOT NULL AS answered,
                   CASE WHEN level > 0 THEN s.conv_id || ':' || (s.turn - 2) END AS after,
                   list_filter([CASE WHEN length(text) < 1 THEN 'text: length below 1' END, CASE WHEN length(text) > chars THEN 'text: length above ' || chars END,
                                CASE WHEN words < 1 THEN 'words: value below 1' END, CASE WHEN words > most THEN 'words: value above ' || most END], lambda x: x IS NOT NULL) AS problems
            FROM said s JOIN chain USING (conv_id, turn) JOIN limits USING (name) LEFT JOIN answers a USING (conv_id, turn)
        )
        SELECT conv_id, turn, call_id, name, after, level, CASE WHEN answered THEN 'ok' ELSE 'no result' END AS status,
               array_to_string(problems, '; ') AS errors,
               '{' || CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json(after) || ',' END
                   || '"arguments":{"text":' || to_json(text) || ',"words":' || words || '},"errors":' || to_json(problems) || ',"id":' || to_json(call_id)
                   || ',"level":' || level || ',"name":' || to_json(name) || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END
                   || ',"status":' || to_json(CASE WHEN answered THEN 'ok' ELSE 'no result' END) || '}' AS json
        FROM judged
        UNION ALL
        SELECT NULL, NULL, call_id, NULL, NULL, NULL, status, NULL,
               '{"count":' || n || ',"id":' || to_json(call_id) || CASE WHEN text IS NULL THEN '' ELSE ',"result":' || to_json(text) END || ',"status":' || to_json(status) || '}'
        FROM (
            SELECT conv_id || ':' || (turn - 1) AS call_id, text, CASE WHEN called THEN 'repeated result' ELSE 'orphan result' END AS status,
                   copies - CASE WHEN called AND place = 1 THEN 1 ELSE 0 END AS n
            FROM (
                SELECT u.conv_id, u.turn, u.text, ids.turn IS NOT NULL AS called, count(*) AS copies, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY u.text NULLS LAST) AS place
                FROM conversations u LEFT JOIN ids ON ids.conv_id = u.conv_id AND ids.turn = u.turn - 1
                WHERE role = 'user' GROUP BY u.conv_id, u.turn, u.text, ids.turn
            )
        ) WHERE n > 0
    """,
    "op3_ngram_jaccard_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i : i + 4], ' '))
                                                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
            FROM split
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), reached AS (
            SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
        ), lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id))::BIGINT AS component_id, coalesce(degree.n, 0)::BIGINT AS n_links
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON lowest.a = doc_id LEFT JOIN degree ON degree.a = doc_id
    """,
    "op5_substring_dedup": """
        WITH split AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), windows AS (
            SELECT doc_id, start, array_to_string(words[start : start + 34], ' ') AS passage
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS start FROM split WHERE len(words) >= 35)
        ), twice AS (
            SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(start, start + 34)) AS pos
            FROM windows SEMI JOIN twice USING (passage)
        ), lost AS (
            SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_filter(words, lambda x, i: pos IS NULL OR NOT list_contains(pos, i)), ' '), '')) AS kept_sha256
        FROM split LEFT JOIN lost USING (doc_id)
    """,
}
