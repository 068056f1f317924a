"""The operators' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact_dedup, grid_order, html_text, kneser_ney, line_dedup, mixing, pieces, prefix_trie, simhash, substrings, toxicity, transport, vector_codes


def media_payloads(spark, sf_dir: str) -> DataFrame:
    """What op2 reads back, as far as SQL can follow."""
    return transport.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """op8's sizes and targets; the draws are beyond SQL."""
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def word_scores(spark, sf_dir: str) -> DataFrame:
    """Counts and the base score of op10's operator, learnt from all documents; these are of single words, so pairs of words are the least it can learn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kneser_ney.score(docs, kneser_ney.fit(docs, order=2)).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pieces_round_trip(spark, sf_dir: str) -> DataFrame:
    """op6's texts after encoding and decoding."""
    return pieces.query(spark, sf_dir).select("doc_id", "decoded_sha256", "exact")


QUERIES = {
    "op1_grid_order": grid_order.query,
    "op2_transport_streams": transport.query,
    "op3_simhash": simhash.query,
    "op4_main_text": html_text.query,
    "op5_toxicity": toxicity.query,
    "op6_pieces": pieces.query,
    "op7_line_dedup": line_dedup.query,
    "op8_source_mixing": mixing.query,
    "op10_kneser_ney": kneser_ney.query,
    "op9_substrings": substrings.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_vector_codes": vector_codes.query,
    "media_payloads": media_payloads,
    "mixing_targets": mixing_targets,
    "word_scores": word_scores,
    "pieces_round_trip": pieces_round_trip,
}

#: What SQL can express; the others are tested against brute force, exact round trips or held-out accuracy.
SQL: dict[str, str] = {
    "op1_grid_order": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_sum(list_transform(embedding, lambda e: e::DOUBLE * e)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
                 WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.98),
        reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
        near AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
        SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
        FROM reach r LEFT JOIN near n ON n.vec_id = r.vec_id GROUP BY r.vec_id""",
    "media_payloads": r"""
        SELECT doc_id, strlen(t)::BIGINT AS n_bytes, p::BIGINT AS payload_bytes, sha256(encode(t) || repeat('\x00'::BLOB, p - strlen(t))) AS payload_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t, greatest(64, ((strlen(coalesce(text, '')) + 63) // 64) * 64) AS p FROM documents) x""",
    # A target is the level's share or three times its source; sources reach their bound in the order of bound by weight.
    "mixing_targets": r"""
        WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k FROM s),
        l AS (SELECT k, 3.0 * source_size / w AS ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
        f AS (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1)
        SELECT d.doc_id, d.size, s.source_size, round(least(f.level * s.w, 3.0 * s.source_size), 4)::DOUBLE AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN f""",
    "word_scores": r"""
        WITH d AS (SELECT doc_id, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), NULL) AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS t FROM d), c AS (SELECT t, count(*) AS c FROM w GROUP BY t), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT w.doc_id, count(*) AS n_tokens, count(*) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((c.c + 0.1) / (n.n + 0.1 * (n.v + 1)))), 4) AS base_score
        FROM w JOIN c ON c.t IS NOT DISTINCT FROM w.t CROSS JOIN n GROUP BY w.doc_id""",
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) x WINDOW w AS (PARTITION BY t)""",
    "op13_vector_codes": vector_codes.sql(),
    "pieces_round_trip": "SELECT doc_id, sha256(text) AS decoded_sha256, true AS exact FROM documents",
    "op9_substrings": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
        own AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN own ON own.k = win.k AND own.first < win.doc_id) x),
        word AS (SELECT doc_id, p, ws[p] AS t FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
        kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
