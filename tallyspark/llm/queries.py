"""The queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    bit_sliced_topk, html_extract, language_id, line_dedup, packing, perplexity, prefix_trie,
    quality_classifier, sentencepiece_codec, simhash_dedup, substring_dedup, token_alignment, url_filter,
)
from tallyspark.llm.common import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.identify(docs, docs.where(~held))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        "accepted")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"),
                                                public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held))
    found = quality_classifier.score_documents(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                           public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_html_extraction, op3_packing, op4_simhash_dedup, op5_language_id, op6_exact_topk,
    op7_substring_dedup, op8_line_dedup, op9_sentencepiece, op10_quality_rules,
    op11_quality_classifier, op12_token_alignment, op13_prefix_trie, pipeline)}

ORACLES = {
    "op1_url_filter": r"""
        WITH p AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(verdict, rhost, rpath) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                   ('allow', 'org', '/fr/')),
        m AS (
            SELECT p.page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
                   arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
            FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m ON p.page_id = m.page_id
    """,
    "op6_exact_topk": r"""
        WITH v AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 10
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents),
        a AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
        c AS (SELECT *, count(*) OVER (PARTITION BY w[s + 1], w[s + 2], w[s + 3], w[s + 20]) AS n FROM a),
        s AS (SELECT doc_id, w, s FROM c WHERE n > 1), -- equal windows have equal ends
        k AS (
            SELECT doc_id, s, row_number() OVER (
                PARTITION BY array_to_string(w[s + 1:s + 20], ' ') ORDER BY doc_id, s) AS k
            FROM s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM k WHERE k > 1),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n
            FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM d),
        p AS (
            SELECT doc_id, i, line, row_number() OVER w AS s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                   sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER w AS c
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        w AS ( -- the shortest stretches of eight words from or up to a line
            SELECT a.doc_id, a.s, b.s AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 7
            WHERE b.c - a.c + a.n >= 8 AND least(b.c - b.n - a.c + a.n, b.c - a.c) < 8),
        k AS (
            SELECT doc_id, s, e, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS k
            FROM (SELECT w.doc_id, w.s, w.e, string_agg(p.line, chr(10) ORDER BY p.s) AS key
                  FROM w JOIN p ON p.doc_id = w.doc_id AND p.s BETWEEN w.s AND w.e GROUP BY w.doc_id, w.s, w.e)),
        gone AS (SELECT DISTINCT p.doc_id, p.i FROM k JOIN p ON p.doc_id = k.doc_id AND p.s BETWEEN k.s AND k.e WHERE k.k > 1),
        kept AS (
            SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept, count(*) AS n
            FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
        SELECT d.doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines,
               CAST(coalesce(len(a), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
               CASE WHEN a IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op13_prefix_trie": r"""
        WITH RECURSIVE crc(b, x, k) AS (
            SELECT b, b, 0 FROM range(256) r(b)
            UNION ALL SELECT b, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM crc WHERE k < 8),
        crcs AS (SELECT list(x ORDER BY b) AS xs FROM crc WHERE k = 8),
        t AS (
            SELECT conv_id AS c, coalesce(text, '') AS text,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS pos FROM t),
        convs AS (
            SELECT c, max(pos) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                       string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, x: xor(xs[xor(a, x) % 256 + 1], a // 256)), 4294967295) % 6 AS h
            FROM p, crcs GROUP BY c, xs),
        s AS (
            SELECT v.c, v.h, v.c - v.c % 100 AS host, least(v.h, coalesce(o.size, 0)) AS taken
            FROM convs v LEFT JOIN convs o ON o.c = v.c - v.c % 100),
        r AS (
            SELECT s.c, pos AS d, key, text FROM s JOIN p ON p.c = s.host AND pos <= h
            UNION ALL SELECT s.c, pos - h + taken, key, text FROM s JOIN p ON p.c = s.c AND pos > h),
        w AS (
            SELECT c, d, sha256(string_agg(key, '' ORDER BY d) OVER (
                PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node, length(text) AS n FROM r
            UNION ALL SELECT c, 0, '', 0 FROM s),
        ends AS (
            SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
            FROM w JOIN (SELECT c, max(d) AS d FROM w GROUP BY c) m USING (c, d) GROUP BY node),
        nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM w GROUP BY node, d),
        ups AS (
            SELECT x.node, x.d, x.conv_id, x.n_convs, x.n, y.node AS up, z.conv_id AS parent_conv_id
            FROM nodes x LEFT JOIN w y ON y.c = x.conv_id AND y.d = x.d - 1 LEFT JOIN nodes z ON z.node = y.node),
        kids AS (SELECT up AS node, count(*) AS n_children FROM ups WHERE up IS NOT NULL GROUP BY up),
        sums AS (
            SELECT a.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved
            FROM nodes x JOIN w a ON a.c = x.conv_id AND a.d <= x.d LEFT JOIN kids k ON k.node = x.node GROUP BY a.node)
        SELECT u.conv_id, u.d AS depth, u.parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
               sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM ups u JOIN sums ON sums.node = u.node LEFT JOIN kids k ON k.node = u.node LEFT JOIN ends e ON e.node = u.node
    """,
}
