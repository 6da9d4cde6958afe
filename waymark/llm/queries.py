"""The registered queries of the text operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, line_crf, page_text, pieces, ranking, repeats, sharding, simhash, token_store, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on the driver; executors have the same folder."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.line_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


QUERIES = [
    op1_line_crf,
    op2_token_store,
    op3_page_differencing,
    op4_hypergeometric_sharding,
    op5_qgram_decontamination,
    op6_simhash_trie,
    op7_bradley_terry,
    op8_prefix_free_parsing,
    op9_piece_viterbi,
    op10_warc_reassembly,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: The other operators draw, learn, hash with XXH64, tokenise or align, which SQL can't express.  Tests hold
#: them against brute force: op1's counts, labelling and verdict, op2's ids and places, op3's pairing and
#: alignment, op4's matrix and shards, op5's matches, op6's fingerprints and components, op7's optimum and
#: cut, op9's segmentation.
ORACLES = {
    "op8_prefix_free_parsing": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        places AS (SELECT r, k, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i, h FROM d),
        strings AS (SELECT r, k, i, substring(h, 2 * i + 1, 100) AS s FROM places),
        hits AS (SELECT r, i FROM (SELECT r, i, k, min(k) OVER (PARTITION BY s) AS first FROM strings) WHERE first < k),
        ends AS (SELECT r, i, CASE WHEN lag(i) OVER w + 50 >= i THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY r ORDER BY i)),
        spans AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM ends) GROUP BY r, g),
        cuts AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
        parts AS (SELECT d.r, sum(z - a) AS removed, count(*) AS n, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS rest
                  FROM cuts JOIN d USING (r) GROUP BY d.r)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
        FROM d LEFT JOIN parts USING (r)""",
    "op10_warc_reassembly": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        w AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS winner FROM p)
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
        FROM w""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
