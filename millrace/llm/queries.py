"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, delta_lloyd, line_dedup, merkle, packing, simhash, sketch, token_store, toxicity, tree_bpe, warc
from .shared import documents, new_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), with_text=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), window=2048, end_id=1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_tokens(documents(spark, sf_dir), new_path(spark, "tokens"), _vocabulary("word_bpe_49k.json"), 2)
    return token_store.read_documents(shards)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last reply cut in half; texts and spans as digests."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = chat.shortened_replies(chat.conversations(turns))
    done = chat.format_preferences(pairs, carry=("conv_id",))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return done.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), *digests, "chosen_loss", "rejected_loss")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_packing, op3_warc, op4_byte_bpe, op5_token_files, op6_chat, op7_simhash, op8_fingerprints, op9_nearest, op10_toxicity, op11_merkle, op12_tree_bpe, op13_delta_lloyd)
}

_KEY = """translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, pos, parts[pos] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split)),
        keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT doc_id, pos, line, coalesce(doc_id < last_doc, false) AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_warc": """
        WITH digested AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM digested)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
        FROM firsts""",
    "op6_chat": """
        WITH raw AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
        turns AS (SELECT conv_id, alone, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM raw),
        marked AS (SELECT *, max(pos) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, alone) AS last FROM turns),
        other AS (SELECT *, CASE WHEN pos = last THEN left(text, length(text) // 2) ELSE text END AS other_text FROM marked),
        cut AS (SELECT *, min(CASE WHEN text <> other_text THEN pos END) OVER (PARTITION BY conv_id, alone) AS differs FROM other),
        sized AS (SELECT *, differs IS NULL OR pos < differs AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a,
                 '<|' || role || '|>' || chr(10) || other_text || '<|end|>' || chr(10) AS b FROM cut),
        placed AS (SELECT *, sum(CASE WHEN shared THEN 0 ELSE length(a) END) OVER w AS a_end, sum(CASE WHEN shared THEN 0 ELSE length(b) END) OVER w AS b_end
                 FROM sized WINDOW w AS (PARTITION BY conv_id, alone ORDER BY pos))
        SELECT conv_id, count(*) FILTER (shared)::BIGINT AS prompt_turns,
               sha256(coalesce(string_agg(a, '' ORDER BY pos) FILTER (shared), '')) AS prompt_sha256,
               sha256(coalesce(string_agg(a, '' ORDER BY pos) FILTER (NOT shared), '')) AS chosen_sha256,
               sha256(coalesce(string_agg(b, '' ORDER BY pos) FILTER (NOT shared), '')) AS rejected_sha256,
               coalesce(string_agg((a_end - length(a) + 14)::BIGINT || '-' || (a_end - 1)::BIGINT, ',' ORDER BY pos) FILTER (NOT shared AND role = 'assistant'), '') AS chosen_loss,
               coalesce(string_agg((b_end - length(b) + 14)::BIGINT || '-' || (b_end - 1)::BIGINT, ',' ORDER BY pos) FILTER (NOT shared AND role = 'assistant'), '') AS rejected_loss
        FROM placed GROUP BY conv_id, alone""",
    "op11_merkle": merkle.oracle_sql(),
    "op13_delta_lloyd": delta_lloyd.oracle_sql(),
}
