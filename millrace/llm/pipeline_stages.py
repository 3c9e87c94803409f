"""The stages of the corpus pipeline: each takes and returns the columns of ``documents``, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, packing, resemblance, toxicity
from .shared import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle in the near-duplicate stage, and the Jaccard similarity of shingles from which on texts are near copies.
WORDS, SHARE = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go; rows stay in place, no join is needed."""
    return toxicity.clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in the last of them; ``n_chars`` is that of the new text."""
    done = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest id (none counts as largest), and of such rows the first."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    spare = resemblance.spare_rows(rows.select("row", "text", "doc_id"), [F.col("doc_id").isNull(), F.col("doc_id")], SHARE, WORDS)
    spare = F.broadcast(spare) if spare.count() <= resemblance.ROWS_SENT else spare
    return rows.join(spare, "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
