"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction ``1 / SCALE`` of the hash range, and the
``LEAST`` smallest whatever their size, so that short texts keep all their shingles. Both rules carry
over to unions: the sketch of two texts together follows from their sketches (:func:`merge`). Two sketches are
compared below the smaller of their two reaches, where both are complete, which makes the share of
the smaller text's shingles that the other holds an unbiased estimate however unequal the texts are.

A fingerprint is a sketch as text: base64 of its hashes, ascending, big-endian 64-bit.

Defined cases: texts without words (null, empty) have an empty fingerprint; two empty sketches have
likeness 1, an empty and another 0; equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import shingle_hashes

WORDS, SEED, SCALE, LEAST = 5, 42, 8, 64
#: Weight of a range in :func:`compare_with_next` (1 a row and 1 for each ``UNIT`` bytes of its text), and the most ranges (16 bytes each are
#: sent to every task).
RANGE_WEIGHT, UNIT, MOST_RANGES = 8000, 2048, 1 << 20
_ALL = (1 << 64) - 1


def sketch(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    return _cut(np.unique(shingle_hashes(text, words, seed)))


def _cut(hashes: np.ndarray) -> np.ndarray:
    """Of all hashes in order, those that a sketch keeps."""
    return hashes[: max(LEAST, int(np.searchsorted(hashes, np.uint64(_ALL // SCALE), "right")))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of all shingles of both texts."""
    return _cut(np.union1d(a, b))


def reach(hashes: np.ndarray) -> np.uint64:
    """Up to where a sketch holds every hash of its text."""
    if len(hashes) < LEAST:
        return np.uint64(_ALL)
    return max(np.uint64(_ALL // SCALE), hashes[-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the shingles of the text with fewer that the other text holds, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    to = min(reach(a), reach(b))
    a, b = a[: np.searchsorted(a, to, "right")], b[: np.searchsorted(b, to, "right")]
    fewer = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / fewer if fewer else 0.0


def encode(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fingerprint)`` of each row, without a shuffle."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(sketch(t, words, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(prints, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, parts: int | None = None, words: int = WORDS, seed: int = SEED, id_col="doc_id", text_col="text") -> DataFrame:
    """Each document against its edited text and against the next document, by descending id.

    The next document of the last is the first. Rows are dealt to ranges of (id, hash of the text, salt), of about ``RANGE_WEIGHT`` each unless ``parts`` says
    how many, one range a task, and sorted there; the first row of a range is also sent to the range before, so each range has the row that
    comes after its last. Spark's range partitioning of the narrow keys, repeated by weight, finds the ranges, and each task is sent
    where they start: three numbers a range, of at most ``MOST_RANGES``. Equal ids are ordered by the hash of their text, null ids come last. The salt, a hash of
    a row's place in the scan, cuts equal rows too; ``docs`` is scanned twice, and has to be a table that is dealt to tasks alike both times.
    """
    spark = docs.sparkSession
    weight = lambda text: (1 + F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / UNIT)).cast("int")
    if parts is None:
        total = docs.agg(F.sum(weight(text_col)).alias("n")).first()["n"] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_WEIGHT))
    parts = min(parts, MOST_RANGES)
    # ascending (at, tie) is descending ids, nulls last
    at = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    plain = docs.select(at.alias("at"), F.xxhash64(F.col(text_col)).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = ["at", "tie", "salt"]
    weighed = plain.select(*key, F.explode(F.array_repeat(F.lit(True), weight("text"))))
    ranges = weighed.select(*key).repartitionByRange(parts, *key).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*key)).alias("first"))
    starts = ranges.select(*[f"first.{c}" for c in key]).toArrow().to_pandas().sort_values(key).to_records(index=False)
    sent = spark.sparkContext.broadcast(np.array(starts.tolist(), [(c, "<i8") for c in key]))

    @F.pandas_udf("array<struct<to:int,own:boolean>>")
    def dealt_to(at: pd.Series, tie: pd.Series, salt: pd.Series) -> pd.Series:
        firsts, keys = sent.value, np.empty(len(at), sent.value.dtype)
        keys["at"], keys["tie"], keys["salt"] = at.to_numpy(), tie.to_numpy(), salt.to_numpy()
        part = np.searchsorted(firsts, keys, "right") - 1
        lead = firsts[part] == keys
        own = [[{"to": p, "own": True}] for p in part.tolist()]
        for i in np.flatnonzero(lead).tolist():
            own[i].append({"to": (int(part[i]) - 1) % len(firsts), "own": False})
        return pd.Series(own)

    sent_to = plain.withColumn("x", F.explode(dealt_to(*key))).select("x.to", "x.own", "at", "tie", "doc_id", "text")
    dealt = sent_to.repartitionById(max(1, len(starts)), "to").sortWithinPartitions("to", F.col("own").desc(), "at", "tie", "text").select("to", "own", "doc_id", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]
        held = None  # the row that waits for the next: range, id, text, its sketch

        def finish(row, text, sketched):
            part, doc_id, own, own_sketch = row
            k = len(own) // 3
            edited = own[: len(own) - k] + text[:k]
            edited_sketch = sketch(edited, words, seed)
            values = doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), encode(own_sketch), encode(edited_sketch), likeness(own_sketch, edited_sketch), likeness(own_sketch, sketched)
            for column, value in zip(out, values):
                column.append(value)

        for batch in batches:
            for part, own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if not own and (held is None or held[0] != part):
                    continue  # a guest before which its range has no row
                sketched = sketch(text, words, seed)
                if held is not None:
                    finish(held, text, sketched)
                held = (part, doc_id, text, sketched) if own else None
                if len(out[0]) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out = [[] for _ in range(7)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
