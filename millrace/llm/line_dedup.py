"""Line dedup over levelled sorted runs of line hashes.

A run is a table of ``(key, n_docs, last_doc)``, bucketed and sorted by ``key``. Batches of documents arrive one after another: each merge-anti-joins
the runs with its own distinct keys. Keys that no run holds are new; for the others the batch takes up what the runs know of them. It then adds
its own run, with the counts so far of all its keys: so the newest of the runs that hold a key, which has the largest counts, knows all of it.
When a level holds ``fanout`` runs they are merged into one run of the next level, so ``n`` batches leave at most ``fanout * log(n)`` runs. Runs
have the same buckets, so these joins and merges shuffle a batch's own keys and no run.

A line is repeated if its key is in at least ``min_docs`` documents. At the end documents are merge-anti-joined with the repeated keys: such lines go, except
in the largest id that holds them. A key is the 128-bit hash of the line with ASCII white space stripped from both ends and A-Z
lower-cased; lines of fewer than ``min_chars`` code points always stay.

Scale: a document's keys are distinct before they are shuffled and counts are combined before the
shuffle, so a line in every document costs a row a task. The row-level join is a sort-merge join
of two shuffled sides, which AQE splits where a key is hot. Whole texts are shuffled once, by id and hash: rows without id do not meet.

Defined cases: null and empty texts are one empty line; each row is a document of its own, so
repeated rows count repeatedly and, having the same id, keep or lose a line together; null ids
rank below all others; an empty table gives no rows; columns not named in ``carry`` are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget_others, id_bounds, new_path, part_of, remove, slices, stage

MIN_DOCS, MIN_CHARS = 5, 40
#: Lines of a bucket of the runs.
RUN_KEYS = 2_000_000
#: Ids below every other id: what a null id counts as.
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a UTF-8 line, or None for a line that is too short to have one."""
    line = line.strip(b" \t\n\x0b\x0c\r")
    if len(line) < min_chars or not line.isascii() and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(batch, doc_id, tie, key)``: the distinct keys of each row of ``(batch, doc_id, tie, text)``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            rows, found = [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                if text and len(text) >= min_chars:
                    own = {line_key(x, min_chars) for x in text.encode().split(b"\n") if len(x) >= min_chars}
                    own.discard(None)
                    rows += [row] * len(own)
                    found += own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:3]), pa.array(found, pa.binary())], ["batch", "doc_id", "tie", "key"])

    return docs.mapInArrow(keys, "batch int, doc_id long, tie long, key binary")


class LineRuns:
    """The levels of runs. :meth:`add` takes ``(doc_id, key)`` rows, one for each key of a document."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def add(self, lines: DataFrame) -> None:
        own = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        for level in self.levels:
            for run in level:
                # merge-anti-join: of keys that the run does not hold nothing is known; a later run that holds a key knows more
                old = self.spark.table(run).select("key", F.col("n_docs").alias("known"), F.col("last_doc").alias("before"))
                own = own.join(old, "key", "left")
                seen = [F.struct(F.col("known"), F.col("before"))] + ([F.col("seen")] if "seen" in own.columns else [])
                own = own.select("key", "n_docs", "last_doc", (F.greatest(*seen) if len(seen) > 1 else seen[0]).alias("seen"))
        if "seen" in own.columns:
            total = F.col("n_docs") + F.coalesce(F.col("seen.known"), F.lit(0))
            own = own.select("key", total.alias("n_docs"), F.greatest("last_doc", F.col("seen.before")).alias("last_doc"))
        self._write(own, 0)

    def _write(self, run: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, f"line-run-{level}")
        # each bucket in one task and one file, sorted
        run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = held = self.levels[level] + [name]
        if len(held) == self.fanout:
            self._write(self._merged(held), level + 1)
            self.levels[level] = []
            for old in held:
                self._drop(old)

    def _drop(self, run: str) -> None:
        folders = {f.rsplit("/", 1)[0] for f in self.spark.table(run).inputFiles()}
        self.spark.sql(f"DROP TABLE {run}")
        for folder in folders:
            remove(self.spark, folder)

    def _merged(self, runs: list[str]) -> DataFrame:
        """One row for each key, of the newest run that holds it; runs are joined bucket by bucket."""
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            more = self.spark.table(run).select(F.col("key").alias("other"), F.col("n_docs").alias("n2"), F.col("last_doc").alias("l2"))
            merged = merged.join(more, F.col("key") == F.col("other"), "full_outer")
            merged = merged.select(F.coalesce("key", "other").alias("key"), F.greatest("n_docs", "n2").alias("n_docs"), F.greatest("last_doc", "l2").alias("last_doc"))
        return merged

    def entries(self) -> DataFrame:
        """One row for each key of all batches so far."""
        return self._merged([run for level in self.levels for run in level])

    def repeated(self, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """The rows of ``lines`` whose line goes: in ``min_docs`` documents or more, and not in the last of them."""
        common = stage(self.entries().where(F.col("n_docs") >= min_docs), "common-lines")
        return lines.join(common, "key").where(F.col("doc_id") < F.col("last_doc")).drop("n_docs", "last_doc")

    def close(self) -> None:
        """Drop all runs; what was read from them has to be written already."""
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = 4, id_col="doc_id", text_col="text", carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Each document's ``n_lines``, ``n_dropped`` and ``kept_sha256`` (and new ``text``), with the columns of ``carry``.

    ``batches`` ranges of ids are added one after another, as arriving data would be.
    """
    spark = docs.sparkSession
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    plain = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    bounds = id_bounds(plain, "doc_id", batches)
    path = new_path(spark, "line-keys")
    tie = F.xxhash64("text").alias("tie")
    batched = plain.select(part_of(F.col("doc_id"), bounds).cast("int").alias("batch"), "doc_id", tie, "text")
    keyed_lines(batched, min_chars).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, tie long, key binary, batch int").parquet(path)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // RUN_KEYS))
    runs = LineRuns(spark, fanout, buckets)
    for batch in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == batch).select("doc_id", "key"))
    # rows of one id and text lose the same lines, and rows of no id are told apart by their texts
    gone = runs.repeated(lines.drop("batch"), min_docs).groupBy("doc_id", "tie").agg(F.collect_set("key").alias("gone"))
    gone = stage(gone.withColumnsRenamed({"doc_id": "at", "tie": "same"}), "lines-gone")
    runs.close()
    remove(spark, path)
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry])
    rows = docs.select(doc_id.alias("at"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried"))
    joined = rows.withColumn("same", F.xxhash64("text")).join(gone, ["at", "same"], "left").select("doc_id", "text", "gone", "carried")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text + ", carried struct<none:int" + "".join(f",`{c}`:{kinds[c]}" for c in carry) + ">"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            n_lines, n_dropped, digests, texts = [], [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                some = data.split(b"\n")
                stay = some
                if drop:
                    drop = set(drop)
                    stay = [x for x in some if line_key(x, min_chars) not in drop]
                    data = b"\n".join(stay)
                n_lines.append(len(some))
                n_dropped.append(len(some) - len(stay))
                digests.append(hashlib.sha256(data).hexdigest())
                texts.append(data)
            columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns + [batch.column(3)], names)

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text + ["carried"]
    done = joined.mapInArrow(kept, schema)
    return done.select(*names[:-1], *[F.col("carried")[c].alias(c) for c in carry])
