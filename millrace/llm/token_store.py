"""Token ids in Arrow stream files of fixed-size-list batches.

A shard is two Arrow IPC files: ``shard-N.arrow`` with record batches of ``input_ids``
(fixed-size lists of ``length`` ids) and ``mask`` (which places hold ids; only a shard's last row
can have holes), and ``shard-N.docs.arrow`` with the documents of the shard (id, place of its first
id in the shard, number of ids). Each row of a batch is the same number of bytes, so row ``i`` is
read from a memory map without copying. Shards are ranges of document ids, in ascending order; rows
of one id are ordered by a hash of their texts. A task writes under a name of its own and then renames, so a task that is run again, or twice, leaves one whole file.

Defined cases: null and empty texts hold just the end id; null ids come first and, like repeated
ids, are kept as rows of their own; an empty table gives no shard; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import local_path, slices, stage
from .tokens import WordEncoder

#: Ids of a row, and rows of a record batch.
LENGTH, BATCH_ROWS = 2048, 256
#: Documents of a shard, and shards of a group whose ids are summed together.
SHARD_DOCS, BUNDLE = 4000, 1024


class ShardWriter:
    """Rows of ``length`` ids, written batch by batch; nothing but the open batch is held."""

    def __init__(self, folder: str, part: int, length: int, width: str) -> None:
        self.fs, base = local_path(folder)
        self.fs.create_dir(base, recursive=True)
        self.part, self.length, self.kind = part, length, pa.from_numpy_dtype(np.dtype(width))
        self.final, self.open_name = f"{base}/shard-{part:06d}", f"{base}/.{uuid.uuid4().hex}"
        self.uri = f"{folder.rstrip('/')}/shard-{part:06d}"
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.open_name)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.width, self.pending, self.held, self.n = np.dtype(width), [], 0, 0
        self.docs: list[tuple] = []

    def add(self, doc_id, raw: bytes) -> None:
        ids = np.frombuffer(raw, self.width)
        self.docs.append((doc_id, self.n, len(ids)))
        self.pending.append(ids)
        self.held, self.n = self.held + len(ids), self.n + len(ids)
        if self.held >= self.length * BATCH_ROWS:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, self.width)
        whole = self.length * BATCH_ROWS
        rows = -(-len(ids) // self.length) if last else len(ids) // whole * BATCH_ROWS
        here, rest = ids[: rows * self.length], ids[rows * self.length :]
        for at in range(0, rows, BATCH_ROWS):
            some = here[at * self.length : (at + BATCH_ROWS) * self.length]
            n = -(-len(some) // self.length)
            mask = np.arange(n * self.length) < len(some)
            some = np.pad(some, (0, n * self.length - len(some)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (some, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.pending, self.held = [rest], len(rest)

    def close(self) -> tuple[int, str, int, int]:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()
        table = pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("doc_id", "start", "n_tokens"), zip(*self.docs))})
        with self.fs.open_output_stream(self.open_name + "d") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        self.fs.move(self.open_name + "d", self.final + ".docs.arrow")
        self.fs.move(self.open_name, self.final + ".arrow")
        return self.part, self.uri, len(self.docs), self.n


def open_shard(path: str) -> pa.NativeFile:
    """A memory map where the file system is local, else the file system's own reader."""
    from pyarrow import fs

    system, at = local_path(path)
    return pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None, length: int = LENGTH, width: str = "<u2", id_col="doc_id", text_col="text") -> DataFrame:
    """Write ``docs`` to ``folder`` in ascending id order; returns one row per shard.

    ``width`` is the ids' type in the files: two bytes for vocabularies of up to 65,536 ids, else
    ``<u4``. ``parts`` is the number of shards, one for each ``SHARD_DOCS`` documents unless given. Shards are ranges of (id, hash of the text, salt), dealt by
    Spark's range partitioning, so rows of one id or none spread over shards too, equal rows by the salt. The result's ``base`` is the number of ids in all shards before.
    """
    spark = docs.sparkSession
    parts = parts or max(1, -(-docs.count() // SHARD_DOCS))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = plain.repartitionByRange(parts, *order, F.col("salt").asc()).sortWithinPartitions(*order).select("doc_id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = WordEncoder.load(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, done = None, []
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encoder.encode, batch.column(2).to_pylist())):
                if shard is None:
                    shard = ShardWriter(folder, TaskContext.get().partitionId(), length, width)
                shard.add(doc_id, np.frombuffer(ids + end, "<u4").astype(width).tobytes())
        if shard is not None:
            done.append(shard.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "docs", "tokens"), x)) for x in done], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    shards = stage(dealt.mapInArrow(write, "part int, path string, docs long, tokens long"), "shards")
    # running sums by groups of shards, then over the groups: no window sees all shards
    grouped = shards.withColumn("bundle", F.floor(F.col("part") / BUNDLE))
    before = Window.orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)
    bundles = grouped.groupBy("bundle").agg(F.sum("tokens").alias("sum")).select("bundle", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("low"))
    inside = F.sum("tokens").over(Window.partitionBy("bundle").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = grouped.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bundles, "bundle")
    return stage(based.select("part", "path", "docs", "tokens", (F.col("low") + F.col("inside")).alias("base")), "shards")


def read_documents(shards: DataFrame, length: int = LENGTH, width: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Each document of the files: id, ``start`` among all ids, ``n_tokens``, crc32 of its ids as 32-bit integers."""
    spark = shards.sparkSession
    n = max(1, min(shards.count(), spark.sparkContext.defaultParallelism * 64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                with open_shard(shard["path"] + ".docs.arrow") as source:
                    docs = pa.ipc.open_file(source).read_all()
                with open_shard(shard["path"] + ".arrow") as source:
                    yield from _shard_documents(ShardReader(pa.ipc.open_file(source), length, width), docs, shard["base"], with_ids)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return shards.repartition(n, "part").mapInArrow(read, names)


def _shard_documents(reader: "ShardReader", docs: pa.Table, base: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for some in docs.to_batches(max_chunksize=1024):
        ids, starts, lengths = (c.to_pylist() for c in some.columns)
        raw = [reader.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, lengths)]
        arrays = [pa.array(ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(lengths, pa.int64()), pa.array([crc32(x) for x in raw], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)


class ShardReader:
    """Random access to a shard: ``ids(start, n)`` touches only the batches that hold the range.

    Every batch but a shard's last has :data:`BATCH_ROWS` rows, so an id's place gives its batch.
    """

    def __init__(self, file: pa.ipc.RecordBatchFileReader, length: int = LENGTH, width: str = "<u2") -> None:
        self.file, self.width, self.at = file, np.dtype(width), -1
        self.span = length * BATCH_ROWS

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.values = self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            self.at = k
        return self.values

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, inside = divmod(start, self.span)
            parts.append(self._batch(k)[inside : inside + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, self.width)


def sequences(shards: DataFrame) -> DataFrame:
    """The rows of the files: ``input_ids`` and ``mask`` of equal length, with the shard and row number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                with open_shard(shard["path"] + ".arrow") as source:
                    file, row = pa.ipc.open_file(source), 0
                    for k in range(file.num_record_batches):
                        held = file.get_batch(k)
                        n = held.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard["part"]] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), held.column(0).cast(pa.list_(pa.int32())), held.column(1).cast(pa.list_(pa.bool_()))],
                            ["part", "row", "input_ids", "mask"],
                        )
                        row += n

    return shards.mapInArrow(read, "part int, row long, input_ids array<int>, mask array<boolean>")
