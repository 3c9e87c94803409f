"""What several training-data operators need: shared folders, staged tables, whole-text readers."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_serial = itertools.count()
#: what a worker process remembers between tasks: functions that forget it
_forget: list[Callable[[], None]] = []


def remembers(forget: Callable[[], None]) -> None:
    """Register what empties a module's memory of words, vocabularies and the like."""
    _forget.append(forget)


def forget_others() -> None:
    """Empty what operators of earlier stages remember in this worker process; called by tasks that use none of it."""
    for forget in _forget:
        forget()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of ``rows`` rows, so that a task holds Python objects of no more at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (tests, a laptop) one is made and set; a cluster without one is an error,
    since its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(found)
        return context._jsc.sc().getCheckpointDir().get()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{next(_serial)}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete tables of :func:`stage` that nothing reads any more: what came of them has to be written already."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(uri: str) -> tuple[object, str]:
    """The pyarrow file system and path of ``uri``, for tasks that write non-Parquet files."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list:
    """At most ``parts - 1`` ascending split points of ``id_col``, from one pass over that column."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(id_col, cuts, 20 * parts).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def part_of(id_col: Column, bounds: list) -> Column:
    """The number of the range that an id falls in; nulls go to range 0.

    The number of split points is a parameter of the job, never of the data.
    """
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<long>")
    return F.coalesce(F.size(F.filter(edges, lambda e: e <= id_col)), F.lit(0)) if bounds else F.lit(0)
