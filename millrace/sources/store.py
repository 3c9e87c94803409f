"""A versioned store of tables, small JSON values and the ledger of results, in one folder that all executors share.

    root/<kind>/v=<n>      tables (Parquet), such as cleaned data, scales, centres, learner states
    root/values            rows (version, kind, payload): feature lists, plans, parameters
    root/ledger            rows of results, appended
    root/changelog         rows (version, note)

Every write adds a folder or files; nothing is rewritten, so a job that fails half way leaves what was there before.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import LEDGER


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one before the first write."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """``(version, note)``."""
        return self._read("changelog", "version long, note string")

    def new_version(self, note: str) -> int:
        """The number after the largest one, from 1."""
        number = (self.versions().agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, note)], "version long, note string").coalesce(1).write.mode("append").parquet(f"{self.root}/changelog")
        return number

    def put_table(self, kind: str, version: int, df: DataFrame) -> DataFrame:
        """Write once; a second write of the same kind and version is an error. Gives the stored table."""
        df.write.mode("errorifexists").parquet(f"{self.root}/{kind}/v={version}")
        return self.table(kind, version)

    def table(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/v={version}")

    def has_table(self, kind: str, version: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/v={version}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def cached(self, kind: str, version: int, make) -> DataFrame:
        """The stored table, made and stored by ``make()`` where it is missing."""
        return self.table(kind, version) if self.has_table(kind, version) else self.put_table(kind, version, make())

    def put_value(self, kind: str, version: int, value: Any) -> None:
        row = self.spark.createDataFrame([(version, kind, json.dumps(value))], "version long, kind string, payload string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/values")

    def value(self, kind: str, version: int) -> Any:
        """The latest value of this kind and version, None where there is none."""
        rows = self._read("values", "version long, kind string, payload string, at timestamp").where((F.col("kind") == kind) & (F.col("version") == version))
        payload = rows.agg(F.max(F.struct("at", "payload"))["payload"]).first()[0]
        return None if payload is None else json.loads(payload)

    def append_results(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def results(self) -> DataFrame:
        """All rows of the ledger, with ``worst_case``: mean minus deviation."""
        return self._read("ledger", f"{LEDGER}, version long").withColumn("worst_case", F.col("mean_objective") - F.col("std_objective"))

    def done(self, version: int) -> set[tuple[str, str, str]]:
        """(model, dataset, params) of this version, for :func:`millrace.operators.models.compare` to skip."""
        return {tuple(r) for r in self.results().where(F.col("version") == version).select("model", "dataset", "params").collect()}
