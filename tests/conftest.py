import datetime
import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def same_rows(df, sql: str, sf_dir: str) -> None:
    """The rows of ``df`` are those of ``sql``, in any order; columns go by name."""
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    mine = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    theirs = [tuple(_plain(v) for v in r) for r in expected]
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    mine.sort(key=key)
    theirs.sort(key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for n, x, y in zip(names, a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == y or abs(x - y) <= 2e-6 * max(1.0, abs(y)), (n, a, b)
            else:
                assert x == y, (n, a, b)


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def check_oracle():
    return same_rows
