"""One small local session, and the comparison of a query with its oracle."""

from __future__ import annotations

import math
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", f"{folder}/local")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    """The smallest fixture tables."""
    folder = TESTDATA / "sf0.001"
    if not folder.is_dir():
        pytest.skip("the fixture tables are not here")
    return str(folder)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value that both engines write alike: doubles to nine places."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, Decimal):
        return plain(float(value)) if value % 1 else str(int(value))
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="session")
def same_as_oracle(spark, sf_dir, duck):
    """Asserts that a query's rows equal those of its SQL, columns by name."""

    def compare(run, sql: str) -> int:
        mine = run(spark, sf_dir)
        theirs = duck.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(mine.columns)
        order = sorted(names)
        a = sorted(tuple(plain(r[c]) for c in order) for r in mine.collect())
        b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in theirs.fetchall())
        assert a == b
        return len(a)

    return compare
