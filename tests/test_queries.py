"""Every registered query runs; those with an oracle match it."""

from __future__ import annotations

import pytest

from lumenveil.plans import catalogue as plans

SQL = plans.oracle_sql()
QUERIES = plans.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(name, same_as_oracle):
    same_as_oracle(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_alike_twice(name, spark, sf_dir):
    first, second = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first == second and first


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["bucket", "in_flight_seconds", "average", "peak"]


def test_entry_point_without_the_corpus_package(monkeypatch):
    """The corpus package and the pipeline may be deleted."""
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_present", lambda name: False)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)


def test_task_view_of_large_files(spark, sf_dir, tmp_path):
    """Sizes from a GiB on are in MiB, as in the query's SQL."""
    import duckdb
    from conftest import plain

    path = tmp_path / "events.parquet"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (event_id * 100003 AS event_id) FROM '{sf_dir}/events.parquet') TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    mine = QUERIES["task_view"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({SQL['task_view']})").fetchall()
    got = mine.collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
    assert any(r["size"].endswith(" MiB") and float(r["size"].split()[0]) >= 1024 for r in got)
