"""One-bit neighbours against brute force in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenveil.llm import ann
from lumenveil.llm.queries import op5_one_bit_neighbours

KIND = "vec_id long, embedding array<float>"


def slow(rows: list[tuple[int, list]], k: int = 20) -> dict[int, list[int]]:
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    return {i: [j for _, j in sorted((-float(np.cumsum(w * v)[-1]), j) for j, w in ok if j != i)[:k]] for i, v in ok if i % 20 == 0}


def search(docs, **how) -> dict[int, list[int]]:
    out: dict[int, list] = {}
    for r in ann.nearest(docs, F.col("vec_id") % 20 == 0, **how).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {i: [j for _, j in sorted(v)] for i, v in out.items()}


def test_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = slow(rows)
    got: dict[int, list] = {}
    for r in op5_one_bit_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    recall = np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want])
    assert recall >= 0.99


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_VALUES", 0)
    monkeypatch.setattr(ann, "QUERY_ROWS", 12)
    monkeypatch.setattr(ann, "BATCH_VALUES", 0)
    dice = np.random.default_rng(6)
    rows = [(i, dice.normal(size=24).astype(np.float32).tolist()) for i in range(700)]
    want, got = slow(rows), search(spark.createDataFrame(rows, KIND))
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.99


def test_copies_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)]
    assert search(spark.createDataFrame(rows, KIND)) == slow(rows)


def test_the_error_bound_holds():
    dice = np.random.default_rng(8)
    vectors, asked = dice.normal(size=(2000, 64)), dice.normal(size=(50, 64))
    codes = ann.OneBitCodes(vectors[:500], 64)
    estimate, width = codes.bounds(asked, *codes.encode(vectors))
    wrong = np.abs(estimate - asked @ vectors.T) > width
    assert wrong.mean() < 0.01
    assert abs((estimate - asked @ vectors.T).mean()) < 0.05


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (40, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", score string, rank int")
    assert search(docs) == {0: [1, 20], 20: [1, 0]}
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], KIND)
    assert search(one) == {}
    nobody = spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0, 1.0])], KIND)
    assert search(nobody) == {}


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (None, [9.0, 9.0])]
    found = ann.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0).collect()
    assert {r.vec_id for r in found} == {1} and {r.query_id for r in found} == {0}


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)]
    assert search(spark.createDataFrame(rows + [(40, [1.0, 2.0, 3.0]), (41, [9.0])], KIND)) == slow(rows)


def test_a_row_repeated_by_a_third_of_the_table(spark):
    rows = [(20, [1.0, 2.0])] * 40 + [(i, [float(i), 1.0]) for i in range(21, 100)]
    found = ann.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 20] == [99] * 20
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 40] == slow(rows)[40]
