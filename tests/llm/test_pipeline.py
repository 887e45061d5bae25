"""The pipeline against the plain versions of its stages, one after another."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from lumenveil.llm import language, tiling
from test_lines import slow as slow_lines
from test_packing import check_bins, reference_ids
from test_nearcopies import slow_classes
from test_tiling import slow_tiles


def test_stages_are_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "decontamination", "packing"]


def contaminated(text: str, items: list[list[bytes]]) -> bool:
    words = tiling.words_of(text)
    for item in items:
        known = set(item)
        near = [w if w in known else None for w in words]
        if sum(w is not None for w in near) < tiling.MIN_MATCH or not item:
            continue
        runs, run = 0, 0
        for w in near:
            run = run + 1 if w is not None else 0
            runs = max(runs, run)
        if runs >= tiling.MIN_MATCH and sum(t[2] for t in slow_tiles(near, item, tiling.MIN_MATCH)) / len(item) >= tiling.COVERAGE:
            return True
    return False


def test_run_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = table.collect()
    model = language.train(table.filter(~language.held_out()))
    kept = []
    for r in docs:
        margins = model.margins(r.text or "")
        if margins is not None and model.decode(margins)[2] >= language.AMBIGUOUS:
            kept.append(r)
    texts = slow_lines([(r.doc_id, r.text, r.source) for r in kept])
    roots = slow_classes(sorted(texts.items()))
    items = [tiling.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [i for i, root in roots.items() if i == root and not contaminated(texts[i], items)]
    want = set()
    for i, ids in zip(left, reference_ids([texts[i] for i in left])):
        first = len(ids) % 1024 or min(len(ids), 1024)
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not piece else start + 1024]
            want.add((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_bins(rows)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want) and 0 < len(left) < len(docs)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, stage):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (None, "Some words without a number here", "en", None, 32), (10_003, "w " * 50_000, "en", "s", 100_000)], table.schema
    )
    docs = table.unionByName(odd).unionByName(odd)
    function = corpus_pipeline.STAGES[stage][1]
    got = function(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert 0 < got.count() <= docs.count()
    assert function(spark, docs.limit(0), sf_dir).count() == 0


def test_short_widespread_lines_go_as_well(spark, sf_dir):
    rows = [(k, f"Read more\nOk\n\nown words {k}", "en", f"s{k}", 0) for k in range(9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()}
    assert got[0][0] == "Read more\nOk\n\nown words 0"
    assert all(got[k] == (f"\nown words {k}", 12) for k in range(1, 9))
