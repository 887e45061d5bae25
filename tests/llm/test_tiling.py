"""Greedy string tiling against a search of every pair of places."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lumenveil.llm import tiling
from lumenveil.llm.queries import op8_string_tiling


def slow_tiles(doc: list, item: list, m: int) -> list[tuple[int, int, int]]:
    used_d, used_p, tiles = set(), set(), []
    while True:
        best = (m - 1, 0, 0)
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and doc[d + n] == item[p + n] and d + n not in used_d and p + n not in used_p:
                    n += 1
                if n > best[0]:
                    best = (n, d, p)
        n, d, p = best
        if n < m:
            return tiles
        tiles.append((d, p, n))
        used_d.update(range(d, d + n))
        used_p.update(range(p, p + n))


def test_random_texts():
    dice = random.Random(9)
    for _ in range(150):
        items = [" ".join(dice.choice("abcd") for _ in range(dice.randint(0, 25))) for _ in range(3)]
        text = " ".join(x for _ in range(3) for x in (dice.choice(items), " ".join(dice.choice("abcz") for _ in range(dice.randint(0, 6)))))
        for item in items:
            tiles = slow_tiles(text.split(), item.split(), 3)
            if len(item.split()) >= 3:
                assert tiling.overlap(tiling.words_of(text), tiling.words_of(item), 3) == (len(tiles), sum(t[2] for t in tiles))
            numbers = [np.array([ord(w) for w in x.split()], np.int64) for x in (text, item)]
            assert tiling.tiles_of(*numbers, 3) == tiles


def test_reordered_sentences_are_covered():
    item = "one two three four five six. seven eight nine ten eleven twelve. red green blue black white grey"
    text = "Noise first. Red, green, blue, black, white, grey! more noise here ONE TWO THREE FOUR FIVE SIX and seven eight nine ten eleven twelve."
    assert tiling.overlap(tiling.words_of(text), tiling.words_of(item)) == (3, 18)


def test_repeated_words_cost_no_more_than_their_length():
    """40,000 words of one kind against an item of 1,000, and of two kinds at random."""
    import resource
    import time

    dice = random.Random(2)
    before, begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert tiling.overlap([b"a"] * 40_000, [b"a"] * 1000) == (1, 1000)
    assert tiling.overlap([b"a"] * 40_000, [b"a"] * 500 + [b"b"] + [b"a"] * 499) == (2, 999)
    number, covered = tiling.overlap([dice.choice([b"a", b"b"]) for _ in range(40_000)], [dice.choice([b"a", b"b"]) for _ in range(1000)])
    assert covered > 900
    assert time.perf_counter() - begun < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_query_equals_slow_tiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    want = set()
    grams = {}
    for i in items:
        w = tiling.words_of(i.text)
        for k in range(len(w) - tiling.MIN_MATCH + 1):
            grams.setdefault(tuple(w[k : k + tiling.MIN_MATCH]), set()).add(i.item_id)
    words = {i.item_id: tiling.words_of(i.text) for i in items}
    for d in docs:
        w = tiling.words_of(d.text)
        for item in set().union(*(grams.get(tuple(w[k : k + tiling.MIN_MATCH]), set()) for k in range(len(w)))):
            target = set(words[item])
            near = [x if x in target else None for x in w]
            tiles = slow_tiles(near, words[item], tiling.MIN_MATCH)
            covered = sum(t[2] for t in tiles)
            if covered / len(words[item]) >= tiling.COVERAGE:
                want.add((d.doc_id, item, len(tiles), covered))
    got = op8_string_tiling(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id, r.tiles, r.covered) for r in got} == want and want


def test_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(10))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + " ".join(f"w{k}x{j}" for j in range(10)) + " after") for k in range(30)], "doc_id long, text string")
    whole = sorted(map(tuple, tiling.contaminations(docs, items).collect()))
    monkeypatch.setattr(tiling, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(tiling, "CHUNK_ITEMS", 1)
    assert sorted(map(tuple, tiling.contaminations(docs, items).collect())) == whole and [r[:2] for r in whole] == [(k, k) for k in range(30)]


def test_defined_cases(spark):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(1, None, 1), (2, "", 2), (3, item, 3), (3, item, 3), (4, "few words only", 4), (None, item, 5), (5, "pad " * 100_000 + item, 6), (6, "One, two!", 7), (8, "then one two", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _overlaps int").withColumns({c: F.lit(1) for c in ("row_key", "text_key", "row", "item")})
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "one two"), (None, item)], "item_id long, text string")
    found = tiling.contaminations(docs, items).collect()
    assert sorted((r.doc_id or 0) for r in found) == sorted([3, 3, 0, 5] * 3 + [6, 8]) and {r.item_id for r in found} == {7, 10, None}
    left = tiling.without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]
    assert tiling.contaminations(docs.limit(0), items).count() == 0
    assert tiling.contaminations(docs, items.limit(0)).count() == 0
    assert tiling.without_contaminated(docs, items.limit(0)).count() == 9


def test_seeds_left_out_of_the_join_lose_no_pair(spark):
    """Items with a common opening: every document with half an item is found."""
    dice = random.Random(4)
    head = "what is the right answer to this question about"
    items = [(k, head + " " + " ".join(f"w{dice.randint(0, 400)}" for _ in range(dice.randint(0, 14)))) for k in range(60)]
    docs = []
    for k, text in items:
        words = text.split()
        for n in (4, len(words) // 2, len(words) // 2 + 1, len(words)):
            at = dice.randint(0, len(words) - n)
            docs.append((len(docs), "x y " + " ".join(words[at : at + n]) + " z"))
    want = {(d, k) for d, text in docs for k, item in items if 2 * sum(t[2] for t in slow_tiles(text.split(), item.split(), 5)) >= len(item.split())}
    found = tiling.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 60


def test_short_items_are_found_inside_texts(spark):
    dice = random.Random(12)
    items = [(k, " ".join(dice.choice("abcdefgh") for _ in range(1 + k % 7))) for k in range(21)] + [(90, "Capital of the moon"), (91, "x")]
    docs = [(k, " ".join(dice.choice("abcdefgh") for _ in range(dice.randint(0, 12)))) for k in range(60)] + [(90, "what is the capital of the moon, then?"), (91, "the capital of that moon"), (92, "xx x-x")]
    want = set()
    for d, text in docs:
        for k, item in items:
            words, target = tiling.words_of(text), tiling.words_of(item)
            if len(target) < 5:
                hit = any(words[at : at + len(target)] == target for at in range(len(words)))
            else:
                hit = 2 * sum(t[2] for t in slow_tiles(words, target, 5)) >= len(target)
            if hit:
                want.add((d, k))
    found = tiling.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and {(90, 90), (92, 91)} <= want and (91, 90) not in want


def test_a_very_long_item(spark):
    import time

    words = [f"w{k * 7919 % 150_000}" for k in range(200_000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "start " + " ".join(words[:120_000]) + " end"), (2, " ".join(words[:40]))], "doc_id long, text string")
    begun = time.monotonic()
    (row,) = tiling.contaminations(docs, items).collect()
    assert (row.doc_id, row.covered) == (1, 120_000) and time.monotonic() - begun < 60
