"""Min-max signatures, and components against all pairs of whole sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lumenveil.llm import minmax
from lumenveil.llm.queries import op11_minmax_near_dedup


def slow_set(text: str | None) -> set[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()


def slow_components(rows: list[tuple]) -> dict[int, int]:
    """Least id reachable over all pairs of rows (id, text)."""
    sets = [(i, slow_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def found(frame, **how) -> dict[int, int]:
    return {r.id: r.component for r in minmax.near_duplicates(frame, **how).collect()}


def test_query_equals_its_oracle(same_as_oracle):
    assert same_as_oracle(op11_minmax_near_dedup, minmax.ORACLE_SQL)


def test_signatures_are_unbiased_and_vary_less():
    dice = np.random.default_rng(8)
    told = []
    for _ in range(300):
        pool = dice.integers(0, 1 << 64, 60, np.uint64)
        a, b = (minmax.signature(x, 60) for x in (pool[:50], pool[10:]))
        told.append(minmax.similarity(a, b))
    true = 40 / 60
    assert abs(np.mean(told) - true) < 0.01
    assert np.var(told) < 1.15 * true * (1 - true) / 120  # of 120 values from 60 permutations


def test_sets_have_the_sizes_of_exact_ones():
    for text in ["a b a b", "one", "", None, "  ", "A\tb\x0bC\x0cd\r\n", "a\x1cb c", "é É x", "w " * 5000, " ".join(map(str, range(3000)))]:
        assert len(minmax.shingle_set(text.encode() if text is not None else None)) == len(slow_set(text))


def test_slices_do_not_cut_words(monkeypatch):
    text = b"alpha  beta gamma\tdelta " * 9 + b"x" * 40
    whole = minmax.shingle_set(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(minmax, "SLICE", size)
        assert np.array_equal(minmax.shingle_set(text), whole)


def variants(dice: random.Random, number: int, words: int, edits: tuple[int, int], base: list[str] | None = None) -> list[str]:
    base = base or [f"w{dice.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(number):
        copy = list(base)
        for _ in range(dice.randint(*edits)):
            copy[dice.randrange(words)] = f"v{dice.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_groups_near_the_threshold_against_all_pairs(spark, monkeypatch, block):
    """Many pairs about 0.8, groups without a member that is like all others, copies and strays."""
    monkeypatch.setattr(minmax, "BLOCK_TEXTS", block)
    monkeypatch.setattr(minmax, "STAR_TEXTS", block)
    dice = random.Random(block)
    texts = [t for k in range(40) for t in variants(dice, 6, 60, (0, 7))] + variants(dice, 150, 80, (4, 7))
    texts += ["same words here", "Same  words HERE", "one", "ONE", "two", "", None, " ", "a a a a", "a a"] + texts[:20]
    dice.shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, root int").repartition(5)
    assert found(frame) == slow_components(rows)


def test_null_ids_repeats_and_equal_ids(spark):
    rows = [(None, "the same few words"), (5, "the same few words"), (5, "the same few words"), (7, "The same few words"), (7, "another text of id seven"), (9, None), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    told = sorted((r.id or 0, r.n_shingles, r.component or 0) for r in minmax.near_duplicates(frame).collect())
    assert told == [(0, 3, 0), (5, 3, 5), (5, 3, 5), (7, 3, 5), (7, 4, 7), (8, 0, 8), (9, 0, 9)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in minmax.without_near_duplicates(frame).collect())
    assert kept == [(0, "the same few words"), (5, "the same few words"), (5, "the same few words"), (7, "another text of id seven"), (8, ""), (9, "")]
    assert minmax.near_duplicates(frame.limit(0)).count() == 0


def test_chain_reaches_its_least_id(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[10 * k : 10 * k + 200]) for k in range(20)]  # neighbours share 190 of 210 words
    frame = spark.createDataFrame([(50 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert set(found(frame).values()) == {31}
