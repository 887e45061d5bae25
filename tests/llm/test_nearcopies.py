"""Near copies by Jaccard similarity against all pairs."""

from __future__ import annotations

import random

import numpy as np

from lumenveil.llm import nearcopies


def slow_sets(text: str | None, n: int = 5) -> set:
    words = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def slow_classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Least id reachable over all pairs of similar texts."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, slow_sets(t)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            small, large = sorted((len(x), len(y)))
            if small >= least * large and (x == y or len(x & y) >= least * len(x | y)):
                x_, y_ = find(a), find(b)
                root[max(x_, y_)] = min(x_, y_)
    return {i: find(i) for i, _ in rows}


def found_classes(docs) -> dict:
    return {r.id: r.keeper.least for r in nearcopies.classes(docs).collect()}


def edited(words: list[str], dice: random.Random, edits: int) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = dice.randrange(len(words))
        words[at : at + 1] = dice.choice([["new%d" % dice.randrange(10**6)], [], [words[at], "more%d" % dice.randrange(10**6)]])
    return words


def texts(dice: random.Random, groups: int, copies: int, length: int = 160) -> list[tuple[int, str]]:
    rows = []
    for _ in range(groups):
        words = ["w%d" % dice.randrange(3000) for _ in range(dice.randint(length // 2, length))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(edited(words, dice, dice.randint(0, 3)))))
    return rows


def test_classes_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_classes(docs) == slow_classes(rows)


def test_recall_on_different_texts(spark):
    rows = texts(random.Random(8), 120, 3)
    want, got = slow_classes(rows), found_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 100 and np.mean([got[i] == want[i] for i in linked]) >= 0.95
    assert all(want[i] == want[got[i]] for i in got)  # never together what all pairs keep apart


def test_blocks_and_a_second_pass_make_no_difference(spark, monkeypatch):
    rows = texts(random.Random(5), 1, 150) + [(1000 + k, t) for k, t in texts(random.Random(6), 30, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = found_classes(docs)
    assert whole == slow_classes(rows)
    for name, value in (("BLOCK", 16), ("BLOCK_TEXTS", 20), ("FOREST_NODES", 10)):
        monkeypatch.setattr(nearcopies, name, value)
    assert found_classes(docs) == whole


def test_common_counts():
    dice = np.random.default_rng(3)
    sets = [np.unique(dice.integers(0, 9000, dice.integers(0, 4000), np.uint64)) for _ in range(7)]
    assert nearcopies.common_counts(sets[:4], sets[4:]).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]


def test_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(5, None), (3, ""), (9, " \n\t"), (2, "One"), (4, "one"), (4, "one"), (7, long), (8, long + " w60000"), (None, "one"), (2, "another text under this id"), (12, "one two three four five six seven eight")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, t1 int")
    got = sorted((r.id, r.keeper.least) for r in nearcopies.classes(docs).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (4, 2), (4, 2), (5, 3), (7, 7), (8, 7), (9, 3), (12, 12)]
    left = nearcopies.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "")[:7]) for r in left.collect()) == [(0, "one"), (2, "One"), (2, "another"), (3, ""), (7, long[:7]), (12, "one two")]
    assert nearcopies.without_copies(docs.limit(0)).count() == 0 and nearcopies.classes(docs.limit(0)).count() == 0


def test_a_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "a row that is repeated often", k) for k in range(600)] + [(2, "another", 0)], "doc_id long, text string, row int")
    assert sorted(r.doc_id for r in nearcopies.without_copies(docs).collect()) == [1, 2]
