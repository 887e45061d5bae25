"""Repeated windows against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
import re

from lumenveil.llm import debruijn


def slow(rows: list[tuple[int, str | None]], k: int) -> dict[int, tuple[int, int, str]]:
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first: dict[tuple, int] = {}
    for i, w in sorted(words.items()):
        for at in range(len(w) - k + 1):
            first.setdefault(tuple(w[at : at + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for at in range(len(w) - k + 1):
            if first[tuple(w[at : at + k])] < i:
                gone.update(range(at, at + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(docs, **how) -> dict[int, tuple[int, int, str]]:
    rows = debruijn.without_repeats(docs, **how).collect()
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}


def test_random_texts_of_few_words(spark):
    """Few words: many forks, overlaps and windows repeated in one document."""
    dice = random.Random(1)
    pool = [" ".join(dice.choice("abc") for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [dice.choice(pool)[dice.randrange(20) :] if dice.random() < 0.6 else " ".join(dice.choice("abcdefgh") for _ in range(dice.randint(0, 25))) for _ in range(3)]
        rows.append((i * 7 % 61, "  ".join(parts).replace(" ", "\n", 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, k=8, m=3) == slow(rows, 8)
    assert got(docs, k=5, m=5) == slow(rows, 5)


def test_one_word_repeated(spark):
    rows = [(1, "x " * 40), (2, "x " * 90), (3, "y " + "x " * 49), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == slow(rows, 50)
    assert got(docs, k=10, m=4) == slow(rows, 10)


def test_spans_hold_the_removed_words(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[50:120]) + " end"), (3, "none of it")]
    found = {r.doc_id: r for r in debruijn.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[2].spans] == [(1, 70)] and found[2].kept == "start end"
    assert found[1].spans == [] and found[1].kept == rows[0][1] and found[3].n_removed == 0


def test_defined_cases(spark):
    body = " ".join(f"b{k}" for k in range(60))
    rows = [(1, body, "a"), (1, body, "b"), (2, body, "c"), (2, body, "c"), (None, body, "d"), (3, None, "e"), (4, "", "f"), (5, " ".join(["z"] * 49), "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in debruijn.without_repeats(docs).collect()), key=str)
    assert found == sorted([(1, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (None, 60, 0), (3, 0, 0), (4, 0, 0), (5, 49, 0)], key=str)
    assert debruijn.without_repeats(docs.limit(0)).count() == 0


def test_links_of_degree_one_are_compacted(spark):
    """a-b-c is one path; d follows c once only, and e both stands alone and after d."""
    rows = []
    for i, chain in ((1, "abc"), (2, "abcd"), (3, "e"), (4, "de")):
        rows += [(ord(u), i, 0, at * 5, 5, ord(chain[at + 1]) if at + 1 < len(chain) else None) for at, u in enumerate(chain)]
    places = spark.createDataFrame(rows, "minimizer long, id long, text_key long, first int, number int, successor long")
    found = {chr(r.minimizer): (r.number, tuple(r.source)) for r in debruijn._unitigs(places).collect()}
    assert found == {"a": (15, (1, 0, 0)), "d": (5, (2, 0, 15)), "e": (5, (3, 0, 0))}


def test_a_long_path_compacts_to_one_row(spark):
    """Forty paths in one chain: six doublings."""
    rows = [(u, i, 0, u * 3, 3, u + 1 if u < 39 else None) for i in (7, 5) for u in range(40)]
    places = spark.createDataFrame(rows, "minimizer long, id long, text_key long, first int, number int, successor long")
    assert [(r.minimizer, r.number, tuple(r.source)) for r in debruijn._unitigs(places).collect()] == [(0, 120, (5, 0, 0))]


def test_a_span_that_differs_at_its_source_stays(spark, monkeypatch):
    """Hashes only propose: without equal words at the source nothing is removed."""
    body = " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, body), (2, body)], "doc_id long, text string")
    runs = debruijn.repeated_runs(docs)
    assert {r.doc_id: r.n_removed for r in debruijn.without_repeats(docs).collect()} == {1: 0, 2: 60}
    wrong = runs.withColumn("seal", runs.seal.substr(2, 15))
    monkeypatch.setattr(debruijn, "repeated_runs", lambda *a, **k: wrong)
    assert {r.doc_id: r.n_removed for r in debruijn.without_repeats(docs).collect()} == {1: 0, 2: 0}
