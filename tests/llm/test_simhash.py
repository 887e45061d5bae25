"""SimHash groups against all pairs, and the Golay keys' promise."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lumenveil.llm import components, simhash
from lumenveil.llm.queries import op9_simhash_near_dedup


def slow_fingerprint(text: str | None, n: int = 4) -> int:
    """The contract's definition, one bit and one shingle at a time."""
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(rows: list[tuple[int, int]], most: int = 4) -> dict[int, int]:
    """Least id reachable, over all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, f) in enumerate(rows):
        for b, g in rows[k + 1 :]:
            if bin(f ^ g).count("1") <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 97]
    indices, number = simhash.codewords(words, 3)
    assert (number == 1).all() and indices.max() < 4096


def test_any_two_within_four_bits_share_a_key():
    dice = random.Random(3)
    for bits in range(5):
        for _ in range(60):
            a = dice.getrandbits(64)
            b = a
            for k in dice.sample(range(64), bits):
                b ^= 1 << k
            pair = np.array([a, b], np.uint64).view(np.int64)
            stored, asked = simhash.stored_keys(pair[:1])[0], simhash.asked_keys(pair[1:])[0]
            assert set(stored.tolist()) & set(asked.tolist()), (bits, a, b)


def test_links_connect_what_all_pairs_connect(spark):
    dice = random.Random(5)
    found = []
    for _ in range(40):
        seed = dice.getrandbits(64)
        for _ in range(dice.randint(1, 8)):
            seed_ = seed
            for k in dice.sample(range(64), dice.randint(0, 6)):
                seed_ ^= 1 << k
            found.append(seed_)
    found = sorted(set(found))
    rows = list(enumerate(found))
    signed = [int(np.uint64(f).astype(np.int64)) for f in found]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    number = {s: k for k, s in enumerate(signed)}
    got = {k: k for k in range(len(found))}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in edges.collect():
        assert bin(int(np.int64(r.a ^ r.b).astype(np.uint64))).count("1") >= 1
        x, y = find(number[r.a]), find(number[r.b])
        got[max(x, y)] = min(x, y)
    assert {k: find(k) for k in got} == slow_components(rows)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    roots = slow_components(prints)
    want = sorted((i, f"{f:016x}", roots[i]) for i, f in prints)
    assert sorted(map(tuple, op9_simhash_near_dedup(spark, sf_dir).collect())) == want


def test_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(5, None, "x"), (3, "", "x"), (9, " \n\t", "x"), (2, "One", "x"), (4, "one", "x"), (4, "one", "x"), (7, long, "x"), (8, long + " w60000", "x"), (None, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    by_id = {i: c for i, _, c in got}
    assert len(got) == len(rows)
    assert by_id[5] == by_id[9] == by_id[3] == 3 and by_id[4] == 2 and by_id[8] == by_id[7] == 7
    assert {f for i, f, _ in got if i in (3, 5, 9)} == {0}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_more_bits_than_the_keys_hold_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), max_bits=5)


def test_keys_are_never_broadcast(spark, monkeypatch):
    """A table of keys is 200 times as large as Spark takes it to be."""
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(simhash, "materialize", written)
    simhash.links(spark.range(1000).selectExpr("xxhash64(id) as fp"))
    assert "SortMergeJoin" in plans["simhash-asks"] and "Broadcast" not in plans["simhash-asks"]


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1400)} == {1000} and got[2001] == 2000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
