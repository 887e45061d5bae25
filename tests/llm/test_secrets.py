"""Secret spans against plain regular expressions and window counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lumenveil.llm import secrets
from lumenveil.llm.queries import op10_secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def slow_base(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def slow_entropy(text: str | None) -> list[tuple[int, int, int]]:
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
        least = next(bits for _, pattern, bits in secrets.CLASSES if re.search(pattern, m[0]))
        benign = (
            re.search(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", m[0])
            or re.search(r"^/?([A-Za-z]+[0-9]{0,4}[/_-]+)+[A-Za-z]*[0-9]{0,4}$", m[0])
            or re.search(r"example|sample|dummy|placeholder", m[0], re.I)
        )
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(m[0][k : k + 20]).values()) for k in range(len(m[0]) - 19))
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not benign and best >= least:
            found.append((m.start(), 3, m.end()))
    return found


def text_of(spans) -> str:
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_query_equals_plain_reading(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = slow_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert r.spans == text_of(base + slow_entropy(docs[r.doc_id]))


def test_random_texts(spark):
    dice = random.Random(4)
    words = ['password: "', "Token=", "api_key = ", "APIKEY:", "AKIA", "secret", "é🙂", "deadbeef01", "0123456789abcdef", "/usr/lib", "-", " ", "\n", "example", "Zx9+Qw", "K"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
    rows = []
    for i in range(300):
        parts = [dice.choice(words) if dice.random() < 0.5 else "".join(dice.choice(letters) for _ in range(dice.randint(1, 40))) for _ in range(dice.randint(0, 12))]
        rows.append((i, "".join(parts)))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written(F.col("spans")).alias("s")).collect()
    texts = dict(rows)
    assert {r.doc_id: r.s for r in got} == {i: text_of(slow_base(t) + slow_entropy(t)) for i, t in texts.items()}


def test_window_entropy(spark):
    texts = ["a" * 20, "ab" * 30, "abcdefghijklmnopqrst", "x" * 19, "q7" + "a" * 50 + "K2jf83hHs0qPz1LmXc94"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.window_entropy(F.col("t")).alias("h")).collect()
    for r in got:
        want = max((-sum(c / 20 * math.log2(c / 20) for c in Counter(r.t[k : k + 20]).values()) for k in range(len(r.t) - 19)), default=0.0)
        assert abs(r.h - want) < 1e-9


def test_defined_cases(spark):
    slug = "ab-" * 40_000
    many = "0123456789abcdef0123456789abcdef " * 3_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "token=abcdef", "x"), (3, "token=abcdef", "x"), (4, slug, "x"), (5, many, "x"), (None, "AKIA" + "A" * 16, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.find_secrets(docs).select("doc_id", secrets.written(F.col("_spans")).alias("s")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.s for r in got}
    assert by_id[1] == by_id[2] == by_id[4] == "" and by_id[3] == "assign:0:12" and by_id[None] == "access:0:20"
    assert by_id[5].count("hex:") == 3_000 and by_id[5].startswith("hex:0:32,") and f"hex:{33 * 2999}:{33 * 2999 + 32}" in by_id[5]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_the_allow_list_suppresses_only_entropy_spans(spark):
    text = "id 123e4567-e89b-12d3-a456-426614174000 key=K2jf83hHs0qPz1LmXc94vB7n token=123e4567-e89b-12d3-a456-426614174000"
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.kind, s.text[:8]) for s in got] == [("entropy", "K2jf83hH"), ("assign", "token=12")]
