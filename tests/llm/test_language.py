"""Language codes: held-out accuracy, decoding, and the defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenveil.llm import language
from lumenveil.llm.queries import op2_ecoc_language


def test_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_ecoc_language(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in langs[r.doc_id][1] or ""))
    held = [r for r in rows if r.held_out and langs[r.doc_id][0] is not None]
    assert len(held) > 20 and np.mean([r.lang_pred == langs[r.doc_id][0] for r in held]) >= 0.97


def test_predictions_read_nothing_but_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.filter(~language.held_out()))
    held = docs.filter(language.held_out())
    plain = {r.text: r.language for r in language.identify(held.select("text"), model).collect()}
    other = held.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id")).withColumn("source", F.lit(None).cast("string"))
    assert {r.text: r.language for r in language.identify(other, model).collect()} == plain


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 60])
def test_codewords_are_far_apart(n):
    code = language.code_matrix(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= max(1, code.shape[1] // 4)
    assert all(abs(column.sum()) < n for column in code.T)


def test_decoding_corrects_a_wrong_bit():
    code = language.code_matrix(4)
    model = language.LanguageModel(list("abcd"), code, np.zeros((1, 7), np.float32), np.zeros(7), np.ones(7), np.full((4, 7), 1 / 7))
    for k in range(4):
        for wrong in range(7):
            margins = code[k].astype(float)
            margins[wrong] *= -0.9
            found, share, margin = model.decode(margins)
            assert found == "abcd"[k] and 0 < margin <= share <= 1


def plain_fit(rows: list[tuple[str, str]]):
    """The same model from dictionaries of n-gram counts, and its decoding."""
    import collections
    import math

    def grams(text: str) -> list[int]:
        letters = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
        squeezed = [c for k, c in enumerate(letters) if not k or c != 32 or letters[k - 1] != 32]
        if all(c == 32 for c in squeezed):
            return []
        out, wrap = [], (1 << 64) - 1
        for order in language.ORDERS:
            for k in range(len(squeezed) - order + 1):
                value = squeezed[k]
                if order == 1 and value == 32:
                    continue
                for c in squeezed[k + 1 : k + order]:
                    value = (value * 0x100000001B3 + c) & wrap
                out.append((((value + order) * 0x9E3779B97F4A7C15) & wrap) >> (64 - int(math.log2(language.BUCKETS))))
        return out

    counts: dict = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        counts[lang].update(grams(text))
    langs = sorted(k for k in counts if counts[k])
    code = language.code_matrix(len(langs))
    share = {k: {b: (counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * language.BUCKETS) for b in range(language.BUCKETS)} for k in langs}
    odds = []
    for bit in range(code.shape[1]):
        high, low = ([k for j, k in enumerate(langs) if code[j, bit] == s] for s in (1, -1))
        odds.append([math.log((sum(share[k][b] for k in high) / len(high)) / (sum(share[k][b] for k in low) / len(low))) for b in range(language.BUCKETS)])

    def margins(text: str) -> list[float] | None:
        found = grams(text)
        return [sum(row[b] for b in found) / len(found) for row in odds] if found else None

    seen = [(lang, margins(text)) for lang, text in rows]
    mean = {k: np.mean([m for lang, m in seen if lang == k and m], axis=0) for k in langs}
    centre, scale, weight = [], [], np.zeros(code.shape)
    for bit in range(code.shape[1]):
        high, low = (np.mean([mean[k][bit] for j, k in enumerate(langs) if code[j, bit] == s]) for s in (1, -1))
        centre.append((high + low) / 2)
        scale.append(max((high - low) / 4, 1e-9))
        for j, k in enumerate(langs):
            weight[j, bit] = np.mean([(m[bit] - centre[bit]) * code[j, bit] > 0 for lang, m in seen if lang == k and m]) + 1e-6
    weight /= weight.sum(axis=1, keepdims=True)

    def decode(text: str) -> tuple[str, float]:
        found = margins(text)
        if found is None:
            return "und", 0.0
        f = [min(4.0, max(-4.0, (m - c) / s)) for m, c, s in zip(found, centre, scale)]
        loss = [sum(weight[j, b] * math.exp(-code[j, b] * f[b]) for b in range(len(f))) for j in range(len(langs))]
        parts = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(langs)), key=parts.__getitem__)
        return langs[best], parts[best] / sum(parts)

    return decode


def test_query_equals_plain_fit_and_decoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    decode = plain_fit([(r.lang, r.text) for r in docs if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    texts = {r.doc_id: r.text for r in docs}
    for r in op2_ecoc_language(spark, sf_dir).collect():
        lang, score = decode(texts[r.doc_id] or "")
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_texts_without_letters_of_any_plane(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(4)] + [(k, "der hund und die katze", "de") for k in range(4, 8)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(model.margins(x) is None for x in ("\U0001F600\U0001F680", "\u2603 12 \U0001D7D8", "\U0001F600 " * 300_000))
    assert model.margins("\U00020000") is not None and model.margins("\U0001F600 the") is not None


def test_pieces_of_a_long_text_make_no_difference(monkeypatch):
    text = "One two, THREE  four \u00e9\u00e8 \U00010400x 5 six " * 9
    whole = np.sort(np.concatenate(list(language.ngram_buckets(text))))
    for chars in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "CHARS", chars)
        assert (np.sort(np.concatenate(list(language.ngram_buckets(text)))) == whole).all()


def test_the_sample_keeps_its_bound(spark, monkeypatch):
    """A text that a third of all rows share, and one row repeated as often."""
    rows = spark.range(9000).selectExpr("if(id % 3 = 1, 1, id) as doc_id", "if(id % 3 = 0, 'the same text', if(id % 3 = 1, 'one row', concat('text ', id))) as text", "'en' as lang")
    sizes = []
    counts = language._counts
    monkeypatch.setattr(language, "_counts", lambda sample: sizes.append(sample.groupBy("text").count().collect()) or counts(sample))
    language.train(rows, train_rows=100)
    (found,) = sizes
    assert sum(r["count"] for r in found) == 100 and {r.text: r["count"] for r in found}.get("one row", 0) <= 1
    assert 30 < {r.text: r["count"] for r in found}["the same text"] < 75


def test_a_column_of_the_result_name_stays(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, language string")
    (row,) = language.identify(docs, None).collect()
    assert row.language == "y" and row._language.lang_pred == "und"
    assert language.identify(docs, None, name="told").columns == ["doc_id", "text", "language", "told"]


def test_a_tie_is_ambiguous():
    code = language.code_matrix(2)
    model = language.LanguageModel(["a", "b"], code, np.zeros((1, 1), np.float32), np.zeros(1), np.ones(1), np.ones((2, 1)))
    assert model.decode(np.zeros(1))[2] < language.AMBIGUOUS


def test_defined_cases(spark):
    rows = [(k, "the cat and the dog were there " * 3, "en") for k in range(8)] + [(k, "der hund und die katze waren dort " * 3, "de") for k in range(8, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog " * 100_000), (5, "und die katze"), (5, "und die katze"), (None, "the cat")]
    got = language.identify(spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, score string"), model)
    assert got.columns == ["doc_id", "text", "score", "language"]
    found = {(r.doc_id): r.language for r in got.collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "de", "en"]
    assert found[1].score == 0 and not found[1].ambiguous
    assert got.count() == len(odd) and language.identify(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0)) is None
    assert {r.language.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    alone = language.train(docs.filter("lang = 'de'"))
    assert {r.language.lang_pred for r in language.identify(docs, alone).collect()} == {"de"}
