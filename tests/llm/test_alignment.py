"""Token alignment against whole-text tokenizers and all overlapping pairs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenveil.llm import alignment
from lumenveil.llm.queries import op13_postings_alignment

RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _byte_of() -> dict[str, int]:
    """The published table of byte-level BPE: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def slow():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = _byte_of()

    def tokens(text):
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if (p := second.id_to_piece(i)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends = [list(accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        spans = [list(zip([0, *x], x)) for x in ends]
        return a, b, *spans

    def run(texts):
        links, out = [], []
        for text in texts:
            found = tokens(text or "")
            if found is None:
                links.append([])
                out.append((0, 0, 0, 0, ""))
                continue
            a, b, spans_a, spans_b = found
            links.append([(x, y) for x, (s, e) in zip(a, spans_a) for y, (t, f) in zip(b, spans_b) if max(s, t) < min(e, f)])
            ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
            groups = []
            for lo, hi in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, spans) if lo <= s and e <= hi) for ids, spans in ((a, spans_a), (b, spans_b))))
            out.append((len(a), len(b), len(ends), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts = Counter(p for x in links for p in set(x))
        best = defaultdict(int)
        for (x, _), n in counts.items():
            best[x] = max(best[x], n)
        return [(*o[:4], sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), o[4]) for o, x in zip(out, links)]

    return run


TEXTS = [
    "Plain words, and 12345 numbers.", "Plain words, and 12345 numbers.", "", None, " ", "   ", " a  b ", "\ta\n\nb \n", "<|endoftext|> <s>x</s> <unk>",
    "a▁b has the mark", "x\x00y\x1c z", "naïve café — déjà vu 你好 世界 привет мир \U0001f600 \U0001f469‍\U0001f4bb", "　wide space  line", "don't we'll I'M", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 4,
    "hello  world   again    ...", "a" + " " * 70 + "b", "z" * 3000 + " end", "http://x.example/a_b?c=d&e=%20 (1,2)[3]{4}",
]


def test_texts_of_every_kind_against_all_pairs(spark, slow):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "Plain words", "x"), (3, "again a row of id 3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = Counter(tuple(r) for r in alignment.aligned(docs).select("doc_id", *RESULTS).collect())
    assert got == Counter((r[0], *told) for r, told in zip(rows, slow([r[1] for r in rows])))


def test_query_against_all_pairs(spark, sf_dir, slow):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows]
    found = {r.doc_id: tuple(r[c] for c in RESULTS) for r in op13_postings_alignment(spark, sf_dir).collect()}
    short = [r for r in rows if len(r.text or "") < 1500]
    assert len(found) == len(rows)
    told = slow([r.text for r in short])  # whole texts; counts need all rows, so these columns are held to the pairs below
    assert all(found[r.doc_id][:4] + found[r.doc_id][6:] == t[:4] + t[6:] for r, t in zip(short, told))
    aligner = alignment.Aligner()
    pairs = {r.doc_id: dict(zip(*map(list, aligner.document(r.text)[5:]))) for r in rows}
    counts = Counter(p for x in pairs.values() for p in x)
    best = defaultdict(int)
    for p, n in counts.items():
        best[p >> 32] = max(best[p >> 32], n)
    for r in rows:
        own = pairs[r.doc_id]
        assert found[r.doc_id][4] == sum(m for p, m in own.items() if counts[p] == best[p >> 32])
        assert found[r.doc_id][5] == sum(m * counts[p] for p, m in own.items())


def test_small_blocks_and_parts_give_the_same(spark, monkeypatch, slow):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").coalesce(2)
    whole = sorted(map(tuple, alignment.aligned(docs).collect()))
    mapped = alignment._blocks(docs, alignment.SIDE_A, alignment.SIDE_B, "doc_id", "text")
    assert mapped.filter("place is not null").count() == 3 * len(TEXTS)
    monkeypatch.setattr(alignment, "PART_BYTES", 500)
    assert sorted(map(tuple, alignment.aligned(docs).collect())) == whole


def test_parts_of_a_long_text_give_the_same(monkeypatch):
    text = " ".join(t for t in TEXTS if t and "▁" not in t) * 3
    aligner = alignment.Aligner()
    whole = aligner.document(text)
    for size in (1, 5, 40):
        monkeypatch.setattr(alignment, "PART_CHARS", size)
        told = aligner.document(text)
        assert told[:5] == whole[:5] and all(np.array_equal(x, y) for x, y in zip(told[5:], whole[5:]))


def test_blocks_are_cut_at_their_limits(monkeypatch):
    pairs, times = alignment._postings([np.array([5, 7]), np.array([], np.int64), np.array([7])], [np.array([1, 2]), np.array([], np.int64), np.array([70000])])[2:4], None
    assert pairs[0].to_pylist() == [1, 2]
    assert [np.frombuffer(x, "<u2").tolist() for x in pairs[1].to_pylist()] == [[0], [0, 2]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs).count() == 0
    assert alignment.pair_counts(docs).count() == 0


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one one"), (3, None)], "doc_id long, text string")
    found = {(r.a, r.b): r.n for r in alignment.pair_counts(docs).collect()}
    (one,) = alignment.Aligner().document("one")[5].tolist()
    assert found[(one >> 32, one & 0xFFFFFFFF)] == 2 and len(found) == 2
