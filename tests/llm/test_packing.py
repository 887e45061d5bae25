"""Packing: an exact round trip through the public tokenizer, and gapless bins."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenveil.llm import packing
from lumenveil.llm.queries import op6_best_fit_packing


def reference_ids(texts: list[str | None]) -> list[list[int]]:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids + [2] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_bins(rows, capacity: int = 1024) -> int:
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(bins)


def test_query_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in docs], reference_ids([r.text for r in docs])))
    rows = op6_best_fit_packing(spark, sf_dir).collect()
    bins = check_bins(rows)
    assert bins <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.03 + 1
    seen: dict[int, list] = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(ids)
    for doc, pieces in seen.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert pieces[0].start == 0 and sum(r.length for r in pieces) == len(ids[doc])
        assert all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:]))
        assert all(r.length == 1024 for r in pieces[1:])
        assert len(ids[doc]) > 1024 or len(pieces) == 1


@pytest.mark.parametrize("text", ["<|endoftext|> as plain text", "tabs\t\tand\r\nlines  ", "naïve 東京 🙂 ́", "a" * 3000, " " * 500, "\x00\x07"])
def test_ids_equal_the_json_vocabulary(text):
    assert packing._ids(packing._encoding("byte_bpe_50k"), text) + [2] == reference_ids([text])[0]


def test_defined_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "word " * 5000, "s"), (3, "word " * 5000, "s"), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    found = packing.pack_documents(docs).collect()
    check_bins(found)
    assert {(r.doc_id, r.length) for r in found if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert sum(r.length for r in found if r.doc_id == 3) == 2 * len(reference_ids([rows[2][1]])[0])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_an_exact_multiple_is_cut_into_full_pieces():
    assert packing._cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing._cut(1024, 1024) == [(0, 1024)] and packing._cut(1025, 1024) == [(0, 1), (1, 1024)] and packing._cut(1, 1024) == [(0, 1)]


def test_bounded_space_best_fit():
    packer = packing.BestFitPacker(10, 2)
    assert packer.add(0, 6) == [] and packer.add(1, 7) == []
    assert packer.add(2, 3) == [[0, (1, 0), (2, 7)]]  # the tightest fit, now full
    assert packer.add(3, 5) == [] and packer.add(4, 8) == [[2, (4, 0)]]  # the fullest closes
    assert packer.open == 2 and [b[0] for b in packer.drain()] == [4, 5]
    assert packer.mask == 0


def test_a_rerun_places_alike(spark):
    pieces = spark.range(2000).selectExpr("id as doc_id", "0 as piece", "cast(1 + id * 37 % 700 as long) as length")
    a, b = (sorted(map(tuple, packing.pack(pieces, open_bins=16, look_ahead=64).collect())) for _ in range(2))
    assert a == b


def test_the_packer_streams_with_bounded_memory(monkeypatch):
    """Open bins stay within the bound whatever the number of rows."""
    most = 0
    add = packing.BestFitPacker.add

    def watched(self, item, length):
        nonlocal most
        out = add(self, item, length)
        most = max(most, self.open)
        return out

    monkeypatch.setattr(packing.BestFitPacker, "add", watched)
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)})))
    lengths = pa.array(np.random.default_rng(0).integers(1, 1000, 20_000), pa.int64())
    run = packing._packer(1024, 32, 256, 0)
    out = list(run(iter([pa.RecordBatch.from_arrays([lengths], names=["length"])])))
    assert sum(b.num_rows for b in out) == 20_000 and most <= 32


def test_added_tokens_in_a_text_are_one_id_as_the_tokenizer_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n\nx", "<|endoftext|", "word <|endoftext|>  naïve " * 400, "no token"]
    want = {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
    assert want[0] == [64, 50256, 65, 2]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check_bins(rows)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in want} == {k: len(x) for k, x in want.items()}


def test_ids_equal_the_tokenizers_on_many_texts():
    """Every text of the large fixture, and strings of random code points and bytes."""
    import random
    from pathlib import Path

    import pyarrow.parquet as pq

    from lumenveil.llm import packing

    dice = random.Random(12)
    table = Path("/root/testdata/sf0.1/documents.parquet")
    texts = [t for t in pq.read_table(table, columns=["text"])["text"].to_pylist() if t] if table.exists() else []
    for _ in range(4000):
        size = dice.randint(1, 40)
        texts.append("".join(chr(dice.choice([dice.randrange(32, 127), dice.randrange(0xD800), dice.randrange(0xE000, 0x110000), 10, 32, 39])) for _ in range(size)))
        texts.append(bytes(dice.randrange(256) for _ in range(size)).decode("utf-8", "replace"))
        texts.append(dice.choice(["", " ", "\n", "x"]).join(dice.choice(["<|endoftext|>", "<|endof", "text|>", "don't", "  ", "12", "\t\n", "\u00e9"]) for _ in range(size)))
    encoding = packing._encoding("byte_bpe_50k")
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        for text, want in zip(part, reference_ids(part)):
            assert packing._ids(encoding, text) == list(want)[:-1], text[:80]
