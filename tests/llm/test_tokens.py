"""Token counts, piece encoding and packing against the public libraries."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from holdfast.llm import packing, piece_codec, token_counts

SCHEMA = "doc_id long, text string"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b\n\n c", "<|endoftext|>x <|endoftext|>", "a\x1cb \x1f c\x85d\xa0 e　f​", "I'll've 123 x's  ",
       "\n\nx\t\ty \r\n", "é" * 300, "aaaa" * 500, "日本語 🎉🎉 ▁x ▁▁▁  y", "   a", " x" * 50, "----" * 100, "a" * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    signs = "aeth oinrs \n\t'lvd019.,!-_=ñéß日🎉\x00\x1c\xa0　 "
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 200))) for _ in range(800)]
    made += ["".join(rnd.choice("aethoinrsgd ,.") for _ in range(rnd.randint(1, 60))) for _ in range(800)]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return ODD + made + docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_counts_equal_the_library(spark, texts, library):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (0, "")]
    out = token_counts.count_tokens(
        spark.createDataFrame(rows, SCHEMA).repartition(4), JSON, public_tokenizers.PATTERN, budget=30).collect()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert len(out) == len(rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert r["n_bytes"] == len(t.encode()) and r["over_limit"] == (want[i] > 30)
        if want[i] <= 30:
            assert r["budget_bytes"] == r["n_bytes"]
        else:
            assert r["budget_bytes"] < r["n_bytes"]
            head = t.encode()[:r["budget_bytes"]].decode()
            assert head.endswith((" ", "\n", "\t", "\xa0", "　", " ", "\r")) or len(
                library.encode(head, add_special_tokens=False).ids) <= 30


def longest_prefix(library, text, budget):
    """Bytes of the longest prefix of whole characters, by counting every one with the library."""
    sizes = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    return len(text[:max(k for k, n in enumerate(sizes) if n <= budget)].encode())


def test_budget_prefix_is_the_longest(texts, library):
    counter = token_counts.Counter(JSON, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    signs = ["  ", "\n", "\n\n", " \n\t", "\xa0", "a", "the", " the", "'ll", "'ve", "'", "!", "!<", "<|", "<|endoftext|>", "7", "日本", "é", "\x1c"]
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]
    for i, t in enumerate(made + [t for t in texts if len(t) <= 300][:900]):
        budget = 1 + i % 17
        (total,), (size,) = counter.documents([t], budget)
        assert (size is None) == (total <= budget)
        if size is not None:
            assert size == longest_prefix(library, t, budget), (t, budget)


def test_budget_prefix_of_texts_without_spaces(spark, library):
    """At the budget of the query; the prefix used to end with the last unit between spaces."""
    rnd = random.Random(3)
    make = lambda signs, n: "".join(rnd.choice(signs) for _ in range(n))
    texts = [make("日本語のテキストは空白がない", 2500), make("ไทยภาษา", 3000), make("ABCDEFabcdef0123456789+/", 4000),
             "function(a){return" + make("ab(){};=+.,0", 4000), "word " * 1000 + make("中文字符", 900), "x" * 20_000, "é" * 5000]
    out = token_counts.count_tokens(
        spark.createDataFrame(list(enumerate(texts)), SCHEMA), JSON, public_tokenizers.PATTERN).collect()
    for r in out:
        t = texts[r["doc_id"]]
        assert r["over_limit"]
        chars = len(t.encode()[:r["budget_bytes"]].decode())
        tails = [len(e.ids) for e in library.encode_batch([t[:k] for k in range(chars, min(chars + 140, len(t) + 1))], add_special_tokens=False)]
        assert tails[0] <= 1024 < min(tails[1:])


def test_counts_at_every_prefix_of_a_word(library):
    counter = token_counts.Counter(JSON, public_tokenizers.PATTERN)
    for word in ("internationalisation", " unbelievable", "aaaaaaaaaaaaaaaaaaaaaaaa", "0123456789012345"):
        found = counter.prefix_counts(word)
        assert found == [len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]


def test_memory_that_starts_anew_changes_nothing(monkeypatch, texts, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter = token_counts.Counter(JSON, public_tokenizers.PATTERN)
    part = texts[:40]
    for first in range(0, 40, 10):
        found, _ = counter.documents(part[first:first + 10], 1024)
        assert found == [len(e.ids) for e in library.encode_batch(part[first:first + 10], add_special_tokens=False)]


def test_pieces_equal_the_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    encoded = piece_codec.encode_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), PIECES)
    out = encoded.collect()
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    want = model.encode(texts)
    assert [got[i]["ids"] for i in range(len(texts))] == want
    assert [r["ids"] for r in out if r["doc_id"] is None] == [[]]
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(encoded, PIECES).collect()}
    assert [back[i] for i in range(len(texts))] == [model.decode(x) for x in want]
    assert all(got[i]["round_trip"] == ("▁" not in t) for i, t in enumerate(texts))


def run_packing(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return packing.pack_documents(df, RANKS, public_tokenizers.PATTERN, "<|endoftext|>", end=1).collect()


def test_packing_holds_every_id_once(spark, texts, library):
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    out = run_packing(spark, rows)
    ids = {i: e.ids + [1] for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False))}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            part = ids[i][r["start"]:r["start"] + r["length"]]
            assert r["start"] == at and len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0  # nothing to pad


def test_packing_by_cost():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 700, 3000)
    pieces = packing.pack(sizes, 2048)
    cost, used = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + packing.ATTENTION * n * n
        used[s] = used.get(s, 0) + n
    full = [cost[s] for s in used if used[s] == 2048]
    rows_in_order = np.cumsum(sizes) // 2048  # documents one after the other
    plain = np.bincount(rows_in_order, sizes + packing.ATTENTION * sizes**2)[1:-1]
    assert np.std(full) < 0.5 * np.std(plain)
    assert sum(used.values()) == sizes.sum()
    assert len(pieces) < 1.2 * len(sizes)


def test_packing_of_windows_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 300)
    out = run_packing(spark, [(1, "word " * 9000), (1, "word " * 9000), (None, "x"), (2, "")], parts=1)
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in out if r["doc_id"] == 1)
    assert all(r["length"] <= 2048 for r in out)


@pytest.mark.parametrize("run", [
    lambda df: token_counts.count_tokens(df, JSON, public_tokenizers.PATTERN),
    lambda df: piece_codec.encode_documents(df, PIECES),
    lambda df: packing.pack_documents(df, RANKS, public_tokenizers.PATTERN, "<|endoftext|>", end=1),
])
def test_empty_table_and_clashing_columns(spark, run):
    schema = "doc_id long, text string, ids string, n_tokens int, length int, start long"
    assert run(spark.createDataFrame([], schema)).collect() == []
    assert run(spark.createDataFrame([(1, "a", "x", 1, 2, 3), (None, None, None, None, None, None)], schema)).count() == 2
