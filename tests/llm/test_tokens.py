import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seedsift.llm import bpe, token_counts
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    pool = "abcdefghijklmnopqrstuvwxyzABC 0123456789'!?.,<|>éàÀßñÇΣσİıǅﬁ\u0301\x1c\x85\xa0\u200b你好👍🏽\n\t_-"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    return [*made, "", " ", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|><|endoftext|>", "a" * 3000, "can't WE'LL i'Ve", "thththth" * 200]


def test_encoding_and_decoding_match_the_library(library):
    codec = bpe.Codec(PATH)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, t
        assert codec.decode(got).decode() == library.decode(ids, skip_special_tokens=False), t


def test_counts_match_the_library(library):
    counter = token_counts.Counter(PATH)
    for t in texts():
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_memory_is_bounded():
    from seedsift.llm.vocabulary import Memory

    m = Memory(lambda k: k * 2, most=10, longest=2)
    for k in map(str, range(200)):
        assert m[k] == 2 * k
        assert len(m) <= 10 and len(m.old) <= 10 and all(len(x) <= 2 for x in m)


def test_very_long_texts_and_pre_tokens(library):
    """A megabyte in one pre-token, and a megabyte of words."""
    rng = random.Random(4)
    codec, counter = bpe.Codec(PATH), token_counts.Counter(PATH)
    for t in ("".join(rng.choice("abcdefghij") for _ in range(1 << 20)), "a" * (1 << 20), " ".join(f"w{rng.getrandbits(30):x}" for _ in range(130_000))):
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == struct.pack(f"<{len(ids)}I", *ids) and counter.count(t) == len(ids)


def test_pair_table_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "PAIRS", 50)
    codec = bpe.Codec(PATH)
    for t in texts()[:300]:
        assert len(codec.encode(t)) == 4 * len(library.encode(t, add_special_tokens=False).ids)
    codec.encoder.part("zq")
    assert len(codec.encoder.good) < 200


def test_queries_over_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.op6_bpe_codec(spark, DATA).collect():
        ids = library.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in token_counts.op9_token_counts(spark, DATA).collect():
        n = len(library.encode(by_id[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(by_id[r.doc_id].encode()), n, n > 2048)


def test_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello"), (None, "hello")], SCHEMA)
    rows = bpe.encode_documents(docs, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1, 1]
    assert [r.ids_sha256 for r in rows if r.doc_id == 1] == [hashlib.sha256(b"").hexdigest()]
    assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()) == [(0, 0), (0, 0), (5, 1), (5, 1), (5, 1)]
    back = bpe.detokenize(bpe.tokenize(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "hello</w>", "hello</w>", "hello</w>"]
    none = docs.where("false").withColumn("n_tokens", docs.doc_id)
    for made in (bpe.encode_documents, bpe.tokenize, token_counts.count_tokens):
        assert made(none, PATH).count() == 0
    clash = docs.withColumns({"n_tokens": docs.text, "n_bytes": docs.text, "ids_sha256": docs.doc_id})
    assert sorted(r.n_tokens for r in bpe.encode_documents(clash, PATH).collect()) == sorted(r.n_tokens for r in token_counts.count_tokens(clash, PATH).collect()) == [0, 0, 1, 1, 1]
