import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedsift.llm import alignment
from tests.conftest import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, docs):
    """Rows by nested loops over tokens with their byte ranges."""
    a_lib, b_lib = libraries
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    out, pairs, linked = [], Counter(), []
    for doc, text in docs:
        raw = (" " + (text or "")).encode()
        ia, ib = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        ta = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in ia]
        tb = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            ia, ib, ta, tb = [], [], [], []

        def spans(tokens):
            at, got = 0, []
            for t in tokens:
                got.append((at, at + len(t)))
                at += len(t)
            return got

        sa, sb = spans(ta), spans(tb)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(([i for i, (s, e) in zip(ia, sa) if low < e <= c], [i for i, (s, e) in zip(ib, sb) if low < e <= c]))
            low = c
        mine = [(i, j) for i, (_, e) in zip(ia, sa) for j, (_, f) in zip(ib, sb) if e == f]
        over = sum(s < f and t < e for s, e in sa for t, f in sb)
        pairs.update(mine)
        linked.append(mine)
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append([doc, len(ia), len(ib), len(groups), len(mine), over, sum(len(x) * len(y) for x, y in groups), hashlib.sha256(spelled.encode()).hexdigest() if ia else ""])
    top = Counter()
    for (_, j), n in pairs.items():
        top[j] = max(top[j], n)
    return sorted((tuple([*o, sum(pairs[p] == top[p[1]] for p in m), sum(pairs[p] for p in m)]) for o, m in zip(out, linked)), key=str)


def texts():
    rng = random.Random(5)
    pool = "abcdefthein ABC  0123'!?.,<|>éàßñΣ好👍🏽\n\t_-▁\xa0\u200b"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*made, None, "", " ", "<|endoftext|>", "</s> <s> <unk> <0x0A>", "the end of the end", "the end of the end", "  two  blanks ", "\x00\x7f"]


@pytest.mark.parametrize("most_pairs", [1, alignment.PAIRS])
def test_equal_to_nested_loops(spark, libraries, most_pairs):
    """With a block after each chunk, and with one block a task."""
    docs = [(i // 2, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = plain(libraries, docs)
    assert 5 < sum(r[1] == 0 for r in want) < 40
    got = alignment.align_documents(df, A, B, most_pairs)
    assert got.columns == [c.split()[0] for c in alignment.ALIGNED.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_texts_aligned_together_or_alone_agree():
    e, docs = alignment.encoders(A, B), texts()
    whole = alignment.aligned_texts(e, docs)
    starts = whole[2]
    for i, t in enumerate(docs):
        rows, pairs, _ = alignment.aligned_texts(e, [t])
        assert {k: list(v) for k, v in rows.items()} == {k: [v[i]] for k, v in whole[0].items()}
        assert list(pairs) == list(whole[1][starts[i] : starts[i + 1]])
    block = alignment._Block()
    numbers = [block.add(whole[1][starts[i] : starts[i + 1]]) for i in range(len(docs))]
    assert (block.pairs[np.concatenate(numbers)] == whole[1]).all()
    assert dict(zip(block.pairs, block.count)) == Counter(whole[1])


def test_product_equals_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.random((5, 7)) < 0.4, rng.random((6, 7)) < 0.4
        a, b = (alignment.from_pairs(*np.nonzero(m), *m.shape) for m in (x, y))
        got = np.zeros((5, 6), int)
        r, c, v = alignment.product(a, alignment.transposed(b))
        got[r, c] = v
        assert (got == x.astype(int) @ y.T.astype(int)).all()


def test_query_equals_nested_loops_on_short_documents(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.left("text", F.lit(300))).collect()]
    got = alignment.align_documents(spark.createDataFrame(docs, SCHEMA), A, B).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(libraries, docs)
    assert alignment.op13_token_alignment(spark, DATA).count() == len(docs)


def test_empty_clashing_and_long(spark, libraries):
    docs = spark.createDataFrame([(1, "abc def"), (None, "abc def")], SCHEMA)
    assert alignment.align_documents(docs.where("false"), A, B).count() == 0
    clash = docs.withColumns({"block": docs.text, "links": docs.doc_id, "n_a": docs.text})
    assert {(r.n_links, r.count_sum, r.n_best) for r in alignment.align_documents(clash, A, B).collect()} == {(2, 4, 2)}
    rows, pairs, _ = alignment.aligned_texts(alignment.encoders(A, B), ["ab " * 200_000, "x" * 300_000])
    assert all(rows["n_groups"] > 0) and len(pairs) == rows["n_links"].sum()
