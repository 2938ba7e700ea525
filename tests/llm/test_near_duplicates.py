import random

import numpy as np
import pytest

from seedsift.llm import components, minhash
from seedsift.llm.common import Scratch
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words, percent=80):
    """Component of each document by comparing all sets with all."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(minhash.LOWER).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return groups(links, ids), {i: len(s) for i, s in sets.items()}


def corpus():
    """Families of copies with 0 to 12 changed words, chains, short texts and strangers."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(60)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(60)] = word()
            rows.append(" ".join(text))
        rows += [" ".join(base)] * 3
    chain = [word() for _ in range(80)]
    for k in range(10):
        rows.append(" ".join(chain[k * 4 : k * 4 + 44]))
    rows += ["", "one", "One", "one two", "ONE two", "a b c d e", "a b c d e f", "a b c d e f g", *(" ".join(word() for _ in range(30)) for _ in range(40))]
    return list(enumerate(rows))


@pytest.mark.parametrize("words", [2, 5])
def test_groups_match_brute_force(spark, words):
    rows = corpus()
    want, sizes = brute(rows, words)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    rows = corpus()
    for members, shingles in ((5, 1_000_000), (1024, 300)):
        monkeypatch.setattr(minhash, "BLOCK", members)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows, 2)[0]


def brute_rows(rows, words):
    """Components by comparing all rows' texts with all; rows of one id are one node."""
    texts = [brute([(0, t)], words)[1][0] for _, t in rows]
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(minhash.LOWER).split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return groups(links, {i for i, _ in rows}), texts


@pytest.mark.parametrize("small", [2, 32])
def test_several_texts_of_one_id(spark, monkeypatch, small):
    """Every text of an id links, whatever the order of its rows."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    rng = random.Random(small)
    texts = [t for _, t in corpus()]
    for _ in range(2):
        rows = [(rng.randrange(90), rng.choice(texts)) for _ in range(170)]
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).collect()
        want, _ = brute_rows(rows, 2)
        assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) and len(got) == len(rows)
    rows = [(2, texts[0]), (2, texts[30]), (7, texts[30] + " x"), (8, texts[0] + " y"), (9, ""), (9, texts[0])]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, SCHEMA), 2).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(2, 2), (7, 2), (8, 2), (9, 2)}


def test_no_tables_stay_behind(spark):
    """Of the operator's tables only the result's is left."""
    from pathlib import Path

    from seedsift.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("t-*"))
    minhash.near_duplicates(spark.createDataFrame(corpus()[:40], SCHEMA), 2)
    assert len(set(folder.glob("t-*")) - before) == 1


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:100_000]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (149_996, 1), 2: (139_996, 1), 3: (99_996, 3)}


def test_null_ids_texts_repeated_rows_and_extra_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b c d e f", 0), (5, "a b c d e f", 0), (4, "a b c d e f", 0), (4, "a b c d e f", 0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA + ", component_id long"), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (2, 2, True), (4, 4, True), (4, 4, True), (5, 4, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (8, 100, 1000):
        found = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 2**63, n - n * 3 // 4, dtype=np.uint64)])
            s = minhash.signatures([np.unique(a), np.unique(b)])
            found.append((s[0] == s[1]).mean())
        k = n * 3 // 4
        assert abs(np.mean(found) - k / (2 * n - k)) < 0.03


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(40)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
    got = {r.node: r.component for r in components.components(frame, Scratch(spark)).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == groups([e for e in edges if e[0] != e[1]], nodes)


def test_query_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in minhash.op1_near_duplicates(spark, DATA).collect()}
    assert got == brute(rows, 2)[0]
