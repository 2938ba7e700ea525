"""Agreement of tails with their seed's head, shared words, and anchors without seed and places."""

from __future__ import annotations

import pytest

from seedsift.operators import agreement, statistics


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("аккумулятор", 0, "аккумулятор", "NOUN", "masc", "sing"), ("гелевый", 0, "гелевый", "ADJF", "masc", "sing"), ("гелевая", 0, "гелевый", "ADJF", "femn", "sing"),
        ("тяговый", 0, "тяговый", "PRTF", "masc", "sing"), ("шины", 0, "шина", "NOUN", "femn", "plur"), ("зимние", 0, "зимний", "ADJF", None, "plur"),
        ("на", 0, "на", "PREP", None, None), ("скутер", 0, "скутер", "NOUN", "masc", "sing"), ("скутера", 0, "скутер", "NOUN", "masc", "sing"), ("скутера", 1, "скутера", "NOUN", "femn", "sing"),
        ("киева", 0, "киев", "NOUN", "masc", "sing"), ("москве", 0, "москва", "NOUN", "femn", "sing"),
    ]
    return spark.createDataFrame(rows, "word string, rank int, lemma string, pos string, gender string, number string")


@pytest.fixture(scope="module")
def heads(spark, lexicon):
    seeds = spark.createDataFrame([(1, "на аккумулятор скутер"), (2, "шины"), (3, "неизвестно")], "seed_id long, seed string")
    return agreement.seed_heads(seeds, lexicon)


def test_heads(heads):
    assert {r.seed_id: tuple(r)[1:] for r in heads.collect()} == {1: ("аккумулятор", "masc", "sing"), 2: ("шина", "femn", "plur"), 3: (None, None, None)}


def test_scores(spark, heads, lexicon):
    want = {
        (1, "гелевый"): 1.0, (1, "гелевая"): 0.5, (1, "тяговый"): 0.9, (1, "12в гелевая"): 0.8, (1, "скутера"): 0.0, (1, "на скутера гелевый"): 0.0, (1, "зимние"): 0.3,
        (1, ""): 0.0, (1, None): 0.0, (1, "9"): 0.0, (2, "зимние"): 1.0, (2, "гелевый"): 0.3, (3, "гелевый"): 0.0, (4, "гелевый"): 0.0,
    }
    tails = spark.createDataFrame([*want, (1, "гелевый")], "seed_id long, tail string")
    got = agreement.morph_scores(tails, heads, lexicon).collect()
    assert {(r.seed_id, r.tail): r.morph for r in got} == want and len(got) == len(want)


def test_agreement_makes_a_grey_tail_valid(spark, heads, lexicon):
    rows = [(1, i, t, t, "GREY", [], n, False) for i, (t, n) in enumerate([("гелевый", []), ("гелевая", []), ("тяговый", ["noise"])])]
    kw = spark.createDataFrame(rows, "seed_id long, pos long, keyword string, tail string, label string, positive array<string>, negative array<string>, demoted boolean")
    morph = agreement.morph_scores(kw, heads, lexicon)
    assert {r.tail: r.rule for r in statistics.l2_decisions(kw, morph=morph).collect()} == {"гелевый": "r25_morph", "гелевая": "r6_grey", "тяговый": "r6_grey"}
    assert {r.rule for r in statistics.l2_decisions(kw).collect()} == {"r6_grey"}


def test_shared_words(spark, heads):
    valid = spark.createDataFrame([(1, "(гелевый) для 12"), (1, "аккумулятор 7ah"), (2, "зимние"), (1, None)], "seed_id long, tail string")
    words = agreement.reference_words(valid, heads)
    assert {tuple(r) for r in words.collect()} == {(1, "гелевый"), (1, "7ah"), (2, "зимние")}
    grey = spark.createDataFrame([(1, "7ah, гелевый"), (1, "7ah, гелевый"), (2, "гелевый"), (1, "")], "seed_id long, tail string")
    assert sorted(tuple(r) for r in agreement.reference_overlap(grey, words).collect()) == [(1, "", []), (1, "7ah, гелевый", ["7ah", "гелевый"]), (2, "гелевый", [])]


def test_stripped_anchors(spark, lexicon):
    places = spark.createDataFrame([("киев", "UA"), ("москва", "RU"), ("tula", "ru")], "name string, country string")
    want = {"скутера гелевый": "гелевый", "гелевый киев": "", "гелевый киева": "гелевый киева", "гелевый москве и tula": "гелевый и", "скутер": "", "***": "", None: ""}
    rows = [(1, "скутер", k) for k in want] + [(1, "скутер", "скутер")]
    got = agreement.strip_to_anchor(spark.createDataFrame(rows, "seed_id long, seed string, keyword string"), places, "UA", lexicon).collect()
    assert {r.keyword: r.anchor for r in got} == want and len(got) == len(want)
    words = spark.createDataFrame([(w,) for w in ("Киева", "москве", "гелевый", None)], "word string")
    assert {r.word: r.allowed for r in agreement.city_allowed(words, places, "ua", lexicon).collect()} == {"Киева": True, "москве": False, "гелевый": True, None: True}


def test_mismatch_of_categories(spark):
    pairs = [(1, "ремонт пылесосов", "ремонтник"), (1, "ремонт пылесосов", "щербет"), (1, "ремонт пылесосов", ""), (1, "ремонт пылесосов", None), (1, None, "щербет"), (2, "абвгдежз", "абв"), (2, "ab", "ab")]
    df = spark.createDataFrame(pairs + pairs[:1], "seed_id long, seed string, tail string")
    got = agreement.category_mismatch(df).collect()
    assert len(got) == 7 and {(r.tail, round(r.overlap, 3) if r.overlap is not None else None, r.mismatch) for r in got} == {
        ("ремонтник", 0.571, False), ("щербет", 0.0, True), ("щербет", None, False), ("", None, False), (None, None, False), ("абв", 1.0, False), ("ab", 1.0, False)
    }


def test_vectors_decide_between(spark):
    seed, tails = "abcdefghijkl", ["abc mnopqrst", "abc uvwxyz12", "abc 34567890"]
    df = spark.createDataFrame([(1, seed, t) for t in tails], "seed_id long, seed string, tail string")
    vectors = spark.createDataFrame([(seed, [1.0, 0.0]), (tails[0], [1.0, 1.0]), (tails[1], [0.0, 1.0])], "text string, embedding array<double>")
    got = {r.tail: r.mismatch for r in agreement.category_mismatch(df, vectors).collect()}
    assert got == dict(zip(tails, (False, True, False)))


def test_every_grey_tail_is_decided(spark):
    """Tails without words have no frequency and are decided all the same; of a tail's keywords the first says whether it was demoted."""
    rows = [(1, "a", "\u00a0", "GREY", False), (1, "b", " ", "GREY", True), (1, "c", "цена", "VALID", False), (1, "d", "цена", "GREY", True), (1, "e", "цена", "GREY", False), (1, "f", "фото", "GREY", False), (1, "g", "фото", "GREY", True)]
    rows += [(1, "h", "", "GREY", False), (1, "i", None, "GREY", False), (1, "j", "обзор", "TRASH", False)]
    none = [[], []]
    kw = spark.createDataFrame([(*r, *none) for r in rows], "seed_id long, pos string, tail string, label string, demoted boolean, positive array<string>, negative array<string>")
    got = {r.tail: (r.rule, round(2**r.pmi - 1)) for r in statistics.l2_decisions(kw, 1.5).collect()}
    assert got == {"\u00a0": ("r6_grey", 0), " ": ("r0_demoted", 0), "цена": ("r0_demoted", 3), "фото": ("r1_pmi", 2)}
