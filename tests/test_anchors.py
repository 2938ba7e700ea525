"""Axes of seeds and the proofs that grey keywords need."""

from __future__ import annotations

import pytest

from seedsift.operators import anchors
from seedsift.plans import cascade

LEXICON = """word string, rank int, lemma string, pos string, known boolean, grammemes array<string>"""


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("купить", 0, "купить", "INFN", True), ("заказать", 0, "заказать", "INFN", True), ("айфон", 0, "айфон", "NOUN", True), ("доставка", 0, "доставка", "NOUN", True),
        ("цветов", 0, "цвет", "NOUN", True), ("цветов", 1, "цветок", "NOUN", True), ("роза", 0, "роза", "NOUN", True), ("букет", 0, "букет", "NOUN", True),
        ("киев", 0, "киев", "NOUN", True), ("где", 0, "где", "ADVB", True), ("нимесил", 0, "нимесить", "VERB", False), ("нимесил", 1, "нимесил", "NOUN", False),
        ("шестнадцатый", 0, "шестнадцатый", "ADJF", True), ("на", 0, "на", "PREP", True), ("хлеб", 0, "хлеб", "NOUN", True), ("тюльпан", 0, "тюльпан", "NOUN", True),
        ("ящик", 0, "ящик", "NOUN", True),
    ]
    return spark.createDataFrame([(*r, ["Anum"] if r[0] == "шестнадцатый" else []) for r in rows], LEXICON)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("доставка", 2, True), ("цвет", 1, False), ("цветок", 9, False), ("айфон", 0, False), ("киев", 0, False)], "lemma string, hyponyms int, deverbal boolean")


def axes_of(spark, lexicon, facts, *seeds):
    df = spark.createDataFrame(list(enumerate(seeds)), "seed_id long, seed string")
    return {r.seed_id: (r.action, r.object, r.others, r.qualifier) for r in anchors.seed_axes(df, lexicon, facts).collect()}


def test_axes(spark, lexicon, facts):
    got = axes_of(spark, lexicon, facts, "купить айфон 16", "доставка цветов киев", "цветов доставка", "нимесил", "на", "", "ремонт s21")
    assert got[0] == ("купить", "айфон", [], "16")
    assert got[1] == ("доставка", "цветок", ["киев"], None)
    assert got[2] == ("доставка", "цветок", [], None)
    assert got[3] == (None, "нимесил", [], None)
    assert got[4] == got[5] == (None, None, [], None)
    assert got[6] == (None, None, [], None)


def test_axes_without_thesaurus(spark, lexicon):
    assert axes_of(spark, lexicon, None, "доставка хлеб роза")[0] == ("доставка", "роза", ["хлеб"], None)


def judged(spark, lexicon, facts, seed, grey, valid=(), **more):
    axes = anchors.seed_axes(spark.createDataFrame([(1, seed)], "seed_id long, seed string"), lexicon, facts)
    g, v = (spark.createDataFrame([(1, k) for k in x], "seed_id long, keyword string") for x in (grey, valid))
    return {r.keyword: r for r in anchors.judge_grey(g, v, axes, lexicon, **more).collect()}


def test_proofs(spark, lexicon, facts):
    relations = spark.createDataFrame([("цветок", "букет", "synonym"), ("цветок", "тюльпан", "cohyponym"), ("доставка", "заказать", "synonym")], "lemma string, other string, rel string")
    vectors = spark.createDataFrame([("цветок", [1.0, 0.0]), ("роза", [1.0, 0.1]), ("хлеб", [1.0, 0.0]), ("доставка", [0.0, 1.0])], "lemma string, embedding array<double>")
    valid = ["доставка цветов роза", "цветов роза", "где доставка цветов", "где доставка роза", "ящик цветов", "цветов ящик"]
    grey = ["доставка хлеб", "заказать букет", "заказать букет", "доставка тюльпан", "доставка роза", "где роза", "ящик заказать", "букет", "***"]
    got = judged(spark, lexicon, facts, "доставка цветов", grey, valid, relations=relations, vectors=vectors)
    assert len(got) == 8
    assert {k: (r.anchor_label, r.object_proof, r.action_proof) for k, r in got.items()} == {
        "доставка хлеб": ("TRASH", None, "substring"), "заказать букет": ("GREY", "synonym", "synonym"), "доставка тюльпан": ("GREY", "cohyponym", "substring"),
        "доставка роза": ("GREY", "hyponym", "substring"), "где роза": ("GREY", "hyponym", "question_word"), "ящик заказать": ("GREY", "short_first_word", "synonym"),
        "букет": ("TRASH", "synonym", None), "***": ("TRASH", None, None),
    }
    assert got["букет"].anchor_reason == "axis_unproven:act" and got["***"].anchor_reason == "empty"


def test_others_and_numbers(spark, lexicon, facts):
    got = judged(spark, lexicon, facts, "доставка цветов киев", ["доставка цветов", "доставка цветов киев"])
    assert got["доставка цветов"].anchor_reason == "others_missing:киев" and got["доставка цветов"].anchor_label == "GREY_SOFT"
    assert got["доставка цветов киев"].anchor_label == "GREY"
    vectors = spark.createDataFrame([("16", [1.0, 0.0]), ("шестнадцатый", [1.0, 0.1])], "lemma string, embedding array<double>")
    keys = ["купить айфон 16", "купить айфон 16е", "купить айфон 160", "купить айфон шестнадцатый", "купить айфон"]
    got = judged(spark, lexicon, facts, "купить айфон 16", keys, vectors=vectors)
    assert [got[k].anchor_label for k in keys] == ["GREY", "GREY", "TRASH", "GREY", "TRASH"]
    assert got["купить айфон"].anchor_reason == "qualifier_missing:16"


def test_no_rows(spark, lexicon, facts):
    assert judged(spark, lexicon, facts, "купить айфон", []) == {}
    axes = anchors.seed_axes(spark.createDataFrame([], "seed_id long, seed string"), lexicon, facts)
    grey = spark.createDataFrame([(7, "роза"), (7, None)], "seed_id long, keyword string")
    got = {r.keyword: r.anchor_label for r in anchors.judge_grey(grey, grey.limit(0), axes, lexicon).collect()}
    assert got == {"роза": "GREY", None: "TRASH"}


def test_stage_of_the_cascade(spark, lexicon, facts):
    keys = ["доставка цветов", "доставка хлеб", "доставка цветов хлеб", "заказать букет", "доставка букет"]
    rows = spark.createDataFrame([(1, "доставка цветов", i, k, "suffix") for i, k in enumerate(keys)], "seed_id long, seed string, pos long, keyword string, family string")
    words = lexicon.selectExpr("*", "'nomn' as case", "'sing' as number", "'masc' as gender", "1.0 as score")
    relations = spark.createDataFrame([("цветок", "букет", "synonym")], "lemma string, other string, rel string")
    places, brands = spark.createDataFrame([], "name string, country string"), spark.createDataFrame([], "name string")
    run = {s: cascade.run_cascade(rows, places, brands, "UA", lexicon=words, stages=s, thesaurus={"facts": facts, "relations": relations}) for s in (("pre", "l0"), ("pre", "l0", "anchor"))}
    before, after = ({r.keyword: (r.label, r.stage, r.reason) for r in df.collect()} for df in run.values())
    assert before.keys() == after.keys() == {*keys}
    for key, missing in {"доставка хлеб": "obj", "заказать букет": "act"}.items():
        assert before[key][0] == "GREY" and after[key] == ("TRASH", "anchor", f"axis_unproven:{missing}")
    same = {*keys} - {"доставка хлеб", "заказать букет"}
    assert {k: before[k] for k in same} == {k: after[k] for k in same}


def test_anchor_stage_needs_a_lexicon(spark):
    with pytest.raises(ValueError):
        cascade.run_cascade(None, None, None, "UA", stages=("pre", "l0", "anchor"))
