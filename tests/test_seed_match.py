"""What a keyword shows of its seed, and the older anchors of grey keywords."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seedsift.operators import domain_anchors, seed_match

LEXICON = "word string, rank int, lemma string, pos string, case string, score double, known boolean"


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("доставка", "доставка", "NOUN", "nomn"), ("доставку", "доставка", "NOUN", "accs"), ("цветов", "цвет", "NOUN", "gent"), ("цветок", "цветок", "NOUN", "nomn"), ("москва", "москва", "NOUN", "nomn"), ("купить", "купить", "INFN", None),
        ("айфон", "айфон", "NOUN", "accs"), ("аккумулятор", "аккумулятор", "NOUN", "nomn"), ("на", "на", "PREP", None), ("скутер", "скутер", "NOUN", "accs"), ("установка", "установка", "NOUN", "nomn"),
        ("кондиционера", "кондиционер", "NOUN", "gent"), ("кондиционер", "кондиционер", "NOUN", "nomn"), ("цена", "цена", "NOUN", "nomn"), ("ремонт", "ремонт", "NOUN", "nomn"), ("самсунг", "самсунг", "NOUN", "nomn"),
        ("роза", "роза", "NOUN", "nomn"), ("букет", "букет", "NOUN", "nomn"), ("курьер", "курьер", "NOUN", "nomn"), ("привезти", "привезти", "INFN", None), ("акб", "акб", "NOUN", "nomn"), ("мопед", "мопед", "NOUN", "nomn"),
        ("вольт", "вольт", "NOUN", "nomn"), ("квартире", "квартира", "NOUN", "loct"), ("в", "в", "PREP", None), ("грн", "грн", "NOUN", None), ("подставка", "подставка", "NOUN", "nomn"), ("для", "для", "PREP", None),
    ]
    second = [("цветов", 1, "цветок", "NOUN", "gent", 0.95, True)]
    return spark.createDataFrame([(w, 0, lemma, pos, case, 1.0, True) for w, lemma, pos, case in rows] + second, LEXICON)


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame([("samsung",), ("самсунг",), ("iphone",)], "name string")


def profiles(spark, lexicon, brands, *seeds):
    return seed_match.seed_profiles(spark.createDataFrame(list(enumerate(seeds)), "seed_id long, seed string"), lexicon, brands)


def test_profiles(spark, lexicon, brands):
    got = {r.seed_id: r for r in profiles(spark, lexicon, brands, "купить айфон 16", "ремонт samsung galaxy s21", "hp laserjet", "установка кондиционера цена", "аккумулятор на скутер", "").collect()}
    assert (got[0].numbers, got[0].models, got[0].seed_class) == (["16"], ["16"], "A")
    assert (got[1].line, got[1].models, got[1].latin_brands, got[1].latin_models, got[1].seed_class) == (["samsung", "galaxy"], ["s21"], ["samsung"], ["galaxy", "s21"], "A")
    assert got[2].seed_class == "B" and got[3].seed_class == got[5].seed_class == "none"
    assert got[3].short_seed == "установка кондиционера" and got[4].short_seed is None and got[0].short_seed is None


def rules(spark, lexicon, brands, seed, *keywords):
    df = spark.createDataFrame([(0, k, None) for k in keywords], "seed_id long, keyword string, tail string")
    return {r.keyword: r.no_seed_reason for r in seed_match.no_seed_rules(df, profiles(spark, lexicon, brands, seed)).collect()}


def test_rules_without_the_seed(spark, lexicon, brands):
    got = rules(spark, lexicon, brands, "купить айфон 16", "купить айфон 14 киев", "iphone 6 16gb", "айфон 16", "айфон", "огляд айфон 16", "ціна 16")
    assert got == {"купить айфон 14 киев": "wrong_number:14", "iphone 6 16gb": "wrong_number:6", "айфон 16": None, "айфон": "wrong_model", "огляд айфон 16": "wrong_language:огляд", "ціна 16": "wrong_language:letter"}
    got = rules(spark, lexicon, brands, "ремонт samsung s21", "ремонт s21 ultra", "ремонт с21", "с21fe", "s210", "samsung a52", "s21")
    assert got == {"ремонт s21 ultra": None, "ремонт с21": None, "с21fe": None, "s210": "wrong_model", "samsung a52": "wrong_model", "s21": None}
    got = rules(spark, lexicon, brands, "hp laserjet", "laserjet p2015d", "драйвер 1018", "лазерджет", "")
    assert got == {"laserjet p2015d": None, "драйвер 1018": "wrong_brand", "лазерджет": None, "": "wrong_brand"}
    assert set(rules(spark, lexicon, brands, "доставка цветов", "букет", "роза 5").values()) == {None}
    found = spark.createDataFrame([(0, "їх", "x"), (0, "огляд", "x"), (9, "x", None)], "seed_id long, keyword string, tail string")
    assert [r.no_seed_reason for r in seed_match.no_seed_rules(found, profiles(spark, lexicon, brands, "hp")).orderBy("keyword").collect()] == [None, None, "wrong_language:letter"]


def demoted(spark, lexicon, brands, seed, *keywords):
    df = spark.createDataFrame([(0, k) for k in keywords], "seed_id long, keyword string")
    return {r.keyword: r.demoted_reason for r in seed_match.sanity_demotions(df, profiles(spark, lexicon, brands, seed), lexicon, brands).collect()}


def test_demotions(spark, lexicon, brands):
    got = demoted(spark, lexicon, brands, "ремонт samsung s21", "ремонт самсунг с21", "samsung s21 hotline", "ремонт samsung", "ремонт s21", "ремонт samsung s21 цена")
    assert got == {"ремонт самсунг с21": None, "samsung s21 hotline": "missing_intent:ремонт", "ремонт samsung": "missing_model:s21", "ремонт s21": "missing_brand", "ремонт samsung s21 цена": None}
    got = demoted(spark, lexicon, brands, "доставка цветов", "доставка цветок", "доставку цветов", "доставка", "")
    assert got == {"доставка цветок": None, "доставку цветов": None, "доставка": "missing_content:цвет", "": "missing_content:доставка,цвет"}
    got = demoted(spark, lexicon, brands, "установка кондиционера цена", "установка кондиционера olx", "установка olx")
    assert got == {"установка кондиционера olx": None, "установка olx": "missing_content:кондиционер,цена"}
    assert demoted(spark, lexicon, brands, "на 16", "x") == {"x": None}


def test_short_seeds(spark, lexicon, brands):
    p = profiles(spark, lexicon, brands, "установка кондиционера цена", "аккумулятор на скутер")
    rows = [(0, "установка кондиционера в квартире", None), (0, "установка vs", None), (0, "x", "kept"), (1, "аккумулятор на мопед", None)]
    df = spark.createDataFrame(rows, "seed_id long, keyword string, tail string").withColumn("extra", F.lit(1))
    got = {r.keyword: r.tail for r in seed_match.short_seed_tails(df, p, lexicon).collect()}
    assert got == {"установка кондиционера в квартире": "в квартире", "установка vs": None, "x": "kept", "аккумулятор на мопед": None}


def axes(spark, lexicon, *seeds):
    return domain_anchors.object_axes(spark.createDataFrame(list(enumerate(seeds)), "seed_id long, seed string"), lexicon)


def test_object_and_action(spark, lexicon):
    got = {r.seed_id: r for r in axes(spark, lexicon, "доставка цветов", "купить айфон 16", "аккумулятор на скутер", "установка кондиционера цена", "роза букет", "на", "").collect()}
    assert [got[i].object for i in range(7)] == ["цвет", "айфон", "скутер", "кондиционер", "букет", None, None]
    assert [got[i].action for i in range(7)] == ["доставка", "купить", "аккумулятор", "установка", "роза", None, None]
    assert [got[i].root for i in range(4)] == ["доста", "купи", "аккум", "устан"]
    assert (got[1].qualifier, got[1].ordinal) == ("16", "шестнадцатый") and got[0].content == ["цвет"] and got[3].content == ["установка", "кондиционер"]


VECTORS = {"скутер": [1.0, 0.0], "мопед": [0.45, 0.893], "вольт": [0.3, 0.954], "аккумулятор": [0.0, 1.0], "акб": [0.1, 0.9], "роза": [0.8, 0.6], "курьер": [0.2, 0.97]}


def judged(spark, lexicon, seed, grey, valid=(), relations=None, **more):
    vectors = spark.createDataFrame(list(VECTORS.items()), "lemma string, embedding array<double>")
    g = spark.createDataFrame([(0, k, p) for k, p in grey.items()], "seed_id long, keyword string, positive boolean")
    v = spark.createDataFrame([(0, k) for k in valid], "seed_id long, keyword string")
    out = domain_anchors.judge_domain(g, v, axes(spark, lexicon, seed), lexicon, relations, vectors, least_grey=1, **more)
    return {r.keyword: (r.domain_label, r.anchor_signal, r.action_signal) for r in out.collect()}


def test_decisions(spark, lexicon):
    relations = spark.createDataFrame([("скутер", "мотороллер", "synonym")], "lemma string, other string, rel string")
    grey = {k: False for k in ("аккумулятор скутер", "акб скутер", "подставка для скутер", "аккумулятор мотороллера", "букет грн", "аккумулятор вольт", "аккумулятор роза", "***")} | {"аккумулятор мопед": True}
    got = judged(spark, lexicon, "аккумулятор на скутер", grey, relations=relations)
    assert got["аккумулятор скутер"] == ("GREY", "substring", "action_root:аккумулятор")
    assert got["акб скутер"] == ("GREY", "substring", "action_lemma:акб")
    assert got["подставка для скутер"] == ("TRASH", "substring", "-no_action")
    assert got["аккумулятор мотороллера"] == ("GREY", "synonym_substring:мотороллер", "action_root:аккумулятор")
    assert got["букет грн"] == ("TRASH", "-no_seed_lemma", None) and got["***"] == ("TRASH", "-no_seed_lemma", None)
    assert got["аккумулятор вольт"] == ("TRASH", "-score_low", None)
    assert got["аккумулятор роза"] == ("GREY", "score", "action_root:аккумулятор")
    assert got["аккумулятор мопед"] == ("GREY", "score", "action_root:аккумулятор")  # 0.45 and the bonus of a signal


def test_short_first_word_and_qualifier(spark, lexicon):
    got = judged(spark, lexicon, "купить айфон 16", {"айфон 16": False, "айфон шестнадцатый купить": False, "купить айфон 14": False, "купить айфон 160": False, "роза айфон 16": False})
    assert got["айфон 16"] == ("TRASH", "substring", "-no_action") and got["айфон шестнадцатый купить"] == ("GREY", "substring", "action_root:купить")
    assert got["купить айфон 14"] == got["купить айфон 160"] == ("TRASH", "-no_qualifier:16", None)
    assert got["роза айфон 16"] == ("GREY", "substring", "action_abbrev:роза")
    few = domain_anchors.judge_domain(spark.createDataFrame([(0, "x")], "seed_id long, keyword string"), spark.createDataFrame([], "seed_id long, keyword string"), axes(spark, lexicon, "роза"), lexicon)
    assert [(r.domain_label, r.domain_reason, r.anchor_signal) for r in few.collect()] == [("GREY", "too_few", None)]


def test_actions_and_profile(spark, lexicon):
    valid = [(0, f"привезти роза {i}") for i in range(3)] + [(0, "скутер курьер"), (0, "курьер скутер")]
    v = spark.createDataFrame(valid, "seed_id long, keyword string")
    g = spark.createDataFrame([(0, "акб"), (0, "мопед скутер")], "seed_id long, keyword string")
    vectors = spark.createDataFrame(list(VECTORS.items()), "lemma string, embedding array<double>")
    ax = axes(spark, lexicon, "аккумулятор на скутер")
    got = {(r.lemma, r.source) for r in domain_anchors.action_set(v, g, ax, lexicon, vectors).collect()}
    assert got == {("аккумулятор", "action"), ("привезти", "verb"), ("акб", "noun"), ("курьер", "noun"), ("мопед", "noun"), ("роза", "noun")} - {("роза", "noun")}
    words = domain_anchors._words(v, ax, lexicon)
    assert [r.lemma for r in domain_anchors.object_neighbours(words).collect()] == ["курьер"]
    trash = spark.createDataFrame([(0, "акб"), (0, "вольт мопед")], "seed_id long, keyword string")
    row = domain_anchors.domain_profile(v, trash, ax, lexicon, vectors).collect()[0]
    assert (row.n_lemmas, row.threshold) == (2, 0.5) and row.trash_centroid is not None and row.trash_cos < 0.55
    near = domain_anchors.domain_profile(v, trash, ax, lexicon, vectors, too_close=0.1).collect()[0]
    assert near.trash_centroid is None and near.trash_cos > 0.1


def test_cascade_of_domains(spark, lexicon):
    kw = spark.createDataFrame([(0, f"аккумулятор скутер {i}", "GREY", 1) for i in range(9)] + [(0, "букет", "GREY", 1), (0, "букет", "VALID", 2), (1, "x", "GREY", 3)], "seed_id long, keyword string, label string, n int")
    out = {(r.keyword, r.n): (r.label, r.domain_reason) for r in domain_anchors.apply_domain(kw, axes(spark, lexicon, "аккумулятор на скутер", "роза"), lexicon).collect()}
    assert out[("букет", 1)] == ("TRASH", "no_domain_anchor") and out[("букет", 2)] == ("VALID", None) and out[("x", 3)] == ("GREY", "too_few")
    assert sum(v == ("GREY", "shown") for v in out.values()) == 9


def test_cascade_with_places_and_seed_rules(spark, lexicon, brands):
    """Places come first, keywords without their seed are judged, and what lacks the model is demoted and stays grey in the statistics."""
    from seedsift.plans import cascade

    geo = spark.createDataFrame([("москва", "ru"), ("киев", "ua"), ("йошкар-ола", "ru")], "name string, country string")
    names = spark.createDataFrame([("москва", "moscow"), ("киев", "kyiv")], "name string, canonical string")
    districts = spark.createDataFrame([("голосеевский район", "киев", "ua")], "name string, city string, country string")
    rows = {
        "доставка цветов киев": ("VALID", "l0", None), "доставка цветов йошкар": ("TRASH", "l0", None), "букет роза": ("GREY", None, None), "їх доставка": ("TRASH", "l0", "wrong_language:letter"),
    }
    other = {"ремонт s7": ("TRASH", "l0", "wrong_model"), "ремонт samsung": ("GREY", None, "sanity_mismatch:missing_model:s21"), "ремонт samsung s21 киев": ("VALID", "l0", None), "ремонт s21 киев": ("GREY", "l2", "sanity_mismatch:missing_brand")}
    kw = spark.createDataFrame(
        [(0, "доставка цветов", i, k, "suffix") for i, k in enumerate(rows)] + [(1, "ремонт samsung s21", i, k, "suffix") for i, k in enumerate(other)], "seed_id long, seed string, pos long, keyword string, family string"
    )
    out = cascade.run_cascade(kw, geo, brands, "ua", lexicon=lexicon, stages=("pre", "l0", "l2"), names=names, districts=districts, seed_rules=True)
    found = out.select("keyword", "label", "stage", "reason", "demoted").collect()
    got = {r.keyword: (r.label, r.stage, r.reason) for r in found}
    for k, (label, stage, reason) in (rows | other).items():
        assert got[k][0] == label and got[k][2] == reason and (stage is None or got[k][1] == stage), (k, got[k])
    assert {r.keyword for r in found if r.demoted} == {"ремонт s21 киев", "ремонт samsung"}
    with pytest.raises(ValueError):
        cascade.run_cascade(kw, geo, brands, "ua", names=names)
