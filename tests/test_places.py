"""Places beside the seed's own, truncated names, districts, regions, and tails that a place opens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seedsift.operators import geo_tails, place_words, places, tails

LEXICON = "word string, rank int, lemma string, pos string, case string, score double, known boolean, grammemes array<string>"


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("доставка", "доставка", "NOUN", True, []), ("цветов", "цветок", "NOUN", True, []), ("цветы", "цветок", "NOUN", True, []), ("на", "на", "PREP", True, []), ("дом", "дом", "NOUN", True, []),
        ("киев", "киев", "NOUN", True, ["Geox"]), ("киеве", "киев", "NOUN", True, ["Geox"]), ("днепр", "днепр", "NOUN", True, ["Geox"]), ("харьков", "харьков", "NOUN", True, ["Geox"]), ("харьковский", "харьков", "ADJF", True, []),
        ("район", "район", "NOUN", True, []), ("районе", "район", "NOUN", True, []), ("голосеевский", "голосеевский", "ADJF", True, []), ("новый", "новый", "ADJF", True, ["Qual"]), ("моём", "мой", "ADJF", True, ["Apro"]),
        ("корпус", "корпус", "NOUN", True, []), ("москва", "москва", "NOUN", True, ["Geox"]), ("два", "два", "NUMR", True, []), ("час", "час", "NOUN", True, ["inan"]),
        ("йошкар", "йошкар", "NOUN", False, []), ("ремонт", "ремонт", "NOUN", True, []), ("пылесосов", "пылесос", "NOUN", True, []), ("отзывы", "отзыв", "NOUN", True, []), ("роза", "роза", "NOUN", True, ["Name"]),
    ]
    return spark.createDataFrame([(w, 0, lemma, pos, None, 1.0, known, marks) for w, lemma, pos, known, marks in rows], LEXICON)


@pytest.fixture(scope="module")
def dims(spark):
    geo = spark.createDataFrame(
        [("киев", ["ua"]), ("днепр", ["ua"]), ("харьков", ["ua"]), ("южное", ["ua"]), ("москва", ["ru"]), ("йошкар-ола", ["ru"]), ("набережные челны", ["ru"]), ("ростов-на-дону", ["ru"]), ("корпус кристи", ["us"]), ("два ручья", ["ua"]), ("кривой рог", ["ua"]), ("южно-украинск", ["ua"])],
        "name string, countries array<string>",
    )
    names = spark.createDataFrame([("киев", "kyiv"), ("київ", "kyiv"), ("днепр", "dnipro"), ("харьков", "kharkiv"), ("дом", "dome"), ("южное", "yuzhne"), ("москва", "moscow")], "name string, canonical string")
    districts = spark.createDataFrame([("голосеевский район", "київ", "ua"), ("позняки", "киев", "ua"), ("южное бутово", "москва", "ru")], "name string, city string, country string")
    return geo, names, districts


def test_parts_of_compound_names(dims):
    got = {r.part: r.name for r in places.name_parts(dims[0]).collect()}
    assert got == {"йошкар": "йошкар-ола", "набережные": "набережные челны", "челны": "набережные челны", "ростов": "ростов-на-дону", "корпус": "корпус кристи", "кристи": "корпус кристи", "два": "два ручья", "ручья": "два ручья", "кривой": "кривой рог", "южно": "южно-украинск", "украинск": "южно-украинск"}


def signals(spark, dims, lexicon, seed, *tail):
    df = spark.createDataFrame([(1, seed, t) for t in tail], "seed_id long, seed string, tail string")
    out = places.place_signals(df, *dims, "ua", lexicon)
    flags = [c for c in out.columns if c not in ("seed_id", "seed", "tail", "seed_city")]
    return {r.tail: {f for f in flags if r[f]} for r in out.collect()}


def test_truncated_names(spark, dims, lexicon):
    got = signals(spark, dims, lexicon, "ремонт пылесосов", "йошкар", "челны", "южно", "корпус", "два", "киев", "дону", "йошкар ола", "12", "")
    both = {"truncated", "truncated_foreign"}
    assert got == {"йошкар": both, "челны": both, "южно": {"truncated"}, "корпус": {"truncated"}, "два": set(), "киев": set(), "дону": set(), "йошкар ола": set(), "12": set(), "": set()}


def test_districts_and_cities_beside_the_seeds_city(spark, dims, lexicon):
    seed = "ремонт пылесосов днепр"
    got = signals(spark, dims, lexicon, seed, "голосеевский район", "голосеевский районе", "новый район", "моём район", "харьков", "харьковский район", "позняки", "москва", "южное", "днепр", "жк харьков", "отзывы")
    assert got["голосеевский район"] == got["голосеевский районе"] == {"wrong_district"}
    assert got["новый район"] == got["харьковский район"] == {"unknown_district"} and got["моём район"] == set()
    assert got["харьков"] == got["южное"] == {"wrong_city"}
    assert got["позняки"] == got["москва"] == got["днепр"] == got["жк харьков"] == got["отзывы"] == set()
    none = signals(spark, dims, lexicon, "ремонт пылесосов", "голосеевский район", "новый район", "харьков")
    assert all(not v for v in none.values())
    own = signals(spark, dims, lexicon, "ремонт пылесосов київ", "голосеевский район")
    assert own["голосеевский район"] == set()


def test_common_nouns_are_no_seed_cities(spark, dims, lexicon):
    terms = places.place_terms(*dims, "ua")
    seeds = spark.createDataFrame([(1, "доставка цветов на дом"), (2, "билеты харьков киеве"), (3, ""), (4, "харьковский дом")], "seed_id long, seed string")
    got = {r.seed_id: (r.city, r.cities) for r in places.seed_cities(seeds, terms, lexicon).collect()}
    assert got == {1: (None, []), 2: ("kharkiv", ["kharkiv", "kyiv"]), 3: (None, []), 4: ("kharkiv", ["kharkiv"])}


def test_content_after_the_seeds_city(spark, dims, lexicon):
    rows = [("ремонт пылесосов днепр отзывы", True), ("ремонт новый пылесосов днепр", False), ("днепр ремонт днепр на", False), ("ремонт пылесосов", False), ("", False)]
    df = spark.createDataFrame([(k, "ремонт пылесосов днепр") for k, _ in rows], "keyword string, seed string")
    got = {r.keyword: r.after_city for r in places.content_after_city(df, *dims, "ua", lexicon).collect()}
    assert got == dict(rows)


def test_settling(spark):
    rows = [(["geo", "commerce"], ["truncated_geo"], False, True, "dnipro"), (["commerce"], ["foreign_geo", "meta"], True, False, None), ([], ["foreign_geo"], True, False, "dnipro")]
    df = spark.createDataFrame(rows, "positive array<string>, negative array<string>, own_geo boolean, after_city boolean, seed_city string")
    got = [(r.positive, r.negative) for r in places.settle_places(df).collect()]
    assert got == [(["commerce"], ["truncated_geo"]), (["commerce", "geo"], ["meta"]), ([], [])]


def geo_tail(spark, dims, lexicon, seed, *keywords):
    geo, _, districts = dims
    countries = spark.createDataFrame([("украина", "ua"), ("россия", "ru")], "name string, country string")
    kinds = geo_tails.place_kinds(geo, countries, districts, "ua")
    df = spark.createDataFrame([(k, seed) for k in keywords], "keyword string, seed string")
    return {r.keyword: r.geo_tail for r in geo_tails.geo_first_tail(df, kinds, lexicon).collect()}


def test_geo_first_tails(spark, dims, lexicon):
    got = geo_tail(
        spark, dims, lexicon, "доставка цветов на дом", "доставка цветов киев", "Цветы киеве", "доставка кривой рог", "доставка цветов москва", "доставка южное бутово", "киев", "доставка корпус кристи киев", "доставка набережные челны", "доставка украина роза", "доставка цветов на дом"
    )
    assert got == {
        "доставка цветов киев": "киев", "Цветы киеве": "киеве", "доставка кривой рог": "кривой рог", "доставка цветов москва": None, "доставка южное бутово": None, "киев": None,
        "доставка корпус кристи киев": None, "доставка набережные челны": None, "доставка украина роза": "украина роза", "доставка цветов на дом": None,
    }
    assert geo_tail(spark, dims, lexicon, "купить s21", "s21 киев") == {"s21 киев": None}
    assert geo_tail(spark, dims, lexicon, "доставка киев", "доставка киев") == {"доставка киев": None}


def test_tails_with_places_come_first(spark, dims, lexicon):
    kinds = geo_tails.place_kinds(dims[0], None, dims[2], "ua")
    df = spark.createDataFrame([(1, "доставка цветов киев", "доставка цветов на дом"), (1, "доставка цветов на дом киев", "доставка цветов на дом"), (1, "совсем другое", "доставка цветов на дом")], "seed_id long, keyword string, seed string")
    assert [r.tail for r in tails.extract_tail(df, lexicon, places=kinds).collect()] == ["киев", "киев", None]
    assert [r.tail for r in tails.extract_tail(df, lexicon).collect()] == [None, "киев", None]


def test_region_adjectives(spark):
    words = spark.createDataFrame([("одесская",), ("минская",), ("красная",), ("львовский",), ("ская",), (None,)], "word string")
    cities = spark.createDataFrame([("одеса",), ("минск",), ("львов",), ("одесь",)], "name string")
    got = {r.word: r.city for r in place_words.region_adjectives(words, cities).collect()}
    assert got == {"одесская": "одеса", "минская": "минск", "львовский": "львов"}


def test_regions_of_other_cities(spark):
    kw = spark.createDataFrame([(1, 1, "ремонт одесская область"), (1, 2, "ремонт львовская обл"), (1, 3, "ремонт одесская"), (2, 4, "ремонт одесская область"), (1, 5, "киев область"), (1, 6, "днепра область")], "seed_id long, kw_id long, keyword string")
    known = spark.createDataFrame([("одеса", "city", "ua", "17"), ("львов", "city", "ua", "15"), ("киев", "city", "ua", "12"), ("днепр", "city", "ua", "4")], "word string, kind string, country string, admin1 string")
    seeds = spark.createDataFrame([(1, "киев", "ua", "12")], "seed_id long, city string, country string, admin1 string")
    got = {r.kw_id: r.cities for r in place_words.other_regions(kw, seeds, known).collect()}
    assert got == {1: ["одеса"], 2: ["львов"], 6: ["днепр"]}


def test_words_that_are_no_cities(spark, lexicon):
    words = spark.createDataFrame([("час",), ("киев",), ("роза",), ("на",), ("йошкар",), ("unknown",), ("Час",)], "word string")
    got = {r.word: {c for c in ("skip_geo", "common_noun", "homonym", "everyday") if r[c]} for r in place_words.word_features(words, lexicon).collect()}
    assert got["час"] == {"skip_geo", "homonym", "everyday"} and got["роза"] == {"skip_geo", "homonym", "everyday"}
    assert got["киев"] == got["йошкар"] == got["unknown"] == got["Час"] == set() and got["на"] == {"skip_geo", "homonym"}
    rows = [("уфа", 1, True), ("бош", 10**6, False), ("lima", 10**7, False), ("paris", 10**6, True), ("honda", 28000, False), ("ял", 5, False), ("usa1", 5, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "word string, pop long")
    assert [r.c for r in df.select(place_words.real_city().alias("c")).collect()] == [r[2] for r in rows]
    assert [r.c for r in df.select(place_words.brand_like().alias("c")).collect()] == [True] * 7


def test_lookup_of_places(spark, lexicon):
    rows = [("киев", "ua", 5, "1", "P"), ("киев", "ru", 9, "2", "P"), ("елка", "ua", 1, "3", "A"), ("хата", "tr", 1, "3", "A"), ("москва", "ru", 3, None, "C"), ("япон", "jp", 3, None, "C"), ("usa", "us", None, None, "C"), ("usa", "ru", 4, "1", "P"), ("ab", "us", 3, None, "P")]
    places_ = spark.createDataFrame(rows, "name string, country string, pop long, admin1 string, fclass string")
    words = spark.createDataFrame([(w,) for w in ("киев", "ёлка", "хата", "москва", "япон", "usa", "ab", "нет", None)], "word string")
    got = {r.word: (r.kind, r.country) for r in place_words.place_lookup(words, places_, "ua", lexicon).collect()}
    assert got == {"киев": ("city", "ru"), "ёлка": ("city", "ua"), "москва": ("country", "ru"), "usa": ("country", "us")}
    listed = spark.createDataFrame([("киев", "xx")], "name string, country string")
    assert {r.word: r.country for r in place_words.place_lookup(words, places_, "ua", lexicon, listed).collect()}["киев"] == "xx"


def test_other_cities(spark):
    lexicon = spark.createDataFrame(
        [(w, 0, pos, case, marks) for w, pos, case, marks in (
            ("киев", "NOUN", "nomn", ["Geox"]), ("одесса", "NOUN", "nomn", ["Geox"]), ("одессе", "NOUN", "loct", ["Geox"]), ("кальян", "NOUN", "nomn", []), ("героев", "NOUN", "gent", []), ("днепра", "NOUN", "gent", ["Geox"]),
            ("киевская", "ADJF", "nomn", []), ("одесская", "ADJF", "nomn", []), ("варшава", "NOUN", "nomn", ["Geox"]), ("харьковский", "ADJF", "nomn", []))],
        "word string, rank int, pos string, case string, grammemes array<string>",
    )
    rows = [("киев", 3, "12", "P", "ua"), ("одесса", 10**6, "17", "P", "ua"), ("одесс", 10**6, "17", "P", "ua"), ("кальян", 10**6, "1", "P", "in"), ("днепр", 10**6, "4", "P", "ua"), ("паркленд", 16000, "1", "P", "dk"), ("час", 10**6, "1", "P", "cz"), ("варшава", 10**6, "1", "P", "pl"),
            ("гагарина", 20000, "1", "P", "ru"), ("bosch", 10**6, "1", "P", "nl"), ("киевская", 10**6, "12", "A", "ua"), ("одесская", 10**6, "17", "A", "ua"), ("нью йорк", 8 * 10**6, "1", "P", "us"), ("харьковский", 10**6, "7", "P", "ua"), ("софия", 10**6, "7", "P", "bg"), ("ремонт", 10**6, "7", "P", "bg")]
    known = spark.createDataFrame([(w, "city", c, pop, a, f) for w, pop, a, f, c in rows], "word string, kind string, country string, pop long, admin1 string, fclass string")
    districts = spark.createDataFrame([("гагарина", "одесса"), ("варшава", "славянск"), ("позняки", "киев")], "name string, city string")
    brands = spark.createDataFrame([("Bosch",)], "name string")
    want = {
        "ремонт киев одесса": ["одесса"], "ремонт в одессе": ["одесс"], "кальян киев": None, "героев днепра": None, "паркленд киев": None, "в паркленд": ["паркленд"], "час киев": None, "варшава": ["варшава"], "гагарина": None, "на гагарина": None,
        "bosch": None, "киевская": None, "одесская": ["одесская"], "нью йорк": ["нью йорк"], "харьковский район": None, "жк софия": None, "софия": ["софия"], "ремонт": None, "киев": None,
    }
    kw = spark.createDataFrame([(1, i, k) for i, k in enumerate(want)] + [(2, 99, "одесса")], "seed_id long, kw_id long, keyword string")
    seeds = spark.createDataFrame([(1, "ремонт киев"), (2, "ремонт")], "seed_id long, seed string")
    cities = spark.createDataFrame([(1, "киев", "ua", "12")], "seed_id long, city string, country string, admin1 string")
    found = {r.kw_id: r.cities for r in place_words.other_cities(kw, seeds, cities, known, districts, brands, lexicon).collect()}
    assert {k: found.get(i) for i, k in enumerate(want)} == want and 99 not in found


def test_regions_abroad(spark):
    kw = spark.createDataFrame([(1, 1, "ремонт крым"), (1, 2, "ремонт пермский край"), (1, 3, "пермский край позняки"), (1, 4, "ремонт волынь")], "seed_id long, kw_id long, keyword string")
    regions = spark.createDataFrame([("крым", "ru"), ("пермский край", "ru"), ("волынь", "ua")], "name string, country string")
    districts = spark.createDataFrame([("позняки",)], "name string")
    got = {r.kw_id: r.reason for r in place_words.foreign_regions(kw, regions, districts, "ua").collect()}
    assert got == {1: "region:крым", 3: "region:пермский край"}


def test_empty_tables(spark, dims, lexicon):
    none = spark.createDataFrame([], "seed_id long, seed string, tail string, keyword string")
    assert places.place_signals(none.drop("keyword"), *dims, "ua", lexicon).count() == 0
    assert places.content_after_city(none.drop("tail"), *dims, "ua").count() == 0
    kinds = geo_tails.place_kinds(dims[0], None, None, "ua")
    assert geo_tails.geo_first_tail(none.withColumn("x", F.lit(1)), kinds).count() == 0
