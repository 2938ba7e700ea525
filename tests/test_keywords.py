import pytest
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import arbitration, clean, clusters, detectors, expand, fold, tails, verdicts
from seedsift.plans import cascade

KW = "seed_id long, seed string, pos long, keyword string"
SEED = "ремонт пылесосов"


def kw(spark, *keywords, seed=SEED):
    return spark.createDataFrame([(1, seed, i, k) for i, k in enumerate(keywords)], KW)


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("keyword", "reason"),
    [
        ("ремонт пылесосов ремонт пылесосов", "dup_seed"), ("ремонт а пылесосов", "noise_letter"), ("ремонт пылесосов б у", None), ("ремонт пылесосов 7 а", None),
        ("ремонт пылесосов ремонт", "echo"), ("ремонт пылесосов пылесосов ремонт", "all_seed"), ("ремонт пылесосов цена цена", "repeat"), ("ремонт пылесосов ж", "single_char"),
        ("ремонт пылесосов 24/7", None), ("ремонт пылесосов **", "symbol"), ("ремонт пылесосов №1", None), ("ремонт пылесосов киев", None), ("repair of vacuum cleaners", "language"),
        ("ремонт пылесосовж", None), ("ремонт пылесосов", None), ("", None),
    ],
)
def test_sanitary_rules(spark, keyword, reason):
    assert clean.pre_filter(kw(spark, keyword)).first()["reason"] == reason


def test_first_wins_and_blocked(spark):
    rows = kw(spark, "Киев ", "киев", " ", "a  b", "A B", None)
    assert [r.keyword for r in clean.dedupe_first(rows).orderBy("pos").collect()] == ["Киев ", "a  b", "A B"]
    assert [r.keyword for r in clean.dedupe_ws(rows).orderBy("pos").collect()] == ["Киев ", "a  b"]
    assert clean.dedupe_first(clean.dedupe_first(rows)).count() == 3
    assert [r.keyword for r in clean.blocked(rows, rows.where("pos < 3")).where("keyword is not null").orderBy("pos").collect()] == ["a  b", "A B"]


@pytest.mark.parametrize(
    ("seed", "keyword", "tail"),
    [
        (SEED, "Ремонт  пылесосов киев", "киев"), (SEED, "ремонт пылесосов", ""), (SEED, "срочный ремонт любых пылесосов дома", "срочный любых дома"),
        (SEED, "пылесосов ремонт киев", "киев"), (SEED, "ремонт холодильников", None), ("купить айфон 16", "купить айфон 16е", None), (SEED, None, None),
    ],
)
def test_tails(spark, seed, keyword, tail):
    assert tails.extract_tail(kw(spark, keyword, seed=seed)).first()["tail"] == tail


def test_tails_by_lemma(spark):
    lexicon = spark.createDataFrame([("пылесоса", 0, "пылесос"), ("пылесосов", 0, "пылесос"), ("пылесоса", 1, "other")], "word string, rank int, lemma string")
    rows = kw(spark, "ремонт пылесоса дома", "ремонт пылесоса ремонт пылесоса")
    got = {r.keyword: r.tail for r in tails.extract_tail(rows, lexicon).collect()}
    assert got["ремонт пылесоса дома"] == "дома"
    assert [r.payload for r in tails.extract_payload(rows, lexicon).orderBy("pos").collect()] == ["дома", ""]
    assert tails.extract_tail(rows.select("*", F.lit("clash").alias("tail_")), lexicon).columns[-1] == "tail"


@pytest.mark.parametrize(
    ("positive", "negative", "label", "confidence"),
    [
        (["geo"], [], "VALID", 0.9), ([], [], "GREY", 0.5), ([], ["category_mismatch", "orphan_genitive"], "GREY", 0.4), ([], ["duplicate"], "TRASH", 0.895), ([], ["dangling"], "TRASH", 0.88),
        (["geo"], ["foreign_geo"], "TRASH", 0.9), (["info_intent"], ["meta", "fragment"], "VALID", 0.7), (["brand"], ["dangling"], "VALID", 0.75), (["commerce"], ["duplicate"], "TRASH", 0.65),
        (["commerce", "action"], ["meta"], "GREY", 0.3), (["commerce", "action"], ["fragment"], "VALID", 0.6), (["action"], ["fragment"], "GREY", 0.3), (["action"], ["fragment", "dangling"], "TRASH", 0.6),
        ([], ["own_signal"], "GREY", 0.4),
    ],
)
def test_arbitration(spark, positive, negative, label, confidence):
    row = spark.createDataFrame([(positive, negative)], "positive array<string>, negative array<string>")
    got = arbitration.arbitrate(row).first()
    assert (got.label, round(got.confidence, 6)) == (label, pytest.approx(confidence))


def signals_of(spark, tail, seed=SEED, retailers=None):
    pairs = spark.createDataFrame([(1, seed, tail)], "seed_id long, seed string, tail string")
    places = spark.createDataFrame([("киев", "UA"), ("нью йорк", "US"), ("москва", "RU")], "name string, country string")
    brands = spark.createDataFrame([("dyson",), ("xiaomi",), ("v15",)], "name string")
    r = detectors.signals(detectors.dictionary_hits(pairs, places, brands, "ua", retailers)).first()
    return set(r.positive), set(r.negative)


@pytest.mark.parametrize(
    ("tail", "positive", "negative"),
    [
        ("киев", {"geo"}, set()), ("нью йорк", set(), {"foreign_geo"}), ("dyson v15", {"brand", "model_variant"}, set()), ("xiaomi dyson", {"brand"}, {"brand_collision"}),
        ("12 в", {"product_spec"}, set()), ("220ом", {"product_spec"}, set()), ("ssd 512 gb", {"product_spec", "model_variant"}, set()), ("цена цена", {"commerce"}, {"duplicate"}), ("цена или цена", {"commerce"}, set()),
        ("где плюс где минус", {"info_intent"}, set()), ("galaxy 15 galaxy", set(), set()), ("отличия", set(), {"noise_suffix"}), ("ремонт", set(), {"seed_echo"}), ("info@mail.ru", set(), {"tech_garbage"}),
        ("0931234567", set(), {"tech_garbage", "standalone_num"}), ("2024", set(), set()), ("202", set(), {"standalone_num"}), ("рrice", set(), {"mixed_alpha"}),
    ],
)
def test_detectors(spark, tail, positive, negative):
    assert signals_of(spark, tail) == (positive, negative)


def test_retailers(spark):
    shops = spark.createDataFrame([("розетка", ["ua"]), ("озон", ["ru"]), ("amazon", ["*"]), ("эль дорадо", ["ru"])], "name string, countries array<string>")
    assert signals_of(spark, "озоном", retailers=shops) == ({"retailer"}, {"retailer_foreign"})
    assert signals_of(spark, "озон", retailers=shops) == ({"retailer"}, {"retailer_foreign"})
    assert signals_of(spark, "эль дорадо", retailers=shops)[1] == {"retailer_foreign"}
    assert signals_of(spark, "amazon", retailers=shops)[1] == set()
    assert "retailer" not in signals_of(spark, "розеточный", retailers=shops)[0]


def test_registered_detector(spark):
    detectors.register_detector("long_tail", False, 0.7, lambda: F.size("_tw") > 4)
    try:
        assert "long_tail" in signals_of(spark, "a1 b2 c3 d4 e5")[1]
    finally:
        del detectors.REGISTRY["long_tail"]


def test_cascade_adds_up(spark):
    rows = kw(spark, "ремонт пылесосов киев", "РЕМОНТ ПЫЛЕСОСОВ КИЕВ", "ремонт пылесосов", "ремонт пылесосов ремонт", "ремонт пылесосов москва", "ремонт пылесосов тир", None)
    rows = rows.withColumn("family", F.lit("suffix"))
    places = spark.createDataFrame([("киев", "UA"), ("москва", "RU")], "name string, country string")
    got = {r.keyword: (r.label, r.group, r.reason) for r in cascade.run_cascade(rows, places, spark.createDataFrame([], "name string"), "UA").collect()}
    assert got == {
        "ремонт пылесосов киев": ("VALID", "geo", None), "ремонт пылесосов": ("VALID", "exact_seed", None), "ремонт пылесосов ремонт": ("TRASH", None, "echo"),
        "ремонт пылесосов москва": ("TRASH", None, None), "ремонт пылесосов тир": ("GREY", None, None),
    }


def test_text_functions(spark):
    assert one(spark, X.fingerprint("t"), t="Б а, б!") == "а|б"
    assert one(spark, X.stem_fingerprint("t"), t="купить аккумулятор до кота и") == "аккумуля|до|кота|купи"
    assert one(spark, X.detect_language("t"), t="їжак") == "uk" and one(spark, X.detect_language("t"), t="Кот") == "ru" and one(spark, X.detect_language("t"), t="cat") == "en"
    assert one(spark, X.strip_tags("t"), t=" <b>a</b> b ") == "a b" and one(spark, X.uule("t"), t="Kyiv") == "w+ES3lpdg=="


def test_expansion(spark):
    seeds = expand.analyze_seeds(spark.createDataFrame([(1, "купить айфон"), (2, "a b c d e f"), (3, "айфон 16 для дома")], "seed_id long, seed string"))
    probes = expand.block_self_match(expand.probe_priority(expand.expand_suffix(seeds, spark)))
    got = {(r.seed_id, r.struct): (r.query, r.cp, r.priority, r.blocked_by) for r in probes.collect()}
    assert got[1, "купить *_v1"] == ("купить айфон купить *", 21, 0, "word_self_match:купить") and got[3, "для *_v2"][3] == "prep_self_match:для"
    assert {s for i, s in got if i == 2} == {":_v1", ":_v2", "&_v1", "&_v2"} and got[1, "как *_v3"][1] == 12
    assert expand.expand_numbers(seeds, spark).select("seed_id").distinct().collect()[0][0] == 3
    pruned = expand.prune_templates(expand.suffix_templates(spark), spark.createDataFrame([("suffix", "в *_v1")], "family string, struct string"))
    assert pruned.count() == expand.suffix_templates(spark).count() - 1


def test_replies(spark):
    replies = spark.createDataFrame([(1, 4, "1, 0,5\n1,1"), (2, 2, None), (3, 1, "1,1,1")], "batch_id long, n int, reply string")
    got = {(r.batch_id, r.i): r.verdict for r in verdicts.labels_table(replies).collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (1, 2): None, (1, 3): None, (2, 0): None, (2, 1): None, (3, 0): 1}
    text = "```\n1:A(geo, city),2:B(x),3:A,4:C,bad,1:B,x:A```"
    rows = clusters.parse_assignments(spark.createDataFrame([(0, text)], "chunk long, reply string")).collect()
    assert sorted((r.local_id or 0, r.name or "", r.problem or "") for r in rows) == [(0, "", "bad_pair"), (0, "", "bad_pair"), (1, "geo, city", "duplicate_id"), (2, "x", ""), (3, "geo, city", ""), (4, "", "unknown_code")]


def test_folding_garbage(spark):
    df = spark.createDataFrame([("ремонт пылесосов *", SEED), ("ремонт пылесосов ж дома", SEED), ("ремонт пылесосов киев", SEED), ("ремонт пылесосов тир", SEED)], "k string, s string")
    assert [r.x for r in df.select(fold.garbage_suffix("k", "s").alias("x")).collect()] == [True, True, False, True]
    assert [r.x for r in df.select(fold.letter_artifact("k", "s").alias("x")).collect()] == [False, True, False, False]


def test_geo_rules_find_case_forms(spark):
    """Places in other case forms, by stem or lemma, and the rules of countries and abbreviations."""
    from seedsift.operators import geo

    seeds = spark.createDataFrame([(1, "ремонт киев"), (2, "тур лондон")], "seed_id long, seed string")
    texts = ["ремонт в москве", "ремонт в киеве", "ремонт во льве", "ремонт нижним новгородом", "ремонт на оболони", "ремонт на арбате", "ремонт польша", "ремонт из польши", "ремонт спб", "московская улица москва улица"]
    kw = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "тур англия")], "seed_id long, kw_id long, keyword string")
    places = spark.createDataFrame([("москва", ["ru"]), ("киев", ["ua"]), ("лев", ["ru"]), ("нижний новгород", ["ru"]), ("лондон", ["gb"])], "name string, countries array<string>")
    districts = spark.createDataFrame([("оболонь", "киев", "UA"), ("арбат", "москва", "RU")], "name string, city string, country string")
    lexicon = spark.createDataFrame([("льве", 0, "лев"), ("нижним", 0, "нижний"), ("новгородом", 0, "новгород")], "word string, rank int, lemma string")
    countries = spark.createDataFrame([("польша", "PL"), ("англия", "GB")], "name string, country string")
    short = spark.createDataFrame([("спб", "RU")], "name string, country string")
    got = {(r.seed_id, r.kw_id): r.reason for r in geo.geo_rules(kw, seeds, places, districts, "UA", None, lexicon, countries, short).collect()}
    assert got == {(1, 0): "foreign_city:москве", (1, 2): "foreign_city:льве", (1, 3): "foreign_city:нижним новгородом", (1, 5): "foreign_district:арбате", (1, 6): "country:польша", (1, 8): "abbreviation:спб", (1, 9): "foreign_city:москва"}
    plain = {r.kw_id: r.reason for r in geo.geo_rules(kw, seeds, places, districts, "UA").where("seed_id = 1").collect()}
    assert plain[0] == "foreign_city:москве" and not {1, 2, 4, 6, 8} & set(plain)
    assert [r.kw_id for r in geo.without_seed_place(kw.where("seed_id = 1 and kw_id < 2"), seeds, places).collect()] == [0]
