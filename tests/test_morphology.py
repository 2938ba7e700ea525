import pytest

from seedsift.operators import morphology as M

LEX = "word string, rank int, lemma string, pos string, case string, number string, gender string, score double, known boolean"


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("ремонт", 0, "ремонт", "NOUN", "nomn", "sing", "masc", 0.8, True), ("ремонт", 1, "ремонт", "NOUN", "accs", "sing", "masc", 0.75, True), ("ремонта", 0, "ремонт", "NOUN", "gent", "sing", "masc", 1.0, True),
        ("ремонты", 0, "ремонт", "NOUN", "nomn", "plur", "masc", 0.9, True), ("стали", 0, "стать", "VERB", None, "plur", None, 0.9, True), ("стали", 1, "сталь", "NOUN", "gent", "sing", "femn", 0.1, True),
        ("для", 0, "для", "PREP", None, None, None, 1.0, True), ("дома", 0, "дом", "NOUN", "gent", "sing", "masc", 0.6, True), ("дом", 0, "дом", "NOUN", "nomn", "sing", "masc", 0.9, True), ("киеве", 0, "киев", "NOUN", "loct", "sing", "masc", 1.0, True),
    ]
    return spark.createDataFrame(rows, LEX)


def test_lemmas_and_forms(spark, lexicon):
    got = {r.word: r.lemmas for r in M.top_lemmas(lexicon).collect()}
    assert got["ремонт"] == ["ремонт"] and got["стали"] == ["стать"]
    forms = M.word_forms(spark.createDataFrame([("ремонта",), ("неизвестно",)], "word string"), lexicon).collect()
    assert {(r.word, r.form) for r in forms} == {("ремонта", f) for f in ("ремонт", "ремонта", "ремонты")}


def test_case_variants(spark, lexicon):
    seeds = spark.createDataFrame([(1, "ремонт дома"), (2, "стали цены")], "seed_id long, seed string")
    got = {(r.seed_id, r.case, r.number, r.variant) for r in M.seed_variants_case(seeds, lexicon).collect()}
    assert got == {(1, "gent", "sing", "ремонта дома"), (1, "nomn", "plur", "ремонты дома")}


def test_nominative_and_intent(spark, lexicon):
    kw = spark.createDataFrame([(1, 1, "ремонт дома", "ремонта в киеве"), (1, 2, "ремонт дома", "ремонт для дома"), (1, 3, "ремонт дома", "дешево стали"), (1, 4, "ремонт дома", None)], "seed_id long, kw_id long, seed string, keyword string")
    assert {r.keyword for r in M.normalize_nominative(kw, lexicon).collect()} == {"ремонт в киеве", "ремонт для дома"}
    places = spark.createDataFrame([("Киев",)], "name string")
    got = {r.kw_id: r.fp for r in M.intent_fingerprint(kw, lexicon, places).collect()}
    assert got == {1: "__GEO__|в", 2: "__EMPTY__", 3: "дешево|стать", 4: "__EMPTY__"}
