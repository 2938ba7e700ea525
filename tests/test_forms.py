"""Word forms and likeness, probes from other spellings, streams with bounded state, and small readers."""

from __future__ import annotations

import difflib
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from seedsift.operators import clusters, expand, fold, morph_probes, near_forms, statistics
from seedsift.sources import dictionaries
from seedsift.streaming import log as stream
from tests.conftest import DATA


def random_pairs(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcде") for _ in range(rng.randint(0, 9)))
    out = []
    for _ in range(n):
        a = word()
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        out.append((a, "".join(b) if rng.random() < 0.7 else word()))
    return out


def test_likeness_equals_a_plain_implementation(spark):
    pairs = random_pairs(10_000)
    want = {p: difflib.SequenceMatcher(None, *p).ratio() for p in pairs}
    for least in (0.7, 0.8, 0.97):
        got = {(r.a, r.b): r.ratio for r in near_forms.alike(spark.createDataFrame(pairs, "a string, b string"), least).collect()}
        assert got == {p: r for p, r in want.items() if r >= least}
    rows = [*pairs[:300], ("Abcd", "ABCD"), (None, "a")]
    got = near_forms.nearly_same(spark.createDataFrame(rows, "a string, b string")).collect()
    assert len(got) == len(rows)
    assert all(r.same == (r.a is not None and difflib.SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio() > 0.8) for r in got)


def test_alignment_to_a_seed(spark):
    rows = [(1, "ремонт пылесосов", "Ремонта ПЫЛЕСОСА киев", "ремонт пылесосов киев"), (1, "ремонт пылесосов", "", ""), (2, "купить айфон", "купит айфоны куплю", "купить айфон куплю"), (2, "купить айфон", None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "seed_id long, seed string, keyword string").withColumn("k", F.lit(1))
    assert sorted((str(r.keyword), str(r.aligned)) for r in near_forms.align_to_seed(df).collect()) == sorted((str(r[2]), str(r[3])) for r in rows)


def test_normalised_phrases(spark):
    lexicon = spark.createDataFrame(
        [("цветами", 0, "цветок", "NOUN", "ablt", "plur", "masc"), ("цветы", 0, "цветок", "NOUN", "nomn", "plur", "masc"), ("цветок", 0, "цветок", "NOUN", "nomn", "sing", "masc"), ("новую", 0, "новый", "ADJF", "accs", "sing", "femn"),
         ("новая", 0, "новый", "ADJF", "nomn", "sing", "femn"), ("новый", 0, "новый", "ADJF", "nomn", "sing", "masc"), ("купил", 0, "купить", "VERB", None, "sing", "masc")],
        "word string, rank int, lemma string, pos string, case string, number string, gender string",
    )
    stems = spark.createDataFrame([("flowers", "en", "flower"), ("delivering", "en", "deliv")], "word string, language string, stem string")
    rows = [(1, "цветы", "Новую цветами купил s21 айфон-x", "ru", "новая цветы купить s21 айфон-x"), (2, "flower delivery", "Flowers delivering deliverz", "en-US", "flower deliv deliverz"), (3, "a", "їжа", "auto", "їжа"), (4, "a", None, "", "")]
    df = spark.createDataFrame([r[:4] for r in rows], "seed_id long, seed string, keyword string, language string")
    got = {r.seed_id: r.normalized for r in near_forms.normalize_phrases(df, lexicon, stems).collect()}
    assert got == {r[0]: r[4] for r in rows}
    assert {r.seed_id: r.language for r in near_forms.languages(df).collect()} == {1: "ru", 2: "en", 3: "uk", 4: "en"}


LEXICON = "word string, rank int, lemma string, pos string, score double, grammemes array<string>"


def test_service_words(spark):
    rows = [("ремонт", 0, "ремонт", "NOUN", 0.9, []), ("пылесос", 0, "пылесос", "NOUN", 0.9, []), ("доставка", 0, "доставка", "NOUN", 0.9, []), ("здание", 0, "здание", "NOUN", 0.9, []), ("покупка", 0, "покупка", "NOUN", 0.2, []), ("взятие", 0, "взятие", "NOUN", 0.9, []),
            ("ремонтировать", 0, "ремонтировать", "INFN", 1.0, ["tran"]), ("пылесосить", 0, "пылесосить", "INFN", 1.0, ["tran"]), ("доставить", 0, "доставить", "INFN", 1.0, ["tran"]), ("взять", 0, "взять", "INFN", 0.95, ["tran"]), ("здить", 0, "здить", "INFN", 0.5, ["tran"])]
    lexicon = spark.createDataFrame(rows, LEXICON)
    words = spark.createDataFrame([(r[0],) for r in rows[:6]] + [("неизвестно",)], "word string")
    assert {r.word for r in morph_probes.service_words(words, lexicon).collect()} == {"ремонт", "доставка"}
    seeds = spark.createDataFrame([(1, "Ремонт пылесосов купить"), (2, "пылесос")], "seed_id long, seed string")
    assert {r.seed_id: r.markers for r in expand.analyze_seeds(seeds, lexicon).collect()} == {1: ["T", "S"], 2: []}


def test_variants_and_triggers(spark):
    lexicon = spark.createDataFrame([("ремонт", 0, "ремонт", "NOUN", 0.9, []), ("окна", 0, "окно", "NOUN", 0.9, [])], LEXICON)
    seeds = spark.createDataFrame([(1, "Купить окна"), (2, "ремонт"), (3, "купить"), (4, "")], "seed_id long, seed string")
    got = {(r.seed_id, r.label): r.variant for r in morph_probes.seed_variants_exp(seeds, lexicon).collect()}
    assert got[(1, "typo_w1")] == "купить оокна" and got[(1, "cyr2lat_w1")] == "купить oкна" and got[(1, "cyr2lat_w2")] == "кyпить окна"
    assert got[(1, "brute_ом")] == "купить окном" and (1, "brute_а") not in got and got[(1, "sep_ов")] == "купить окнов" and got[(1, "double_space")] == "купить окна"
    assert {k[0] for k in got} == {1, 2} and (2, "cyr2lat_w2") not in got
    probes = {(r.seed_id, r.label): (r.query, r.cp) for r in morph_probes.trigger_probes(seeds, spark).collect()}
    assert probes[(1, "trg_28_lo_к")] == ("купить окна  ( к", 13) and probes[(1, "trg_28_lo_к_dm1")][1] == 12
    assert probes[(1, "trg_infix_p1_2116_only")] == ("купить № окна", 7) and probes[(1, "trg_dense_t1_2b_м")] == ("купить+  окна м", 6)
    assert (2, "trg_28_lo_к") in probes and (2, "trg_infix_p1_2116_only") not in probes and (2, "trg_dense_t1_2b_м") not in probes
    assert probes[(2, "trg_alt_3a_к")] == ("ремонт  : к", 8)
    morph = {(r.label, r.query): r.cp for r in morph_probes.expand_morph(seeds, morph_probes.seed_variants_exp(seeds, lexicon), spark, ("exp",), letters=False).where("seed_id = 2").collect()}
    assert morph[("double_space", "ремонт в *")] == 3 and morph[("cp_one", "ремонт в *")] == 1 and ("brute_а", "ремона в *") not in {k for k in morph}


def test_streams_keep_bounded_state_and_equal_their_batch_twins(spark, tmp_path):
    """Events of six hours in six files: the windows that the watermark has passed leave the state."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "events").mkdir()
    base = events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for hour in range(6):
        part = base.withColumn("ts", F.expr(f"ts + make_interval(0, 0, 0, 0, {hour}, cast(event_id % 50 as int), 0)")).withColumn("event_id", F.col("event_id") + hour * 10**6)
        part.coalesce(1).write.parquet(str(tmp_path / f"h{hour}"))
        shutil.copy(next((tmp_path / f"h{hour}").glob("*.parquet")), tmp_path / "events" / f"events-{hour}.parquet")
    path = f"{tmp_path}/events/events-*.parquet"
    schema = spark.read.parquet(path).schema

    def read():
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        return stream.log_columns(raw).withColumn("ts", F.col("ts").cast("timestamp"))

    batch = stream.log_columns(spark.read.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, build, keys in (("fold", stream.stream_fold, ["hour", "seed_id", "keyword"]), ("yield", stream.stream_yield, ["hour", "struct"])):
        got = stream.run_available(build(read()), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", keys)
        hour = F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:mm").alias("hour")
        if name == "fold":
            want = batch.where("n_results > 0").groupBy(hour, "seed_id", "keyword").agg(F.count("*").alias("weight"))
        else:
            want = batch.groupBy(hour, "struct").agg(F.count("*").alias("requests"), F.sum("n_results").alias("suggestions"), F.round(F.sum("time_ms"), 2).alias("sum_ms"))
        assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
        query = build(read()).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/{name}-again").trigger(availableNow=True).start()
        query.awaitTermination()
        held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        assert len(held) >= 6 and held[-1] <= max(held[:2]) * 1.5 and sum(s["numRowsRemoved"] for p in query.recentProgress for s in p["stateOperators"]) > 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_poles_in_blocks(spark, block):
    rng = random.Random(1)
    rows = [(i, i % 7, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    poles = statistics.centroids(vectors, "label")
    got = {r.vec_id: (r.own, r.other) for r in statistics.pole_contrast(vectors, poles, "label", block).collect()}
    known = {r.label: r.centroid for r in poles.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for i, label, v in rows:
        assert got[i] == pytest.approx((cos(v, known[label]), max(cos(v, c) for k, c in known.items() if k != label)))


def test_readers_and_orders(spark, tmp_path):
    body = {"Позняки": {"city": "Киев", "country": "UA"}, "X": {"city": "y", "country": "unknown"}, "Z": {"city": "y"}, "Бутово": {"country": "ru"}}
    (tmp_path / "districts.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    assert sorted(tuple(r) for r in dictionaries.read_districts(spark, str(tmp_path / "districts.json")).collect()) == [("бутово", "", "ru"), ("позняки", "киев", "ua")]
    folded = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 5)], "seed_id long, keyword string, weight long")
    assert [r.keyword for r in fold.by_weight(folded).collect()] == ["c", "a", "b"]
    schema = "seed string, keywords array<string>, region string, language string"
    got = clusters.cluster_inputs(spark.createDataFrame([("s", ["a", "b"], None, "en")], schema)).collect()
    assert [tuple(r) for r in got] == [("s", "a", "Украина", "en"), ("s", "b", "Украина", "en")]
    for bad in (("", ["a"], None, None), ("s", [], None, None), (None, ["a"], None, None)):
        with pytest.raises(Exception, match="missing"):
            clusters.cluster_inputs(spark.createDataFrame([bad], schema)).collect()
