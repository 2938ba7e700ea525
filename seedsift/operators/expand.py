"""Expansion: seeds joined with small template tables give probes.

A template's pattern has {s} for the seed and {x} for a letter, digit or word; cp is the cursor: 'end',
'seed' (right after the seed's place) or 'start'. Templates are data: callers bring their own or take these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions import text as X

TEMPLATE = "family string, grp string, struct string, pattern string, cp string, x_kind string, kind string"
#: Suffixes by kind. A: symbols for a region, B: prepositions, C: questions, D: goals.
SUFFIXES = {
    "A_ua": (":",), "A_ru": ("&",),
    "B": ("в *", "на *", "для *", "с *", "от *", "под *", "из *", "без *"),
    "C": ("как *", "какой *", "где *", "сколько *", "почему *"),
    "D": ("купить *", "цена *", "отзывы *", "обзор *", "сравнение *", "характеристики *", "аналоги *", "или *", "и *", "vs *", "вместо *", "форум *"),
    "num": tuple(f"* {i}" for i in range(10)),
}
#: Letters by frequency, and the structures of a letter's probes as (name, pattern, cursor).
SWEPT_LETTERS = "кпмнрдтбгзжлоауфхцчшйеэюящ"
LETTER_STRUCTS = [
    ("plain", "{s} {x}", "end"), ("plain_nocp", "{s} {x}", "none"), ("trail", "{s} {x} ", "end"), ("sandwich", "{s} * {x} *", "end"),
    ("wcB_cpMid", "{s} * {x}", "seed+3"), ("Lwc_cpAL", "{s} {x} *", "seed+3"), ("Lwc_cpBL", "{s} {x} *", "seed+1"), ("col_B_trail", "{s} : {x} ", "end"),
    ("L_col", "{s} {x} :", "end"), ("hyp_B_trail", "{s} - {x} ", "end"), ("hyp_Lwc", "{s} - {x} *", "end"), ("hyp_wcL", "{s} - * {x}", "end"), ("L_hyp", "{s} {x} -", "end"),
]
PREFIX_STRUCTS = [("plain", "{x} {s}", "start"), ("star", "{x} * {s}", "start"), ("dash", "{x} - {s}", "start"), ("colon", "{x} : {s}", "start")]
QUESTIONS = ["как", "какой", "где", "сколько", "почему"]
LATIN_LETTERS, CYRILLIC_LETTERS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя"
UKRAINIAN_LETTERS = "абвгдежзийклмнопрстуфхцчшщюяіїєґ"
#: A probe's priority by the seed's marker and the template's kind, 1 where nothing is said; the least over the markers counts.
PRIORITY = {"Q": {"C": 2, "D": 2}, "T": {"C": 2}, "S": {}, "P": {}, "L1": {}, "L2": {}, "L3": {"C": 2}, "L4": {"B": 2, "C": 2, "D": 2}, "L5+": {"B": 2, "C": 2, "D": 2}}
#: Question words, words of trade, prepositions, and endings for variants.
QUESTION_MARKERS = (
    "как", "какой", "какая", "какое", "какие", "где", "сколько", "почему", "зачем", "когда", "куда", "откуда", "чей", "чья", "чьё", "чьи",
    "который", "которая", "которое", "которые",
)
TRADE_MARKERS = (
    "купить", "купи", "куплю", "покупка", "покупать", "цена", "цену", "ценой", "ценах", "ценам", "стоимость", "стоит", "заказать", "заказ",
    "заказывать", "прайс", "недорого", "дешево", "дёшево", "скидка", "акция",
)
PREPOSITIONS = (
    "в", "во", "на", "для", "с", "со", "от", "под", "из", "без", "над", "за", "по", "до", "при", "между", "через", "про", "об", "о", "к", "ко", "у",
)
ENDINGS = ("а", "у", "е", "и", "ы", "ой", "ом", "ам", "ах")


def analyze_seeds(seeds: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds words, markers (Q question, T trade, P preposition and, with a lexicon, S service), level L1 to L6+ by length, and whether there is a digit."""
    w = X.words("seed")
    has = lambda names: F.arrays_overlap(w, F.array(*(F.lit(n) for n in names)))
    markers = F.array_compact(F.array(F.when(has(QUESTION_MARKERS), "Q"), F.when(has(TRADE_MARKERS), "T"), F.when(has(PREPOSITIONS), "P")))
    n = F.size(w)
    level = F.when(n >= 6, "L6+").when(n == 5, "L5+").otherwise(F.concat(F.lit("L"), F.greatest(n, F.lit(1)).cast("string")))
    own = seeds.withColumn("seed", X.norm("seed"))
    if lexicon is not None:
        from seedsift.operators.morph_probes import service_words

        each = own.select("seed", F.explode(X.words("seed")).alias("word")).distinct()
        service = each.join(service_words(each, lexicon), "word").select("seed").distinct().withColumn("_service", F.lit(True))
        own = own.join(service, "seed", "left").select(*seeds.columns, "_service")
        markers = F.when(F.col("_service"), F.array_append(markers, F.lit("S"))).otherwise(markers)
        return own.withColumn("words", w).withColumn("markers", markers).withColumn("level", level).withColumn("has_digit", F.col("seed").rlike(r"\p{Nd}")).drop("_service")
    return own.withColumn("words", w).withColumn("markers", markers).withColumn("level", level).withColumn("has_digit", F.col("seed").rlike(r"\p{Nd}"))


def suffix_templates(spark: SparkSession, region: str = "all") -> DataFrame:
    """Each suffix with its cursor at the end (v1), before the suffix (v2) and, other than for symbols, right after the seed (v3)."""
    rows = []
    for kind, values in SUFFIXES.items():
        if kind == "num" or region != "all" and kind in ("A_ua", "A_ru") and kind != f"A_{region}":
            continue
        for v in values:
            for variant, cp in (("v1", "end"), ("v2", "seed+1"), ("v3", "seed+0"))[: 2 if kind[0] == "A" else 3]:
                rows.append(("suffix", kind, f"{v}_{variant}", "{s} " + v, cp, None, kind[0]))
    return spark.createDataFrame(rows, TEMPLATE)


def swept(spark: SparkSession, family: str, grp: str, structs: list[tuple[str, str, str]], values, kind: str) -> DataFrame:
    """Templates for every value of a sweep."""
    rows = [(family, grp, f"{v}_{s}", p.replace("{x}", str(v)), cp, str(v), kind) for s, p, cp in structs for v in values]
    return spark.createDataFrame(rows, TEMPLATE)


def prune_templates(templates: DataFrame, skip: DataFrame) -> DataFrame:
    """Templates without the (family, struct) pairs that measured yields have ruled out."""
    return templates.join(F.broadcast(skip.select("family", "struct")), ["family", "struct"], "left_anti")


def expand(seeds: DataFrame, templates: DataFrame) -> DataFrame:
    """One probe for each seed and template. Seeds of six words or more get symbol probes only. Templates are a fixed table of code, so they are broadcast."""
    wide = seeds.crossJoin(F.broadcast(templates)).where((F.col("level") != "L6+") | (F.col("kind") == "A"))
    query = F.replace("pattern", F.lit("{s}"), F.col("seed"))
    offset = F.length("seed") + F.regexp_extract("cp", r"^seed\+(\d+)$", 1).cast("int")
    at = F.when(F.col("cp") == "end", F.length(query)).when(F.col("cp") == "start", F.lit(0)).when(F.col("cp") == "none", F.lit(-1)).otherwise(offset)
    return wide.withColumn("query", query).withColumn("cp", at.cast("int"))


def expand_suffix(seeds: DataFrame, spark: SparkSession, region: str = "all") -> DataFrame:
    return expand(seeds, suffix_templates(spark, region))


def expand_numbers(seeds: DataFrame, spark: SparkSession, always: bool = False) -> DataFrame:
    """Suffixes 0 to 9, for seeds with a digit or for all."""
    some = seeds if always else seeds.where("has_digit")
    return expand(some, swept(spark, "suffix", "num", [("num", "{s} {x}", "end")], SUFFIXES["num"], "num"))


def expand_letters(seeds: DataFrame, spark: SparkSession, letters: str = SWEPT_LETTERS) -> DataFrame:
    return expand(seeds, swept(spark, "suffix", "letter", LETTER_STRUCTS, letters, "E"))


def expand_addon(seeds: DataFrame, spark: SparkSession) -> DataFrame:
    """Digits, and digits with letters, behind the seed."""
    pairs = [f"{d} {x}" for d in range(5) for x in CYRILLIC_LETTERS]
    one = swept(spark, "suffix", "addon", [("digit", "{s} {x}", "end")], range(7), "num")
    return expand(seeds, one.unionByName(swept(spark, "suffix", "addon", [("digit_letter", "{s} {x}", "end")], pairs, "num")))


def expand_prefix(seeds: DataFrame, spark: SparkSession, letters: str = CYRILLIC_LETTERS) -> DataFrame:
    sweep = swept(spark, "prefix", "PA", PREFIX_STRUCTS, letters, "letter").unionByName(swept(spark, "prefix", "PC", PREFIX_STRUCTS[:1], QUESTIONS, "C"))
    return expand(seeds, sweep)


def expand_prefix_addon(seeds: DataFrame, spark: SparkSession) -> DataFrame:
    return expand(seeds, swept(spark, "prefix", "digits", PREFIX_STRUCTS, range(10), "num"))


def probe_priority(probes: DataFrame, matrix: dict = PRIORITY) -> DataFrame:
    """Adds priority: the least of the matrix over the markers Q, T and S and the seed's level."""
    table = F.create_map(*(F.lit(x) for m, row in matrix.items() for k, v in ({"": 1} | row).items() for x in (f"{m}:{k}", v)))
    level = F.when(F.col("level") == "L6+", "L5+").otherwise(F.col("level"))
    active = F.array_append(F.array_except("markers", F.array(F.lit("P"))), level)
    of = F.transform(active, lambda m: F.coalesce(F.element_at(table, F.concat(m, F.lit(":"), F.col("kind"))), F.lit(1)))
    return probes.withColumn("priority", F.array_min(of))


def block_self_match(probes: DataFrame) -> DataFrame:
    """Priority 0 and a reason for probes whose added words are the seed's already; the first such word names the reason."""
    added = F.filter(X.words(F.replace("pattern", F.lit("{s}"), F.lit(" "))), lambda w: w != "*")
    word = F.get(F.filter(added, lambda w: F.array_contains("words", w)), F.lit(0))
    reason = F.concat(F.when(word.isin(*PREPOSITIONS), "prep_self_match:").otherwise("word_self_match:"), word)
    return probes.withColumn("blocked_by", reason).withColumn("priority", F.when(F.col("blocked_by").isNotNull(), 0).otherwise(F.col("priority")))


def select_probes(probes: DataFrame, echelon: int) -> DataFrame:
    return probes.where(F.col("priority") == echelon)


def seed_variants_brute(seeds: DataFrame) -> DataFrame:
    """The first Cyrillic word of four letters or more without its last letter, with each of nine endings."""
    at = F.array_position(F.transform("words", lambda w: w.rlike("^[а-яёіїєґ]{4,}$")), True).cast("int")
    some = seeds.withColumn("_at", at).where("_at > 0").withColumn("_end", F.explode(F.array(*(F.lit(e) for e in ENDINGS))))
    word = F.expr("concat(substring(words[_at - 1], 1, length(words[_at - 1]) - 1), _end)")
    joined = F.expr("array_join(transform(words, (w, i) -> if(i = _at - 1, _word, w)), ' ')")
    return some.withColumn("_word", word).withColumn("variant", joined).where("variant <> array_join(words, ' ')").select("seed_id", "variant", F.col("_end").alias("ending"))


def merge_tokens(c) -> Column:
    """Words with a preposition joined to the word after it, and a number to the Latin word before it."""
    preps = ", ".join(f"'{p}'" for p in PREPOSITIONS)
    step = rf"""(a, w) -> if(size(a) > 0 and (a[size(a) - 1] in ({preps}) or (w rlike '^\\p{{Nd}}+$' and a[size(a) - 1] rlike '^[a-z0-9 ]*[a-z][a-z0-9 ]*$')),
        concat(slice(a, 1, size(a) - 1), array(concat(a[size(a) - 1], ' ', w))), concat(a, array(w)))"""
    return F.expr(f"aggregate({c}, cast(array() as array<string>), {step})")


def infix_core(seeds: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """words without places at either end, as long as over two words are left."""
    names = gazetteer.select(F.lower("name").alias("w")).distinct().withColumn("_geo", F.lit(True))
    tokens = seeds.select("seed_id", F.posexplode("words").alias("p", "w")).join(names, "w", "left")
    flags = tokens.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("_geo", F.lit(False)).alias("g")))), lambda x: x["g"]).alias("_geo"))
    df = seeds.join(flags, "seed_id", "left")
    lead = F.expr("coalesce(array_position(_geo, false), 1) - 1")
    trail = F.expr("coalesce(array_position(reverse(_geo), false), 1) - 1")
    df = df.withColumn("_n", F.size("words")).withColumn("_a", F.least(lead, F.greatest(F.col("_n") - 2, F.lit(0)))).withColumn("_b", F.least(trail, F.greatest(F.col("_n") - 2 - F.col("_a"), F.lit(0))))
    return df.withColumn("core", F.expr("slice(words, cast(_a + 1 as int), cast(_n - _a - _b as int))")).drop("_geo", "_n", "_a", "_b")


def infix_gaps(core: DataFrame) -> DataFrame:
    """(seed_id, gap, w1, w2, wildcard_only): places between words; none before a question word, the middle of four is for wildcards only."""
    gaps = core.withColumn("t", merge_tokens("core")).where("size(t) >= 2").select("seed_id", "t", F.explode(F.expr("sequence(1, size(t) - 1)")).alias("gap"))
    out = gaps.select("seed_id", "gap", F.expr("t[gap - 1]").alias("w1"), F.expr("t[gap]").alias("w2"), F.expr("array_join(slice(t, 1, gap), ' ')").alias("left"), F.expr("array_join(slice(t, gap + 1, size(t)), ' ')").alias("right"), F.expr("size(t) = 4 and gap = 2").alias("middle"))
    trade = F.col("w2").isin(*TRADE_MARKERS)
    return out.where(~F.col("w1").isin(*QUESTION_MARKERS)).withColumn("wildcard_only", F.col("middle") | trade).drop("middle")


INFIX = [("WC", "*"), ("A", "-"), ("B", "для"), ("C", "как"), ("D", "цена")]


def expand_infix(gaps: DataFrame, spark: SparkSession) -> DataFrame:
    """A probe for each gap and insert; only wildcards where the gap says so."""
    inserts = spark.createDataFrame(INFIX, "grp string, ins string")
    wide = gaps.crossJoin(F.broadcast(inserts)).where("not wildcard_only or grp = 'WC'")
    query = F.concat_ws(" ", "left", "ins", "right")
    return wide.select("seed_id", "gap", "grp", query.alias("query"), (F.length("left") + F.length("ins") + 1).cast("int").alias("cp"))


def modifiers(seeds: DataFrame, spark: SparkSession, numbers: bool = False) -> DataFrame:
    """(seed_id, modifier): the alphabet of the seed's language; Latin letters unless it is purely Cyrillic; digits on request."""
    alphabets = spark.createDataFrame([("ru", x) for x in CYRILLIC_LETTERS] + [("uk", x) for x in UKRAINIAN_LETTERS], "language string, modifier string")
    df = seeds.withColumn("language", X.detect_language("seed"))
    own = df.join(F.broadcast(alphabets), "language").select("seed_id", "modifier")
    latin = df.where(~F.col("seed").rlike("[\\u0400-\\u04ff]") | F.lower("seed").rlike("[a-z]")).select("seed_id", F.explode(F.split(F.lit(LATIN_LETTERS), "")).alias("modifier")).where("modifier <> ''")
    out = own.unionByName(latin)
    return out.unionByName(df.select("seed_id", F.explode(F.expr("transform(sequence(0, 9), i -> cast(i as string))")).alias("modifier"))) if numbers else out


def probe_summary(probes: DataFrame) -> DataFrame:
    """Counts by family, kind and priority with subtotals, and blocked ones."""
    return probes.rollup("family", "kind", "priority").agg(F.count("*").alias("n"), F.count_if(F.col("blocked_by").isNotNull()).alias("n_blocked"))
