"""What a word is beside a place: looked up once for each distinct word, as a table of features that rules read.

places has (name, country, pop, admin1, fclass) in lower case; fclass is P or T for places, A for regions, C for countries. The lexicon
is that of seedsift.operators.grammar: (word, rank, lemma, pos, score, known, grammemes). Of equally large places the
least country counts. Null words are left out; words that the lexicon lacks have no parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators.geo import geo_stem
from seedsift.operators.places import CITY_ADJECTIVES, COMPLEX_MARKERS, FUNCTION, STREET_MARKERS

#: Brands that are spelled like places, marks of proper names, and the bounds of what counts as a city.
KNOWN_BRANDS = (
    "редмонд", "redmond", "горенье", "gorenje", "бош", "bosch", "самсунг", "samsung", "филипс", "philips", "браун", "braun",
    "панасоник", "panasonic", "сименс", "siemens", "миле", "miele", "электролюкс", "electrolux", "аег", "aeg", "занусси", "zanussi",
    "индезит", "indesit", "аристон", "ariston", "канди", "candy", "беко", "beko", "хотпоинт", "hotpoint", "вирпул", "whirlpool",
    "дайсон", "dyson", "керхер", "karcher", "витек", "vitek", "поларис", "polaris", "скарлет", "scarlett", "тефаль", "tefal",
    "мулинекс", "moulinex", "крупс", "krups", "делонги", "delonghi", "филко", "philco", "томас", "thomas", "зелмер", "zelmer",
)
PROPER = ("Geox", "Name", "Surn", "Patr", "Orgn")
LEAST_NAME, SHORT_LATIN, LATIN_POPULATION, LEAST_CYRILLIC, BRAND_LETTERS = 3, 4, 50_000, 3, 4
#: Endings of adjectives of regions and what a city may end in instead; words that name a region.
REGION_ENDINGS = ("ская", "ський", "ська", "ский", "ской", "ском", "скую", "ское", "кая", "кий", "кой")
CITY_ENDINGS = ("", "а", "я", "ск", "к", "ь", "ье", "е", "о", "ів", "ва", "сса", "са", "ы", "і", "и")
REGION_WORD = "обл"

#: Prepositions before a place, letters that a city's name has more of, and the population from which it counts without a preposition.
BEFORE_PLACE = (
    "в", "на", "из", "под", "во", "до", "возле", "с", "со", "от", "ко", "за", "над", "у", "біля", "поруч", "коло", "від", "про",
    "in", "at", "near", "from", "to", "on", "by", "with", "for", "of", "about", "ў", "каля", "ля", "пры", "w", "na", "przy", "od", "do", "z", "o",
)
SHORT_CITY, LARGE_CITY = 3, 50_000

_CYRILLIC = "[а-яёіїєґ]"


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def word_features(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, pos, geox, skip_geo, common_noun, homonym, everyday, geo_parse) of distinct words (word).

    skip_geo: a function word, or a known one that no parse calls a place. common_noun: a known word, not skipped, whose first parse is a
    sure adjective or thing and no proper name. homonym: a known word that no parse calls a place; everyday: a noun among them that is
    not in exceptions (word). geo_parse: some parse is a place's or a family's name. Words with capitals are neither noun nor homonym.
    """
    marks = F.coalesce("grammemes", F.array().cast("array<string>"))
    has = lambda c, names: F.arrays_overlap(c, _strings(names))
    lex = lexicon.withColumn("_m", marks).groupBy("word").agg(
        F.min(F.struct("rank", "pos", F.col("score").cast("double").alias("score"), F.col("_m").alias("marks"))).alias("_b"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"),
        F.bool_or(has("_m", ["Geox"])).alias("geox"), F.bool_or(has("_m", ["Geox", "Surn"])).alias("geo_parse"),
    )
    df = words.where("word is not null").select("word").distinct().join(lex, "word", "left").fillna(False, ["known", "geox", "geo_parse"])
    pos, score, tags = F.col("_b.pos"), F.coalesce("_b.score", F.lit(1.0)), F.col("_b.marks")
    lower = (F.col("word") == F.lower("word")) & F.col("word").rlike(r"\p{L}")
    parsed = F.col("_b").isNotNull()
    skip = parsed & (F.coalesce(pos.isin(*FUNCTION), F.lit(False)) | (F.col("known") & ~F.col("geox")))
    sure = F.when(pos == "ADJF", (has(tags, ["Qual"]) & (score >= 0.4)) | (score >= 0.6)).when(pos == "NOUN", has(tags, ["inan"]) & (score >= 0.5)).otherwise(False)
    common = parsed & ~skip & lower & F.col("known") & ~has(tags, PROPER) & sure
    homonym = parsed & lower & F.col("known") & ~F.col("geox")
    df = df.select("word", pos.alias("pos"), "geox", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in (("skip_geo", skip), ("common_noun", common), ("homonym", homonym))), "geo_parse")
    kept = F.lit(False)
    if exceptions is not None:
        df, kept = df.join(exceptions.select("word", F.lit(True).alias("_kept")).distinct(), "word", "left"), F.coalesce("_kept", F.lit(False))
    return df.withColumn("everyday", F.col("homonym") & F.coalesce(F.col("pos") == "NOUN", F.lit(False)) & ~kept).drop("_kept")


def place_lookup(words: DataFrame, places: DataFrame, target: str, lexicon: DataFrame | None = None, country_names: DataFrame | None = None) -> DataFrame:
    """(word, kind, country, pop, admin1, fclass) of the distinct words (word) of three letters or more that are places.

    Regions count for the target only. A country's name beats a city's, where it is listed in country_names (name, country), has no
    Cyrillic letter, or some parse is a name; a listed name is never a city. ё is looked up as е. The largest place of a name counts.
    """
    keys = words.where(F.length("word") >= LEAST_NAME).select("word").distinct().withColumn("name", F.translate("word", "ё", "е"))
    rows = places.where(F.col("fclass").isin("P", "T", "C") | ((F.col("fclass") == "A") & (F.col("country") == target.lower()))).withColumn("pop", F.coalesce("pop", F.lit(0)).cast("long"))
    large = rows.groupBy("name", (F.col("fclass") == "C").alias("_land")).agg(F.max("pop").alias("pop"))
    one = rows.withColumn("_land", F.col("fclass") == "C").join(large, ["name", "_land", "pop"]).groupBy("name", "_land", "pop").agg(F.min(F.struct("country", "admin1", "fclass")).alias("_p"))
    hits = keys.join(one, "name")
    if country_names is None:
        hits = hits.withColumn("_listed", F.lit(None).cast("string"))
    else:
        hits = hits.join(country_names.groupBy("name").agg(F.min("country").alias("_listed")), "name", "left")
    listed = F.col("_listed").isNotNull()
    if lexicon is None:
        hits = hits.withColumn("geo_parse", F.lit(False))
    else:
        named = word_features(hits.select(F.col("name").alias("word")), lexicon).select(F.col("word").alias("name"), "geo_parse")
        hits = hits.join(named, "name", "left").fillna(False, ["geo_parse"])
    sure = listed | ~F.col("name").rlike(_CYRILLIC) | F.col("geo_parse")
    land = F.col("_land")
    rank = F.when(land & sure, 0).when(~land & listed, 1).when(~land, 2)
    row = F.struct(rank.alias("rank"), F.when(rank == 2, "city").otherwise("country").alias("kind"), F.when(rank == 1, F.col("_listed")).otherwise(F.col("_p.country")).alias("country"), "pop",
                   F.when(rank == 2, F.col("_p.admin1")).alias("admin1"), F.when(rank == 2, F.col("_p.fclass")).alias("fclass"))
    found = hits.where(rank.isNotNull()).groupBy("word").agg(F.min(row).alias("_r"))
    return found.select("word", "_r.kind", "_r.country", "_r.pop", "_r.admin1", "_r.fclass")


def real_city(word: str = "word", pop: str = "pop") -> Column:
    """Whether a word that names a place is a city rather than a brand: no known brand, long enough, and in Latin letters large enough."""
    w = F.col(word)
    ascii_ = w.rlike(r"^[\x00-\x7F]*$")
    latin = ascii_ & w.rlike("^[A-Za-z]+$")
    small = latin & ((F.length(w) <= SHORT_LATIN) | (F.coalesce(F.col(pop), F.lit(0)) < LATIN_POPULATION))
    return ~F.lower(w).isin(*KNOWN_BRANDS) & ~small & (F.length(w) >= F.when(ascii_, SHORT_LATIN + 1).otherwise(LEAST_CYRILLIC))


def brand_like(word: str = "word", ignored: tuple[str, ...] = ()) -> Column:
    """Whether a word may be a brand: an ignored one, a known one, one in Latin letters, or a short one."""
    w = F.col(word)
    listed = F.lower(w).isin(*KNOWN_BRANDS, *ignored)
    return listed | w.rlike("^[A-Za-z]+$") | (F.length(w) <= BRAND_LETTERS)


def region_adjectives(words: DataFrame, cities: DataFrame) -> DataFrame:
    """(word, city): the city that a region's adjective comes from. cities: (name). Its ending is replaced by each that a city may have; the longest
    name that exists wins, then the longest ending taken off, then the order of the endings."""
    distinct = words.where("word is not null").select("word").distinct()
    order = sorted(range(len(REGION_ENDINGS)), key=lambda i: (-len(REGION_ENDINGS[i]), i))
    tried = _strings([REGION_ENDINGS[i] for i in order])
    stems = distinct.select("word", F.posexplode(tried).alias("_i", "_e")).where(F.endswith("word", F.col("_e")) & (F.length("word") - F.length("_e") >= 3))
    stems = stems.select("word", "_i", F.expr("substring(word, 1, length(word) - length(_e))").alias("_stem"))
    made = stems.select("word", "_i", "_stem", F.posexplode(_strings(CITY_ENDINGS)).alias("_j", "_c")).select("word", F.concat("_stem", "_c").alias("name"), "_i", "_j")
    best = F.max(F.struct(F.length("name").alias("n"), (-F.col("_i")).alias("i"), (-F.col("_j")).alias("j"), "name"))["name"]
    return made.join(cities.select("name").distinct(), "name").groupBy("word").agg(best.alias("city"))


def other_regions(kw: DataFrame, seed_cities: DataFrame, places: DataFrame) -> DataFrame:
    """(seed_id, kw_id, cities) of rows (seed_id, kw_id, keyword) that name a region by a city which is none of their seed's.

    seed_cities: (seed_id, city, country, admin1), the seeds that name a city; places: (word, kind, country, admin1), as place_lookup gives it.
    Words count by their stem if that is a city, and adjectives by the city they come from, unless it lies in a region of the seed's.
    """
    cities = places.where("kind = 'city'").select(F.col("word").alias("name"), F.upper("country").alias("_country"), F.coalesce("admin1", F.lit("")).alias("_admin1"))
    with_city = kw.where(F.contains(F.lower("keyword"), F.lit(REGION_WORD))).join(seed_cities.select("seed_id").distinct(), "seed_id", "left_semi")
    tokens = with_city.select("seed_id", "kw_id", F.explode(X.words("keyword")).alias("word"))
    plain = tokens.withColumn("name", geo_stem("word")).join(cities.select("name").distinct(), "name").select("seed_id", "kw_id", "name")
    adjectives = region_adjectives(tokens.select("word"), cities).join(cities, F.col("city") == F.col("name")).select("word", "name", "_country", "_admin1")
    own_region = seed_cities.select("seed_id", F.upper("country").alias("_country"), F.coalesce("admin1", F.lit("")).alias("_admin1")).distinct()
    derived = tokens.join(adjectives, "word").join(own_region, ["seed_id", "_country", "_admin1"], "left_anti").select("seed_id", "kw_id", "name")
    own = seed_cities.select("seed_id", geo_stem("city").alias("_stem")).distinct()
    others = plain.unionByName(derived).withColumn("_stem", geo_stem("name")).join(own, ["seed_id", "_stem"], "left_anti")
    return others.groupBy("seed_id", "kw_id").agg(F.array_sort(F.collect_set("name")).alias("cities"))


def foreign_regions(kw: DataFrame, regions: DataFrame, districts: DataFrame, target: str) -> DataFrame:
    """(seed_id, kw_id, reason): the first word of (seed_id, kw_id, keyword) that is a region of another country, else the first pair; pairs are
    looked at only where some word is a region or a district. regions: (name, country), districts: (name)."""
    df = kw.select("seed_id", "kw_id", X.words("keyword").alias("_w"))
    pair = "if(size(_w) > 1, transform(sequence(0, size(_w) - 2), i -> named_struct('n', 2, 'p', i, 'term', concat(_w[i], ' ', _w[i + 1]))), array())"
    grams = df.select("seed_id", "kw_id", F.explode(F.expr(f"concat(transform(_w, (w, i) -> named_struct('n', 1, 'p', i, 'term', w)), {pair})")).alias("g")).select("seed_id", "kw_id", "g.*")
    named = regions.groupBy(F.lower("name").alias("term")).agg(F.min(F.lower("country")).alias("_region"))
    dim = named.join(districts.select(F.lower("name").alias("term"), F.lit(True).alias("_district")).distinct(), "term", "full")
    hits = grams.join(dim, "term").withColumn("_away", F.col("_region").isNotNull() & (F.col("_region") != target.lower()))
    per = hits.groupBy("seed_id", "kw_id").agg(F.bool_or(F.col("n") == 1).alias("_any"), F.min(F.when(F.col("_away"), F.struct("n", "p", "term"))).alias("_b"))
    return per.where("_b is not null and (_b.n = 1 or _any)").select("seed_id", "kw_id", F.concat(F.lit("region:"), "_b.term").alias("reason"))


def other_cities(kw: DataFrame, seeds: DataFrame, seed_cities: DataFrame, places: DataFrame, districts: DataFrame, brands: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, kw_id, cities) of rows (seed_id, kw_id, keyword) that name a city which is none of their seed's, for seeds that name one.

    seeds: (seed_id, seed); seed_cities: (seed_id, city, country, admin1); places: (word, kind, country, pop, admin1, fclass), as place_lookup gives it for words,
    stems and pairs; districts: (name, city), brands: (name); the lexicon has case, too. A word counts as it stands, else by its stem. It is no city
    where it is a word of the seed, a district of any city (but for large places that are none of the seed's), part of a street's or complex's name,
    short, a brand, a noun that no parse calls a name, the second of two genitives, the region of the seed's city as an adjective, or small and
    without a preposition before. Pairs count if they are large, no pair of the seed, and not its region.
    """
    asked = kw.join(seed_cities.select("seed_id").distinct(), "seed_id", "left_semi")
    first = lexicon.where("rank = 0").groupBy("word").agg(F.min(F.struct("pos", "case")).alias("_p"))
    named = lexicon.groupBy("word").agg(F.bool_or(F.arrays_overlap(F.coalesce("grammemes", F.array().cast("array<string>")), _strings(["Geox", "Surn"]))).alias("named"))
    parses = first.join(named, "word").select("word", "_p.pos", "_p.case", "named")
    city = places.where("kind = 'city'").select("word", F.upper("country").alias("country"), F.coalesce("pop", F.lit(0)).alias("pop"), F.coalesce("admin1", F.lit("")).alias("admin1"), "fclass")
    marked = F.lit(True)
    own_district = districts.join(seed_cities.select("seed_id", "city").distinct(), "city").select("seed_id", F.col("name").alias("word"), marked.alias("allowed")).distinct()
    any_district = districts.select(F.col("name").alias("word"), marked.alias("district")).distinct()
    brand = brands.select(F.lower("name").alias("word"), marked.alias("brand")).distinct()
    of_seed = seeds.select("seed_id", F.explode(X.words("seed")).alias("word"))
    anchors = of_seed.select("seed_id", "word").unionByName(of_seed.select("seed_id", geo_stem("word").alias("word"))).distinct()
    own_stems = seed_cities.select("seed_id", geo_stem("city").alias("stem"), F.lit(True).alias("own_city")).distinct()
    own_region = seed_cities.select("seed_id", F.upper("country").alias("country"), F.coalesce("admin1", F.lit("")).alias("admin1"), F.lit(True).alias("own_region")).distinct()

    words = asked.select("seed_id", "kw_id", X.words("keyword").alias("_w")).select("seed_id", "kw_id", "_w", F.posexplode("_w").alias("p", "raw"))
    words = words.select("seed_id", "kw_id", "p", "raw", geo_stem("raw").alias("norm"), F.get("_w", F.col("p") - 1).alias("prev"), F.get("_w", F.col("p") + 1).alias("next"))
    # Each form of a word is looked up once for its seed; a word that any form makes a seed's own or a district is judged as one.
    forms = words.select("seed_id", "raw", "norm", F.explode(F.array_distinct(F.array("raw", "norm"))).alias("word")).distinct()
    looked = forms.join(city, "word", "left").join(own_district, ["seed_id", "word"], "left").join(any_district, "word", "left").join(brand, "word", "left")
    looked = looked.join(anchors.withColumn("anchor", marked), ["seed_id", "word"], "left").withColumn("stem", geo_stem("word")).join(own_stems, ["seed_id", "stem"], "left")
    looked = looked.join(own_region, ["seed_id", "country", "admin1"], "left").fillna(False, ["allowed", "district", "brand", "anchor", "own_city", "own_region"])
    large = F.col("fclass").isin("P", "T") & (F.col("pop") > LARGE_CITY) & ~F.col("own_city")
    mine = F.col("word") == F.col("raw")
    here = F.struct((~mine).alias("late"), "word", "pop", "fclass", "own_region", "own_city", "brand")
    per = looked.groupBy("seed_id", "raw", "norm").agg(
        F.bool_or(F.col("allowed") | F.col("anchor")).alias("_skip"), F.bool_or("district").alias("_district"), F.bool_or(F.coalesce(large, F.lit(False))).alias("_large"),
        F.bool_or(mine & F.col("brand")).alias("_brand"), F.array_sort(F.collect_list(F.when(F.col("pop").isNotNull() & (F.length("word") > SHORT_CITY), here))).alias("_forms"),
    )
    per = per.where(~F.col("_skip") & (~F.col("_district") | F.col("_large")) & (F.size("_forms") > 0))
    tokens = words.join(per, ["seed_id", "raw", "norm"]).join(parses.withColumnRenamed("word", "raw"), "raw", "left")
    tokens = tokens.join(parses.select(F.col("word").alias("prev"), F.col("pos").alias("_ppos"), F.col("case").alias("_pcase")), "prev", "left")
    street = (F.col("raw") != F.col("norm")) & F.col("raw").rlike(f"({'|'.join(CITY_ADJECTIVES)})$") & F.coalesce(F.col("next").isin(*STREET_MARKERS), F.lit(False))
    complex_ = F.coalesce(F.col("prev").isin(*COMPLEX_MARKERS), F.lit(False))
    noun = F.coalesce((F.col("pos") == "NOUN") & ~F.col("named"), F.lit(False)) & ~F.col("raw").rlike(r"^[\x00-\x7F]*$")
    genitives = F.coalesce((F.col("case") == "gent") & (F.col("_pcase") == "gent") & (F.col("_ppos") == "NOUN"), F.lit(False))
    adjective = F.coalesce(F.col("pos") == "ADJF", F.lit(False))
    before = F.coalesce(F.col("prev").isin(*BEFORE_PLACE), F.lit(False))

    def counts(x: Column) -> Column:
        return ~x["brand"] & ~F.col("_brand") & ~(F.coalesce(x["fclass"] == "A", F.lit(False)) & x["own_region"] & adjective) & (before | (x["pop"] > LARGE_CITY))

    chosen = F.get(F.filter("_forms", counts), F.lit(0))
    single = tokens.where(~street & ~complex_ & ~noun & ~genitives).withColumn("_c", chosen).where("_c is not null and not _c.own_city").select("seed_id", "kw_id", F.col("_c.word").alias("name"))

    pair = words.where("next is not null").select("seed_id", "kw_id", "raw", "next", F.concat("raw", F.lit(" "), "next").alias("word"))
    seed_pairs = F.expr("if(size(_w) > 1, transform(sequence(0, size(_w) - 2), i -> concat(_w[i], ' ', _w[i + 1])), array())")
    of_seed_pairs = seeds.select("seed_id", X.words("seed").alias("_w")).select("seed_id", F.explode(seed_pairs).alias("word")).distinct()
    pairs = pair.join(city.where(F.col("pop") > LARGE_CITY), "word").join(of_seed_pairs, ["seed_id", "word"], "left_anti").join(own_region, ["seed_id", "country", "admin1"], "left")
    adjectives = parses.where("pos = 'ADJF'").select("word", marked.alias("_adj"))
    pairs = pairs.join(adjectives.toDF("raw", "_a1"), "raw", "left").join(adjectives.toDF("next", "_a2"), "next", "left")
    region = (F.col("fclass") == "A") & F.coalesce("own_region", F.lit(False)) & F.coalesce("_a1", "_a2", F.lit(False))
    double = pairs.where(~F.coalesce(region, F.lit(False))).withColumn("stem", geo_stem("word")).join(own_stems, ["seed_id", "stem"], "left_anti").select("seed_id", "kw_id", F.col("word").alias("name"))
    return single.unionByName(double).groupBy("seed_id", "kw_id").agg(F.array_sort(F.collect_set("name")).alias("cities"))
