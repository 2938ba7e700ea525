"""Geography: stems, contexts, and the rules that block keywords about other places.

geo: (name, countries array<string>) in lower case; districts: (name, city, country).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.sources.shared import looked_up, written

#: Endings that a stem loses, the longest that fits; markers of streets and complexes; prepositions of travel.
ENDINGS = (
    "ская", "ский", "ской", "ском", "скими", "ских", "скую", "ское", "кая", "кий", "кой", "ком", "кими", "ких", "кую", "кое",
    "ой", "ый", "ий", "ом", "ем", "ам", "ях", "ах", "ою", "ее", "ие", "ые", "е", "и", "у", "ю", "а", "я", "ы",
)
#: What a word must end in to lose anything: an ending's last letter, or a line's end, before which the pattern's $ stands too.
LAST_LETTERS = (*sorted({e[-1] for e in ENDINGS}), "\n", "\r", "\u0085", "\u2028", "\u2029")
STREETS = ("улица", "ул", "проспект", "пр", "переулок", "шоссе", "бульвар", "площадь")
COMPLEXES = ("жк", "тц", "трц", "бц", "комплекс")
TRAVEL = ("в", "во", "из", "до", "через", "на")


def geo_stem(c) -> Column:
    """A word without its case ending, as long as three letters are left."""
    w = X.col(c)
    stem = F.regexp_replace(w, f"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")
    return F.when(F.right(w, F.lit(1)).isin(*LAST_LETTERS), stem).otherwise(w)


def tokens(kw: DataFrame) -> DataFrame:
    """(seed_id, kw_id, p, n, term, before, after): words, pairs and triples with the words around them."""
    df = kw.select("seed_id", "kw_id", X.words("keyword").alias("_w"))
    grams = F.expr(
        """flatten(transform(sequence(1, 3), n -> if(size(_w) >= n, transform(sequence(0, size(_w) - n), i ->
            named_struct('p', i, 'n', n, 'term', array_join(slice(_w, i + 1, n), ' '), 'before', if(i > 0, _w[i - 1], null), 'after', get(_w, i + n))), array())))"""
    )
    return df.select("seed_id", "kw_id", F.explode(grams).alias("g")).select("seed_id", "kw_id", "g.*")


def known_tokens(kw: DataFrame, dims: list[DataFrame], lexicon: DataFrame | None = None) -> DataFrame:
    """The tokens that start with a name's first word in any case form, as long as such names may be: all that by_form finds. dims: (name). Written once.

    Equal words have equal stems, so one look-up of a word's stem drops the others where they arise, before tokens are
    built or shuffled. With a lexicon a lemma may be any word, so all tokens stay.
    """
    if lexicon is not None:
        return tokens(kw)
    parts = reduce(DataFrame.unionByName, (d.select(F.split("name", " ").alias("_n")) for d in dims))
    heads = parts.groupBy(geo_stem(F.col("_n")[0]).alias("_head")).agg(F.max(F.least(F.size("_n"), F.lit(3))).alias("_most"))
    df = kw.select("seed_id", "kw_id", X.settled(X.words("keyword")).alias("_w"))
    at = df.select("*", F.posexplode(F.transform("_w", geo_stem)).alias("p", "_head")).join(looked_up(heads), "_head")
    wide = at.select("seed_id", "kw_id", "_w", "p", F.explode(F.expr("sequence(1, least(_most, size(_w) - p))")).alias("n"))
    around = (F.expr(e).alias(c) for e, c in (("array_join(slice(_w, p + 1, n), ' ')", "term"), ("if(p > 0, _w[p - 1], null)", "before"), ("get(_w, p + n)", "after")))
    return written(wide.select("seed_id", "kw_id", "p", "n", *around))


def _stems(c) -> Column:
    return F.array_join(F.transform(F.split(c, " "), geo_stem), " ")


def is_street() -> Column:
    """An adjective with a street's marker behind it."""
    return F.col("term").rlike("(ая|ий|ой|ый|ого|ской)$") & F.col("after").isin(*STREETS)


def is_complex() -> Column:
    return F.coalesce(F.col("before").isin(*COMPLEXES), F.lit(False))


def by_form(toks: DataFrame, dim: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """The terms that are names of dim in any case form, with dim's columns: only exact ones where there are any, then lemmas, then stems."""
    keys = lambda *cs: F.explode(F.array(*(F.struct(F.lit(k).alias("form"), c.alias("key")) for k, c in cs)))
    df, own = toks, [(0, F.col("term")), (2, _stems("term"))]
    if lexicon is not None:
        first = lexicon.where("rank = 0").groupBy("word").agg(F.min("lemma").alias("lemma"))
        words = toks.select("term").distinct().select("term", F.posexplode(F.split("term", " ")).alias("i", "word")).join(first, "word", "left")
        lemmas = words.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "word").alias("w"))))["w"].alias("_w"))
        lemmas = lemmas.select("term", F.array_join("_w", " ").alias("_lemma"))
        df, own = toks.join(lemmas, "term", "left"), [*own, (1, F.col("_lemma"))]
    df = df.select(*toks.columns, keys(*own).alias("_k")).select(*toks.columns, "_k.*")
    names = looked_up(dim.select("*", keys((0, F.col("name")), (1, F.col("name")), (2, _stems("name"))).alias("_k")).select(*dim.columns, "_k.*"))
    best = F.min("form").over(Window.partitionBy("seed_id", "kw_id", "p", "n"))
    # Dealt by keyword once: what groups a keyword's hits later needs no other shuffle.
    return df.join(names, ["form", "key"]).repartition("seed_id", "kw_id").withColumn("_best", best).where("form = _best").drop("form", "key", "_best")


def precheck(toks: DataFrame, geo: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Terms that are places, with the names they may stand for and the countries of these; keywords without any need no further look."""
    hits = by_form(toks, geo.select("name", "countries"), lexicon).groupBy(*toks.columns)
    return hits.agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_distinct(F.flatten(F.collect_list("countries"))).alias("countries"))


def _seed_tokens(seeds: DataFrame) -> DataFrame:
    return tokens(seeds.select("seed_id", F.lit(0).alias("kw_id"), F.col("seed").alias("keyword")))


def seed_places(seeds: DataFrame, geo: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(seed_id, places): the places in each seed."""
    places = precheck(_seed_tokens(seeds), geo, lexicon).select("seed_id", F.explode("names").alias("name"))
    return places.groupBy("seed_id").agg(F.collect_set("name").alias("places"))


def geo_rules(
    kw: DataFrame, seeds: DataFrame, geo: DataFrame, districts: DataFrame | None, target: str, blocklist: DataFrame | None = None,
    lexicon: DataFrame | None = None, countries: DataFrame | None = None, abbreviations: DataFrame | None = None,
) -> DataFrame:
    """(seed_id, kw_id, reason): the first rule that blocks each keyword; others are absent. kw: (seed_id, kw_id, keyword).

    Places, districts and countries are found in any case form by stems, and by lemmas with a lexicon.
    blocklist: a caller's list of terms that always block. foreign_city: the longest place at a position lies outside
    the target, is none of the seed's, and stands in no street or complex. foreign_district, other_district:
    a district of another country, or of another city than the seed's. abbreviation, with abbreviations (name, country):
    a short name of a city elsewhere. country, with countries (name, country): another country than the target and
    those of the seed's places, neither named in the seed nor after a preposition of travel.
    """
    lower = lambda d, *cs: None if d is None else d.select(*(F.lower(c).alias(c) for c in cs))
    districts, countries, abbreviations, blocklist = (
        lower(districts, "name", "city", "country"), lower(countries, "name", "country"), lower(abbreviations, "name", "country"), lower(blocklist, "name"),
    )
    geo = written(geo.select("name", "countries"))
    toks = known_tokens(kw, [d for d in (geo, districts, countries, abbreviations, blocklist) if d is not None], lexicon)
    low = target.lower()
    of_seed = looked_up(seed_places(seeds, geo, lexicon))
    places = precheck(toks, geo, lexicon).join(of_seed, "seed_id", "left")
    longest = places.groupBy("seed_id", "kw_id", "p").agg(F.max(F.struct("n", "term", "names", "countries", "before", "after", "places")).alias("g")).select("seed_id", "kw_id", "p", "g.*")
    own_seed = F.coalesce(F.arrays_overlap("places", "names"), F.lit(False))
    named = F.coalesce(is_street(), F.lit(False)) | is_complex()
    reason = lambda df, k, rule: df.select("seed_id", "kw_id", F.lit(k).alias("rule"), F.concat(F.lit(f"{rule}:"), "term").alias("reason"))
    hits = reason(longest.where(~F.array_contains("countries", low) & ~own_seed & ~named), 2, "foreign_city")
    if districts is not None:
        area = by_form(toks, districts, lexicon).join(of_seed, "seed_id", "left")
        hits = hits.unionByName(reason(area.where(F.col("country") != low), 3, "foreign_district"))
        other = (F.col("country") == low) & (F.size(F.coalesce("places", F.array())) > 0) & ~F.array_contains("places", F.col("city"))
        hits = hits.unionByName(reason(area.where(other), 4, "other_district"))
    if blocklist is not None:
        listed = toks.join(looked_up(blocklist.select(F.col("name").alias("term")).distinct()), "term", "left_semi")
        hits = hits.unionByName(reason(listed, 1, "listed"))
    if abbreviations is not None:
        short = toks.join(looked_up(abbreviations.withColumnRenamed("name", "term")), "term")
        hits = hits.unionByName(reason(short.where((F.col("country") != low) & ~named), 5, "abbreviation"))
    if countries is not None:
        seed = _seed_tokens(seeds)
        own = precheck(seed, geo, lexicon).select("seed_id", F.explode("countries").alias("country"))
        own = own.unionByName(by_form(seed, countries, lexicon).select("seed_id", "country")).distinct()
        travel = F.coalesce(F.col("before").isin(*TRAVEL), F.lit(False))
        abroad = by_form(toks, countries, lexicon).where((F.col("country") != low) & ~named & ~travel).join(own, ["seed_id", "country"], "left_anti")
        hits = hits.unionByName(reason(abroad, 6, "country"))
    return hits.groupBy("seed_id", "kw_id").agg(F.min(F.struct("rule", "reason"))["reason"].alias("reason"))


def rule_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy(F.substring_index("reason", ":", 1).alias("rule")).agg(F.count("*").alias("n"))


def own_geo(kw: DataFrame, geo: DataFrame, target: str) -> DataFrame:
    """(seed_id, kw_id, term): the longest place of the target in each keyword."""
    hits = precheck(known_tokens(kw, [geo]), geo).where(F.array_contains("countries", target.lower()))
    return hits.groupBy("seed_id", "kw_id").agg(F.max(F.struct("n", -F.col("p"), "term"))["term"].alias("term"))


def without_seed_place(kw: DataFrame, seeds: DataFrame, geo: DataFrame) -> DataFrame:
    """Keywords of seeds with a place that have none of the seed's places."""
    wanted = seed_places(seeds, geo).select("seed_id", F.explode("places").alias("name"))
    found = precheck(known_tokens(kw, [geo]), geo).select("seed_id", "kw_id", F.explode("names").alias("name"))
    has = found.join(wanted, ["seed_id", "name"]).select("seed_id", "kw_id").distinct()
    return kw.join(wanted.select("seed_id").distinct(), "seed_id", "left_semi").join(has, ["seed_id", "kw_id"], "left_anti")


def find_terms(texts: DataFrame, dim: DataFrame) -> DataFrame:
    """(kw_id, found): a dictionary's terms in each text. texts: (seed_id, kw_id, keyword), dim: (name)."""
    hits = tokens(texts).join(dim.select(F.col("name").alias("term")).distinct(), "term", "left_semi")
    return hits.groupBy("seed_id", "kw_id").agg(F.array_sort(F.collect_set("term")).alias("found"))
