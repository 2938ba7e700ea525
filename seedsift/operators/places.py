"""Places in a tail beside the places of its seed: truncated names, districts and cities that are not the seed's own, and
what follows the seed's city.

Dictionaries: geo (name, countries array<string>) and districts (name, city, country) in lower case; names (name, canonical)
has every spelling of a city with the one that stands for it. The lexicon is that of seedsift.operators.grammar. What
the dictionaries know is put into one table of terms; each distinct word is looked up once, by itself and by its lemma,
and the detectors are expressions over a tail's few words.

Null and empty tails fire nothing. A term with several cities or countries counts for the least one. Without a lexicon a
word is its own lemma and has no part of speech.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X

#: Joining words inside names of places, words behind and before names that are no cities there, endings of adjectives.
CONNECTORS = ("на", "при", "над", "по", "под", "за", "из", "у", "во", "в")
STREET_MARKERS = (
    "район", "шоссе", "массив", "проспект", "улица", "переулок", "площадь", "бульвар", "переезд", "вокзал", "набережная", "аллея", "тупик",
    "квартал", "проезд", "станция", "метро", "вулиця", "провулок", "майдан", "набережна", "площа", "станція",
    "ул", "пр", "просп", "пер", "пл", "ст", "наб", "бул",
)
COMPLEX_MARKERS = ("жк", "мкр", "микрорайон", "жилой", "комплекс", "тц", "трц", "бц", "жм", "жилмассив", "житловий")
CITY_ADJECTIVES = ("ский", "ская", "ское", "ской", "ским", "ского", "ских", "ськ", "ська", "ське", "ською", "ському", "ських")
DISTRICT_WORDS = ("район", "микрорайон", "квартал")
#: Parts of speech without content, of words before a district's word, and of words that are no truncated name.
FUNCTION = ("CONJ", "PREP", "PRCL", "INTJ")
BEFORE_DISTRICT = ("ADJF", "ADJS", "NOUN", "PRTF", "PRTS")
NO_PART = ("ADJF", "ADJS", "NUMR")
#: The least letters of a name's last part, of a truncated name, and of a lemma that is looked up.
LEAST_LAST, LEAST_PART, LEAST_LEMMA = 4, 3, 5
#: Fixed value: positive signals that mean nothing behind the seed's city.
STRUCTURAL = ("geo", "postmod_adj", "premod_adj", "type_spec", "model_variant")


def name_parts(geo: DataFrame) -> DataFrame:
    """(part, name, countries): first parts of compound names, and last ones of four letters or more where no joining word stands
    inside. A part of several names belongs to the least of them, decided here once."""
    mark = F.when(F.contains("name", F.lit("-")), "-").otherwise(" ")
    compound = geo.where(r"name rlike '[- ]'").select("name", "countries", F.split("name", mark).alias("_p"))
    last = F.element_at("_p", -1)
    free = ~F.arrays_overlap("_p", F.array(*map(F.lit, CONNECTORS))) & (F.length(last) >= LEAST_LAST)
    rows = compound.select("name", "countries", F.explode(F.array_distinct(F.array_compact(F.array(F.get("_p", F.lit(0)), F.when(free, last))))).alias("part")).where("part <> ''")
    return rows.groupBy("part").agg(F.min(F.struct("name", "countries")).alias("_n")).select("part", "_n.name", "_n.countries")


def place_terms(geo: DataFrame, names: DataFrame, districts: DataFrame, target: str) -> DataFrame:
    """(term, geo, home, city, district, abroad, part_of, part_abroad): what is known of a word; home: a place of the target;
    city: its canonical name; district: it names one; abroad: one of another country; part_of: the name that it is a part of."""
    low = target.lower()
    outside = lambda c: ~F.array_contains(c, low)
    rows = [
        geo.select(F.col("name").alias("term"), F.lit(True).alias("geo"), F.array_contains("countries", low).alias("home")),
        names.select(F.col("name").alias("term"), F.col("canonical").alias("city")),
        districts.select(F.lower("name").alias("term"), F.lit(True).alias("district"), (F.lower("country") != F.when(F.col("country") != "", low)).alias("abroad")),
        name_parts(geo).select(F.col("part").alias("term"), F.col("name").alias("part_of"), outside("countries").alias("part_abroad")),
    ]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    flags = ("geo", "home", "district", "abroad", "part_abroad")
    return both.groupBy("term").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags), *(F.min(c).alias(c) for c in ("city", "part_of")))


def word_facts(words: DataFrame, terms: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """(word, f): the first parse of each distinct word, whether any parse is a place's name, and what is known of the word and of its lemma."""
    if lexicon is None:
        parsed = words.select("word", F.col("word").alias("lemma"), F.lit(None).cast("string").alias("pos"), *(F.lit(False).alias(c) for c in ("known", "geox", "apro")))
    else:
        marks = F.col("grammemes") if "grammemes" in lexicon.columns else F.array().cast("array<string>")
        known = F.col("known") if "known" in lexicon.columns else F.lit(True)
        top = F.min(F.struct("rank", "lemma", "pos", F.coalesce(F.array_contains(marks, "Apro"), F.lit(False)).alias("apro")))
        lex = lexicon.groupBy("word").agg(top.alias("_t"), F.coalesce(F.bool_or(known), F.lit(False)).alias("known"), F.coalesce(F.bool_or(F.array_contains(marks, "Geox")), F.lit(False)).alias("geox"))
        lex = lex.select("word", "_t.lemma", "_t.pos", "known", "geox", "_t.apro")
        parsed = words.join(lex, "word", "left").withColumn("lemma", F.coalesce("lemma", "word")).fillna(False, ["known", "geox", "apro"])
    own = terms.withColumnRenamed("term", "word")
    by_lemma = terms.select(F.col("term").alias("lemma"), *(F.col(c).alias(f"l_{c}") for c in terms.columns if c != "term"))
    wide = parsed.join(own, "word", "left").join(by_lemma, "lemma", "left")
    flags = [c for c, t in wide.dtypes if t == "boolean"]
    return wide.fillna(False, flags).select("word", F.struct(*(c for c in wide.columns)).alias("f"))


def with_facts(df: DataFrame, columns: dict[str, str], terms: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Adds, by array column of words, an array of their facts. Distinct words and distinct arrays are looked up once."""
    arrays = None
    for source in columns:
        part = df.select(F.col(source).alias("_w")).where(F.size(source) > 0)
        arrays = part if arrays is None else arrays.unionByName(part)
    tokens = arrays.distinct().select("_w", F.posexplode("_w").alias("_i", "word"))
    facts = word_facts(tokens.select("word").distinct(), terms, lexicon)
    pairs = F.array_sort(F.collect_list(F.struct("_i", "f")))
    looked = tokens.join(facts, "word").groupBy("_w").agg(F.transform(pairs, lambda x: x["f"]).alias("_f"))
    for source, target in columns.items():
        df = df.join(looked.toDF(source, target), source, "left").withColumn(target, F.coalesce(target, F.array().cast(looked.schema["_f"].dataType)))
    return df


def _in(value: str, names: tuple[str, ...]) -> str:
    return f"coalesce({value} in ({', '.join(map(repr, names))}), false)"


#: The canonical cities of a seed's words: a common noun is none, however a city may be spelled.
CITIES = (
    r"filter(transform(filter(_sf, x -> not (coalesce(x.pos = 'NOUN', false) and not x.geox and x.word rlike '[^\\x00-\\x7F]')), x -> coalesce(x.city, x.l_city)), c -> c is not null)"
)


def seed_cities(seeds: DataFrame, terms: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(seed_id, city, cities): the first city of each seed of (seed_id, seed), null without one, and all of them, sorted."""
    df = with_facts(seeds.select("seed_id", X.words("seed").alias("_sw")), {"_sw": "_sf"}, terms, lexicon).withColumn("_c", F.expr(CITIES))
    return df.select("seed_id", F.get("_c", F.lit(0)).alias("city"), F.array_sort(F.array_distinct("_c")).alias("cities"))


def _district_pairs(df: DataFrame, districts: DataFrame, names: DataFrame) -> DataFrame:
    """(tail, _district): canonical city of the district that a tail's first pair with a district's word names; null where it is not known."""
    known = districts.select(F.lower("name").alias("_name"), F.lower("city").alias("name")).join(names, "name", "left")
    known = known.groupBy("_name").agg(F.min(F.coalesce("canonical", "name")).alias("_city"))
    forms = F.expr("array(concat(_a.word, ' ', _b.word), concat(_a.word, ' ', _b.lemma), concat(_a.lemma, ' ', _b.word), concat(_a.lemma, ' ', _b.lemma))")
    pairs = df.where("_at is not null").select("tail", F.expr("_tf[_at]").alias("_a"), F.expr("_tf[_at + 1]").alias("_b")).distinct().select("tail", F.posexplode(forms).alias("_rank", "_name"))
    found = pairs.join(known, "_name", "left").groupBy("tail").agg(F.min(F.when(F.col("_city").isNotNull(), F.struct("_rank", "_city")))["_city"].alias("_district"))
    return found


def place_signals(tails: DataFrame, geo: DataFrame, names: DataFrame, districts: DataFrame, target: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds to distinct rows with (seed_id, seed, tail): truncated, truncated_foreign, wrong_district, unknown_district, wrong_city, seed_city.

    truncated: the tail is one word, a part of a compound name; truncated_foreign: one of another country, and no common word.
    wrong_district: it names a district of another city than the seed's first; unknown_district: one that is not known.
    wrong_city: a word is a city of the target, but none of the seed's, and neither a district nor part of a street's or complex's name.
    """
    terms = place_terms(geo, names, districts, target)
    df = tails.withColumn("_tw", X.words("tail")).withColumn("_sw", X.words("seed"))
    df = with_facts(df, {"_tw": "_tf", "_sw": "_sf"}, terms, lexicon)
    df = df.withColumn("_cities", X.settled(F.expr(CITIES))).withColumn("seed_city", F.get("_cities", F.lit(0)))
    word = "get(_tf, 0)"
    part = f"size(_tf) = 1 and not {word}.word rlike '^\\\\p{{Nd}}+$' and length({word}.word) >= {LEAST_PART} and not {word}.geo and not {word}.l_geo and not {_in(word + '.pos', NO_PART)}"
    truncated = f"coalesce({part} and coalesce({word}.part_of, {word}.l_part_of) is not null, false)"
    abroad = f"if({word}.part_of is not null, {word}.part_abroad, {word}.l_part_abroad)"
    pair = f"i -> ({_in('_tf[i + 1].word', DISTRICT_WORDS)} or {_in('_tf[i + 1].lemma', DISTRICT_WORDS)}) and {_in('_tf[i].pos', BEFORE_DISTRICT)} and not _tf[i].apro"
    street = f"x.word <> x.lemma and x.word rlike '({'|'.join(CITY_ADJECTIVES)})$' and {_in('get(_tf, i + 1).word', STREET_MARKERS)}"
    complex_ = f"i > 0 and {_in('get(_tf, i - 1).word', COMPLEX_MARKERS)}"
    key = f"case when x.home then coalesce(x.city, x.word) when length(x.word) >= {LEAST_LEMMA} and x.lemma <> x.word and x.l_home then coalesce(x.l_city, x.lemma) end"
    other = f"transform(_tf, (x, i) -> if(x.district or {_in('x.pos', FUNCTION)} or ({street}) or ({complex_}), null, {key}))"
    df = df.withColumns({
        "truncated": F.expr(truncated), "truncated_foreign": F.expr(f"{truncated} and not ({word}.known and not {word}.geox) and {abroad}"),
        "wrong_city": F.expr(f"size(_cities) > 0 and exists({other}, c -> c is not null and not array_contains(_cities, c))"),
        "_at": F.expr(f"if(size(_tf) > 1, get(filter(sequence(0, size(_tf) - 2), {pair}), 0), null)"),
    })
    df = df.join(_district_pairs(df, districts, names), "tail", "left")
    in_city = F.col("seed_city").isNotNull() & F.col("_at").isNotNull()
    wrong = in_city & F.coalesce((F.col("_district") != F.col("seed_city")) & (F.col("_district") != ""), F.lit(False))
    df = df.withColumns({"wrong_district": wrong, "unknown_district": in_city & F.col("_district").isNull()})
    added = ["truncated", "truncated_foreign", "wrong_district", "unknown_district", "wrong_city", "seed_city"]
    return df.select(*tails.columns, *added)


def content_after_city(kw: DataFrame, geo: DataFrame, names: DataFrame, districts: DataFrame, target: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds after_city to rows with (keyword, seed): whether a word with content follows the last word that is one of the seed's cities."""
    terms = place_terms(geo, names, districts, target)
    df = kw.withColumn("_kw", X.words("keyword")).withColumn("_sw", X.words("seed"))
    df = with_facts(df, {"_kw": "_kf", "_sw": "_sf"}, terms, lexicon).withColumn("_cities", X.settled(F.expr(CITIES)))
    last = "array_max(transform(_kf, (x, i) -> if(array_contains(_cities, coalesce(x.city, x.l_city)), i, -1)))"
    after = f"{last} >= 0 and exists(slice(_kf, {last} + 2, size(_kf)), x -> not {_in('x.pos', FUNCTION)})"
    return df.withColumn("after_city", F.coalesce(F.expr(f"size(_cities) > 0 and size(_kf) > 0 and {after}"), F.lit(False))).select(*kw.columns, "after_city")


def settle_places(fired: DataFrame) -> DataFrame:
    """fired (positive, negative, own_geo, after_city, seed_city): a place that earlier rules confirmed counts as one where the seed
    names no city, and drops what speaks against it; behind the seed's city structural signals go."""
    known = F.col("own_geo") & F.col("seed_city").isNull() & ~F.array_contains("positive", "geo")
    against = F.array(F.lit("truncated_geo"), F.lit("truncated_geo_foreign"), F.lit("foreign_geo"))
    positive = F.when(known, F.array_append("positive", F.lit("geo"))).otherwise(F.col("positive"))
    positive = F.when(F.col("after_city"), F.array_except(positive, F.array(*map(F.lit, STRUCTURAL)))).otherwise(positive)
    negative = F.when(F.col("own_geo"), F.array_except("negative", against)).otherwise(F.col("negative"))
    return fired.withColumns({"positive": positive, "negative": negative})
