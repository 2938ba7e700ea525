"""Dictionaries as dimension tables: gazetteers, brands, retailers, districts, thesaurus, and payloads of suggestions.

cities: (seq, name, country, population, alternatenames array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions import text as X


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seed_id long, seed string, country string, language string, operator string, use_numbers boolean, filters array<string>").json(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a body (seed_id, seed, keywords array<string>), with each keyword's place in it."""
    rows = spark.read.schema("seed_id long, seed string, keywords array<string>").json(path)
    return rows.select("seed_id", "seed", F.posexplode("keywords").alias("pos", "keyword"))


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """(name, city, country) in lower case of a body {name: {city, country}}; entries without a country, or with an unknown one, are left out."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<city: string, country: string>>").alias("m"))
    rows = body.select(F.explode("m").alias("name", "v")).select(F.lower("name").alias("name"), F.lower(F.coalesce("v.city", F.lit(""))).alias("city"), F.lower("v.country").alias("country"))
    return rows.where("country is not null and country not in ('', 'unknown')").groupBy("name").agg(F.min(F.struct("city", "country")).alias("d")).select("name", "d.city", "d.country")


def gazetteer_multi(cities: DataFrame, countries: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(name, countries): main and alternate names with all their countries; countries: (name, country) adds names of countries."""
    names = cities.select(F.explode(F.array_append(F.coalesce("alternatenames", F.array()), F.col("name"))).alias("name"), F.lower("country").alias("country"))
    if countries is not None:
        names = names.unionByName(countries.select("name", F.lower("country").alias("country")))
    names = names.where(F.col("country") == only.lower()) if only else names
    return names.withColumn("name", X.squeeze("name")).where("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("country")).alias("countries"))


def _accepted(name: Column) -> Column:
    """Alternate names that may count: up to three words, 3 to 40 characters, letters only, and no scripts mixed between words."""
    letters = name.rlike(r"^[\p{IsLatin}\p{IsCyrillic} '’-]{3,40}$") & (F.size(F.split(name, " ")) <= 3)
    return letters & ~(name.contains(" ") & name.rlike(r"\p{IsLatin}") & name.rlike(r"\p{IsCyrillic}"))


def gazetteer_one(cities: DataFrame) -> DataFrame:
    """(name, country): the last main name wins, else the first accepted alternate one."""
    main = cities.select(X.norm("name").alias("name"), F.lower("country").alias("country"), F.lit(0).alias("alt"), (-F.col("seq")).alias("at"))
    alt = cities.select(F.explode("alternatenames").alias("name"), F.lower("country").alias("country"), F.lit(1).alias("alt"), F.col("seq").alias("at")).withColumn("name", X.norm("name"))
    rows = main.unionByName(alt.where(_accepted(F.col("name")))).where("name <> ''")
    return rows.groupBy("name").agg(F.min(F.struct("alt", "at", "country"))["country"].alias("country"))


def gazetteer_pop(cities: DataFrame, least: int = 1000) -> DataFrame:
    """(name, country, population): spellings of places of some size; the largest place wins, the first on ties."""
    names = F.array_append(F.coalesce("alternatenames", F.array()), F.col("name"))
    rows = cities.where(F.col("population") >= least).select("seq", F.lower("country").alias("country"), "population", F.explode(names).alias("name"))
    rows = rows.withColumn("name", X.norm("name")).where("name <> ''")
    forms = F.array_distinct(F.array("name", F.replace("name", F.lit("ё"), F.lit("е")), F.replace("name", F.lit(" "), F.lit("-"))))
    best = F.max(F.struct("population", -F.col("seq"), "country"))
    return rows.withColumn("name", F.explode(forms)).groupBy("name").agg(best.alias("b")).select("name", "b.country", "b.population")


def gazetteer_override(gazetteer: DataFrame, forced: DataFrame, always: bool) -> DataFrame:
    """(name, country) with forced entries: always, or only for names that are not there yet."""
    both = gazetteer.select("name", F.col("country").alias("_g")).join(forced.select("name", F.col("country").alias("_f")), "name", "full")
    return both.select("name", (F.coalesce("_f", "_g") if always else F.coalesce("_g", "_f")).alias("country"))


def city_canonical(cities: DataFrame) -> DataFrame:
    """(name, canonical): of each spelling the main name of the largest place."""
    rows = cities.select(X.norm("name").alias("canonical"), "population", "seq", F.explode(F.array_append(F.coalesce("alternatenames", F.array()), F.col("name"))).alias("name"))
    rows = rows.withColumn("name", X.norm("name")).where("name <> ''")
    return rows.groupBy("name").agg(F.max(F.struct("population", -F.col("seq"), "canonical"))["canonical"].alias("canonical"))


def geo_db(cities: DataFrame, districts: DataFrame) -> DataFrame:
    """(name, countries): cities and districts together, countries in upper case; unknown countries of districts are left out."""
    rows = cities.select("name", "country").unionByName(districts.where("country <> '' and lower(country) <> 'unknown'").select("name", "country"))
    return rows.groupBy(X.norm("name").alias("name")).agg(F.array_sort(F.collect_set(F.upper("country"))).alias("countries"))


def district_dims(districts: DataFrame, canonical: DataFrame) -> DataFrame:
    """(city, districts): the districts of each canonical city."""
    rows = districts.select("name", X.norm("city").alias("_c")).join(canonical.select(F.col("name").alias("_c"), "canonical"), "_c", "left")
    return rows.groupBy(F.coalesce("canonical", "_c").alias("city")).agg(F.array_sort(F.collect_set(X.norm("name"))).alias("districts"))


def with_fallback(geo: DataFrame, fallback: DataFrame) -> DataFrame:
    """geo, and fallback rows for names that it lacks."""
    return geo.unionByName(fallback.join(geo.select("name"), "name", "left_anti").select(*geo.columns))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a file with a list under brands."""
    rows = spark.read.schema("brands array<string>").option("multiLine", True).json(path)
    return rows.select(F.explode("brands").alias("name")).select(X.norm("name").alias("name")).where("name <> ''").distinct()


def retailers(rows: DataFrame) -> DataFrame:
    """(name, countries) in lower case; without countries a retailer is everywhere."""
    everywhere = F.array(F.lit("*"))
    listed = F.transform("countries", lambda c: F.lower(c))
    return rows.select(X.norm("name").alias("name"), F.when(F.size(F.coalesce("countries", F.array())) == 0, everywhere).otherwise(listed).alias("countries")).where("name <> ''")


def read_thesaurus(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """(lemma, rel, other) of lines (lemma, synonyms, cohyponyms); up to so many co-hyponyms of a lemma."""
    rows = spark.read.schema("lemma string, synonyms array<string>, cohyponyms array<string>").json(path)
    rel = lambda name, c: rows.select("lemma", F.lit(name).alias("rel"), F.explode(c).alias("other"))
    return rel("synonym", F.col("synonyms")).unionByName(rel("cohyponym", F.slice("cohyponyms", 1, most)))


def decode_suggestions(raw: DataFrame) -> DataFrame:
    """(id, i, suggestion) of response bodies (id, source, body).

    Three kinds: a JSON list [query, [items]], bare, behind )]}' or inside a callback; {results: [{text}]}; and
    {AS: {Results: [{Suggests: [{Txt}]}]}}. Items are strings, or lists or objects that start with one.
    """
    body = F.regexp_replace(F.regexp_replace("body", r"^\s*\)\]\}'\s*", ""), r"^\s*[\w.$]+\(([\s\S]*)\)\s*;?\s*$", "$1")
    df = raw.withColumn("_b", body)
    items = F.from_json(F.get(F.from_json("_b", "array<string>"), F.lit(1)), "array<string>")
    first = F.coalesce(F.get(F.from_json("_i", "array<string>"), F.lit(0)), F.get_json_object("_i", "$.query"), F.get_json_object("_i", "$.text"), F.col("_i"))
    texts = F.from_json("_b", "results array<struct<text:string>>")["results"]["text"]
    nested = F.from_json("_b", "AS struct<Results:array<struct<Suggests:array<struct<Txt:string>>>>>")["AS"]["Results"]["Suggests"]
    flat = F.transform(F.flatten(nested), lambda x: x["Txt"])
    df = df.withColumn("_items", F.when(F.col("source") == "results", texts).when(F.col("source") == "nested", flat).otherwise(items))
    return df.select("id", F.posexplode("_items").alias("i", "_i")).select("id", "i", X.strip_tags(first).alias("suggestion")).where("suggestion <> ''")


def with_metrics(kw: DataFrame, metrics: DataFrame) -> DataFrame:
    """Keywords with their metrics, bids in units instead of micros. metrics: (keyword, searches, competition, low_micros, high_micros)."""
    unit = lambda c: (F.col(c) / F.lit(1_000_000)).cast("decimal(18,6)")
    rows = metrics.select(X.norm("keyword").alias("_k"), "searches", "competition", unit("low_micros").alias("low_bid"), unit("high_micros").alias("high_bid"))
    return kw.withColumn("_k", X.norm("keyword")).join(rows, "_k", "left").drop("_k")


def uule_lookup(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the targeting code of the seed's city, or of its country's default city. places: (country, city, canonical, is_default)."""
    coded = places.select(F.lower("country").alias("_c"), F.lower("city").alias("_t"), X.uule("canonical").alias("code"), "is_default")
    own = seeds.withColumn("_c", F.lower("country")).withColumn("_t", F.lower("city")).join(coded.drop("is_default"), ["_c", "_t"], "left")
    default = coded.where("is_default").select("_c", F.col("code").alias("_d"))
    return own.join(default, "_c", "left").withColumn("code", F.coalesce("code", "_d")).drop("_c", "_t", "_d")


def write_csv(kw: DataFrame, path: str) -> None:
    """type;value rows."""
    kw.select(F.col("label").alias("type"), F.col("keyword").alias("value")).write.option("sep", ";").option("header", True).csv(path)


def write_diagnostics(df: DataFrame, path: str) -> None:
    df.write.partitionBy("seed_id").json(path)
