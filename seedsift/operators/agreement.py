"""How a tail fits its seed: the seed's head noun, agreement in gender and number, words shared with valid tails,
mismatch of categories, and what is left of a suggestion without its seed and foreign places.

The lexicon has (word, rank, lemma, pos, gender, number); the parse of rank 0 counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators.statistics import cosine, norm

#: Adjectives and participles, and the scores of agreement.
ADJECTIVES, PARTICIPLE = ("ADJF", "ADJS"), "PRTF"
AGREES, AGREES_PARTICIPLE, NUMERIC, PARTLY, NOT_AT_ALL = 1.0, 0.9, 0.8, 0.5, 0.3
#: Shares of common letter triples up to and from which they decide alone, and the least cosine between.
FAR, NEAR, LEAST_COSINE = 0.05, 0.20, 0.35
#: Words that say nothing about a tail.
STOP_WORDS = (
    "и", "или", "на", "в", "для", "с", "по", "от", "из", "к", "у", "а", "но", "не", "ни", "да", "же", "ли", "бы", "то", "что",
    "как", "где", "кто", "чем", "при", "до", "без", "под", "над", "за", "про", "через", "это", "его", "её", "их", "мой", "наш",
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "and", "or", "is", "are", "was", "be",
    "купить", "цена", "стоит", "можно", "нужно", "лучше", "какой", "сколько", "новый", "своими", "руками",
)


def _first_parse(lexicon: DataFrame, *columns: str) -> DataFrame:
    """The parse of rank 0 by word, the least of several."""
    least = lexicon.where("rank = 0").groupBy("word").agg(F.min(F.struct(*columns)).alias("_p"))
    return least.select("word", *(F.col("_p")[c].alias(c) for c in columns))


def seed_heads(seeds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, head, head_gender, head_number): the lemma of a seed's first noun; nulls where it has none."""
    words = seeds.select("seed_id", F.posexplode_outer(X.words("seed")).alias("p", "word"))
    noun = F.when(F.col("pos") == "NOUN", F.struct("p", "lemma", "gender", "number"))
    first = words.join(_first_parse(lexicon, "lemma", "pos", "gender", "number"), "word", "left").groupBy("seed_id").agg(F.min(noun).alias("_n"))
    return first.select("seed_id", F.col("_n.lemma").alias("head"), F.col("_n.gender").alias("head_gender"), F.col("_n.number").alias("head_number"))


def morph_scores(tails: DataFrame, heads: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, tail, morph) of each distinct tail: how well an adjective or a number among its first two words fits the head; 0 without either.

    In the plural genders agree always. A head without gender gives 0.
    """
    distinct = tails.select("seed_id", "tail").distinct()
    words = distinct.select("seed_id", "tail", F.explode_outer(F.slice(X.words("tail"), 1, 2)).alias("word"))
    wide = words.join(_first_parse(lexicon, "pos", "gender", "number"), "word", "left").join(heads, "seed_id", "left")
    number = F.coalesce(F.col("number") == F.col("head_number"), F.lit(False))
    gender = F.coalesce(F.col("gender") == F.col("head_gender"), F.lit(False)) | (number & (F.col("number") == "plur"))
    full = F.when(F.col("pos") == PARTICIPLE, AGREES_PARTICIPLE).otherwise(AGREES)
    agreed = F.when(gender & number, full).when(gender | number, PARTLY).otherwise(NOT_AT_ALL)
    score = (
        F.when(F.col("head_gender").isNull() | (F.length("word") < 2), 0.0).when(F.col("word").rlike(r"^\p{Nd}"), NUMERIC).when(F.col("pos").isin(*ADJECTIVES, PARTICIPLE), agreed).otherwise(0.0)
    )
    return wide.groupBy("seed_id", "tail").agg(F.max(F.coalesce(score, F.lit(0.0))).alias("morph"))


def _bare(c) -> Column:
    return F.regexp_replace(c, r"""^[.,;:!?/\\()\[\]{}"'-]+|[.,;:!?/\\()\[\]{}"'-]+$""", "")


def _tail_words(tails: DataFrame) -> DataFrame:
    words = tails.select("seed_id", "tail").distinct().select("seed_id", "tail", F.explode(X.words("tail")).alias("_w"))
    return words.select("seed_id", "tail", _bare(F.col("_w")).alias("word")).where(F.length("word") >= 2).distinct()


def reference_words(valid: DataFrame, heads: DataFrame) -> DataFrame:
    """(seed_id, word): the words of valid tails that say something; numbers and the head are none."""
    words = _tail_words(valid).select("seed_id", "word").distinct().where(~F.col("word").isin(*STOP_WORDS) & ~X.is_digits("word"))
    return words.join(heads.select("seed_id", F.lower("head").alias("_head")), "seed_id", "left").where(~F.coalesce(F.col("word") == F.col("_head"), F.lit(False))).drop("_head")


def reference_overlap(grey: DataFrame, reference: DataFrame) -> DataFrame:
    """(seed_id, tail, shared): the reference words in each distinct grey tail, sorted."""
    shared = _tail_words(grey).join(reference, ["seed_id", "word"]).groupBy("seed_id", "tail").agg(F.array_sort(F.collect_set("word")).alias("shared"))
    none = F.array().cast("array<string>")
    return grey.select("seed_id", "tail").distinct().join(shared, ["seed_id", "tail"], "left").withColumn("shared", F.coalesce("shared", none))


def _lemma() -> Column:
    """Words in Cyrillic letters have the lexicon's lemma, others are their own."""
    return F.when(F.col("word").rlike("[а-яё]"), F.coalesce("lemma", "word")).otherwise(F.col("word"))


def city_allowed(words: DataFrame, places: DataFrame, target: str, lexicon: DataFrame | None = None) -> DataFrame:
    """words (word) with allowed: whether it is no place or one of the target country. places: (name, country), one row for a name."""
    low = words.withColumn("_low", F.lower("word"))
    if lexicon is not None:
        first = _first_parse(lexicon, "lemma").select(F.col("word").alias("_low"), F.col("lemma").alias("_lemma"))
        low = low.join(first, "_low", "left").withColumn("_low", F.coalesce("_lemma", "_low")).drop("_lemma")
    named = places.select(F.col("name").alias("_low"), F.lower("country").alias("_country"))
    return low.join(named, "_low", "left").withColumn("allowed", F.coalesce(F.col("_country") == target.lower(), F.lit(True))).drop("_low", "_country")


def strip_to_anchor(kw: DataFrame, places: DataFrame, target: str, lexicon: DataFrame) -> DataFrame:
    """(seed_id, keyword, anchor) of each distinct row of (seed_id, seed, keyword): its words without the seed's lemmas and foreign cities.

    The anchor is empty where a city of the target country stands in the keyword or nothing is left. Words of one
    letter always stay. places: (name, country), one row for a name; the lexicon needs word, rank and lemma.
    """

    def words(c):
        return F.regexp_extract_all(F.lower(c), F.lit("([а-яёa-z0-9-]+)"), F.lit(1))

    first = _first_parse(lexicon, "lemma")
    own = kw.select("seed_id", F.explode(words("seed")).alias("word")).where(F.length("word") >= 2).distinct().join(first, "word", "left")
    own = own.select("seed_id", _lemma().alias("_lemma")).distinct().withColumn("_own", F.lit(True))
    flat = kw.select("seed_id", "keyword").distinct().select("seed_id", "keyword", F.posexplode_outer(words("keyword")).alias("p", "word"))
    flat = flat.join(first, "word", "left").withColumn("_lemma", _lemma()).join(own, ["seed_id", "_lemma"], "left")
    for key, country in (("word", "_country"), ("_lemma", "_lemma_country")):
        flat = flat.join(places.select(F.col("name").alias(key), F.lower("country").alias(country)), key, "left")
    local, here = (F.length("word") >= 3) & (F.col("_country") == target.lower()), F.lit(target.lower())
    foreign = F.coalesce(F.col("_country") != here, F.lit(False)) | F.coalesce(F.col("_lemma_country") != here, F.lit(False))
    stays = F.col("word").isNotNull() & ((F.length("word") < 2) | (F.col("_own").isNull() & ~foreign))
    per = flat.groupBy("seed_id", "keyword").agg(F.coalesce(F.bool_or(local), F.lit(False)).alias("_local"), F.array_sort(F.collect_list(F.when(stays, F.struct("p", "word")))).alias("_left"))
    return per.select("seed_id", "keyword", F.when(F.col("_local"), "").otherwise(F.array_join(F.transform("_left", lambda x: x["word"]), " ")).alias("anchor"))


def _triples(c) -> Column:
    """Distinct runs of three characters, blanks as underscores; a shorter text is its own only one, an empty one has none."""
    text = F.replace(X.col(c), F.lit(" "), F.lit("_"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def category_mismatch(pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(seed_id, tail, overlap, mismatch) of each distinct row of (seed_id, seed, tail).

    Few common letter triples are a mismatch, many are none; between them the cosine of seed and tail decides, if both
    have a vector in vectors (text, embedding), one row for a text; without one it is no mismatch. A vector of zeros has
    cosine 0. Null or empty seeds and tails never mismatch.
    """
    rows = pairs.select("seed_id", "tail", X.norm(F.coalesce("seed", F.lit(""))).alias("_s"), X.norm(F.coalesce("tail", F.lit(""))).alias("_t")).distinct()
    rows = rows.withColumn("_a", _triples("_s")).withColumn("_b", _triples("_t"))
    least, common = F.least(F.size("_a"), F.size("_b")), F.size(F.array_intersect("_a", "_b"))
    rows = rows.withColumn("overlap", F.when(least > 0, common / F.greatest(least, F.lit(1)))).drop("_a", "_b")
    between = (F.col("overlap") > FAR) & (F.col("overlap") < NEAR)
    if vectors is None:
        rows = rows.withColumn("_cos", F.lit(None).cast("double"))
    else:
        for text, key, vector in (("_s", "_sk", "_sv"), ("_t", "_tk", "_tv")):
            rows = rows.withColumn(key, F.when(between, F.col(text))).join(vectors.select(F.col("text").alias(key), F.col("embedding").alias(vector)), key, "left")
        rows = rows.withColumn("_cos", F.when((norm("_sv") == 0) | (norm("_tv") == 0), 0.0).otherwise(cosine("_sv", "_tv")))
    mismatch = (F.col("overlap") <= FAR) | (between & (F.col("_cos") < LEAST_COSINE))
    return rows.select("seed_id", "tail", "overlap", F.coalesce(mismatch, F.lit(False)).alias("mismatch"))
