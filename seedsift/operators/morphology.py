"""What needs a lexicon: (word, rank, lemma, pos, case, number, gender, score, known). Rank 0 is a word's first parse; unknown words have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X

#: The forms of a noun in the order of variants, parts of speech that are function words, and a parse's least score.
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")
FUNCTION_POS = ("PREP", "CONJ", "PRCL", "INTJ")
LEAST_SCORE, NEAR_TOP = 0.3, 0.9


def top_lemmas(lexicon: DataFrame) -> DataFrame:
    """(word, lemmas): the lemmas of all parses that score nearly as high as the best one."""
    top = lexicon.groupBy("word").agg(F.max("score").alias("_top"))
    near = lexicon.join(top, "word").where(F.col("score") >= NEAR_TOP * F.col("_top"))
    return near.groupBy("word").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))


def word_forms(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, form): all forms of a word's first lemma; participles and gerunds are left out."""
    first = words.join(lexicon.where("rank = 0").select("word", "lemma"), "word").select("word", "lemma")
    forms = lexicon.where("pos not in ('PRTF', 'PRTS', 'GRND')").select("lemma", F.col("word").alias("form")).distinct()
    return first.join(forms, "lemma").select("word", "form").distinct()


def seed_variants_case(seeds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, case, number, variant): the seed with its first noun in each case and number; missing and equal forms are left out."""
    tokens = seeds.select("seed_id", F.posexplode(X.words("seed")).alias("p", "word"))
    nouns = tokens.join(lexicon.where("rank = 0 and pos = 'NOUN'").select("word", "lemma"), "word")
    first = nouns.groupBy("seed_id").agg(F.min(F.struct("p", "word", "lemma")).alias("n")).select("seed_id", "n.*")
    forms = lexicon.where(F.col("case").isin(*CASES) & (F.col("pos") == "NOUN")).groupBy("lemma", "case", "number").agg(F.min(F.struct("rank", "word"))["word"].alias("form"))
    wide = seeds.join(first, "seed_id").join(forms, "lemma").withColumn("_w", X.words("seed"))
    wide = wide.withColumn("variant", F.expr("array_join(transform(_w, (w, i) -> if(i = p, form, w)), ' ')")).where("form <> word")
    order = F.struct(F.array_position(F.array(*(F.lit(c) for c in CASES)), F.col("case")).alias("at"), "case", "number")
    return wide.groupBy("seed_id", "variant").agg(F.min(order).alias("o")).select("seed_id", "o.case", "o.number", "variant")


def normalize_nominative(kw: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, keyword): keywords whose first word is a form of the seed's first word, a noun, with that word in the nominative of its number."""
    parse = lexicon.where((F.col("pos") == "NOUN") & (F.col("score") >= LEAST_SCORE))
    of_seed = parse.where("rank = 0").select(F.col("word").alias("_s"), F.col("lemma").alias("_lemma"))
    df = kw.withColumn("_w", X.words("keyword")).withColumn("_f", F.get("_w", F.lit(0))).withColumn("_s", F.get(X.words("seed"), F.lit(0)))
    first = parse.groupBy(F.col("word").alias("_f"), F.col("lemma").alias("_lemma")).agg(F.min(F.struct("rank", "number"))["number"].alias("number"))
    nominative = lexicon.where("pos = 'NOUN' and case = 'nomn'").groupBy(F.col("lemma").alias("_lemma"), "number").agg(F.min("word").alias("_n"))
    out = df.join(of_seed, "_s").join(first, ["_f", "_lemma"]).join(nominative, ["_lemma", "number"])
    return out.select("seed_id", F.concat_ws(" ", "_n", F.array_join(F.slice("_w", F.lit(2), F.size("_w")), " ")).alias("keyword")).distinct()


def intent_fingerprint(kw: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(seed_id, kw_id, fp): a keyword's lemmas without the seed's and function words, all places as one; __EMPTY__ if nothing is left."""
    first = lexicon.where("rank = 0").select("word", "lemma", "pos")
    lemmas = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[а-яёa-z0-9]+"), 0)
    looked = lambda df: df.join(first, "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))
    seed = looked(kw.select("seed_id", F.explode(lemmas("seed")).alias("word")).distinct()).select("seed_id", "lemma").distinct()
    tokens = looked(kw.select("seed_id", "kw_id", F.explode(lemmas("keyword")).alias("word")))
    kept = tokens.join(seed, ["seed_id", "lemma"], "left_anti")
    places = gazetteer.select(F.lower("name").alias("lemma")).distinct().withColumn("_geo", F.lit(True))
    kept = kept.join(places, "lemma", "left").where(F.col("_geo").isNotNull() | F.col("pos").isNull() | ~F.col("pos").isin(*FUNCTION_POS))
    term = F.when(F.col("_geo"), F.lit("__GEO__")).otherwise(F.col("lemma"))
    found = kept.groupBy("seed_id", "kw_id").agg(F.array_join(F.array_sort(F.collect_set(term)), "|").alias("fp"))
    return kw.select("seed_id", "kw_id").join(found, ["seed_id", "kw_id"], "left").withColumn("fp", F.coalesce("fp", F.lit("__EMPTY__")))
