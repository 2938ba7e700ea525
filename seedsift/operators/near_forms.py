"""Words that are nearly the same, keywords with the seed's own spelling, and phrases in their base forms.

Two words are alike by their matching blocks: the longest run that both have, the first in both, then the same on either side of it;
twice the letters in blocks by the letters of both. Distinct pairs are compared once, and only those that lengths and common
letters leave possible. Words are taken to be shorter than 200 letters.

Null keywords have no words. The lexicon is that of seedsift.operators.grammar; words that it lacks stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X

#: Least likenesses of the same word, of a form of the seed's word and of a typing error, and letters of a common opening.
SAME, FORM, ERROR, OPENING = 0.8, 0.7, 0.97, 5
#: Names of languages, and the one of unknown codes by script.
ALIASES = {"russian": "ru", "ukrainian": "uk", "english": "en"}
STEMMED = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "no", "da", "fi", "ro", "ru")
ADJECTIVES = ("ADJF", "ADJS", "PRTF", "PRTS")


def matched_letters(a: str, b: str) -> int:
    """Letters in matching blocks."""
    best = size = end = 0
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = before[j - 1] + 1
                if row[j] > size:
                    size, best, end = row[j], i, j
        before = row
    if not size:
        return 0
    return matched_letters(a[: best - size], b[: end - size]) + size + matched_letters(a[best:], b[end:])


def _bound(a: str, b: str) -> Column:
    """What the letters that both have allow at most."""
    count = lambda w: f"(length({w}) - length(replace({w}, c, '')))"
    common = F.expr(f"aggregate(array_distinct(split({a}, '')), 0, (n, c) -> n + if(c = '', 0, cast(least({count(a)}, {count(b)}) as int)))")
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * common / F.greatest(F.length(a) + F.length(b), F.lit(1)))


def alike(pairs: DataFrame, least: float = SAME) -> DataFrame:
    """(a, b, ratio) of the distinct pairs (a, b) whose ratio is at least so high; null words are left out."""
    likely = pairs.select("a", "b").distinct().where("a is not null and b is not null").where(_bound("a", "b") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_pylist() for i in (0, 1))
            ratio = [2 * matched_letters(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=["a", "b", "ratio"])

    return likely.mapInArrow(run, "a string, b string, ratio double").where(F.col("ratio") >= least)


def nearly_same(pairs: DataFrame) -> DataFrame:
    """Adds same to rows (a, b): whether two words are nearly the same, in lower case."""
    own = pairs.withColumn("_a", F.lower("a")).withColumn("_b", F.lower("b"))
    found = alike(own.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).where(F.col("ratio") > SAME).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("same"))
    return own.join(found, ["_a", "_b"], "left").select(*pairs.columns, F.coalesce("same", F.lit(False)).alias("same"))


def _replaced(words: str, into: str) -> Column:
    return F.expr(f"transform({words}, w -> coalesce({into}[lower(w)], w))")


def align_to_seed(kw: DataFrame) -> DataFrame:
    """Adds aligned to rows (seed_id, seed, keyword): each word that is a form of a word of the seed, by the same opening or by likeness, is spelled
    as there; of several words of the seed the last one counts. Keywords without words stay as they are."""
    df = kw.withColumn("_kw", F.filter(F.split("keyword", r"(?U)\s+"), lambda w: w != "")).withColumn("_sw", X.words("seed"))
    words = df.select("_sw", F.explode("_kw").alias("w")).select("_sw", F.lower("w").alias("k")).distinct()
    each = words.select("_sw", "k", F.posexplode("_sw").alias("at", "s"))
    opening = (F.length("k") >= OPENING) & (F.length("s") >= OPENING) & (F.substring("k", 1, OPENING) == F.substring("s", 1, OPENING))
    near = alike(each.where(~opening & (F.col("k") != F.col("s"))).select(F.col("k").alias("a"), F.col("s").alias("b")), FORM).select(F.col("a").alias("k"), F.col("b").alias("s"), F.lit(True).alias("_near"))
    hits = each.join(near, ["k", "s"], "left").where((F.col("k") == F.col("s")) | opening | F.coalesce("_near", F.lit(False)))
    last = hits.groupBy("_sw", "k").agg(F.max(F.struct("at", "s"))["s"].alias("s"))
    into = last.groupBy("_sw").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("_into"))
    df = df.join(into, "_sw", "left").withColumn("_into", F.coalesce("_into", F.expr("cast(map() as map<string, string>)")))
    aligned = F.array_join(_replaced("_kw", "_into"), " ")
    return df.withColumn("aligned", F.when(F.size("_kw") > 0, aligned).otherwise(F.col("keyword"))).select(*kw.columns, "aligned")


def languages(kw: DataFrame) -> DataFrame:
    """(seed_id, language) of rows (seed_id, seed, keyword, language): a known code counts; auto and codes that nobody knows follow the letters of all texts of a seed."""
    text = F.concat_ws(" ", "seed", "keyword")
    per = kw.groupBy("seed_id").agg(F.bool_or(text.rlike("[іїєґІЇЄҐ]")).alias("_uk"), F.bool_or(text.rlike("[а-яА-ЯёЁіїєґІЇЄҐ]")).alias("_cyr"), F.min("language").alias("_given"))
    code = F.lower(F.trim("_given"))
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    short = F.coalesce(F.element_at(names, code), F.substring_index(F.substring_index(code, "-", 1), "_", 1))
    script = F.when(F.col("_uk"), "uk").when(F.col("_cyr"), "ru").otherwise("en")
    return per.select("seed_id", F.when(short.isin("uk", *STEMMED), short).otherwise(script).alias("language"))


def _model(w: str) -> str:
    """SQL: whether a word looks like a brand or model."""
    latin, cyrillic = f"{w} rlike '(?i)[a-z]'", f"{w} rlike '[а-яА-ЯёЁіїєґІЇЄҐ]'"
    return f"({w} rlike '\\\\p{{Nd}}' or ({latin} and {cyrillic}) or ({w} like '%-%' and {latin}))"


def base_forms(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, form) of distinct words: nouns in the nominative of their number, adjectives in that of their number and gender, others by their lemma."""
    first = lexicon.where("rank = 0").groupBy("word").agg(F.min(F.struct("lemma", "pos", "number", "gender")).alias("_p")).select("word", "_p.*")
    df = words.select("word").distinct().join(first, "word")
    family = F.when(F.col("pos").isin(*ADJECTIVES), "ADJ").otherwise(F.col("pos"))
    nominative = lexicon.where("case = 'nomn'").select("lemma", family.alias("_family"), "number", F.col("gender").alias("_gender"), "rank", F.col("word").alias("_form")).where("_family in ('NOUN', 'ADJ')")
    wide = df.withColumn("_family", family).join(nominative, ["lemma", "_family", "number"])
    best = F.min(F.struct((~F.coalesce(F.col("_gender") == F.col("gender"), F.lit(False))).alias("other"), "rank", "_form"))["_form"]
    forms = wide.groupBy("word").agg(best.alias("_form"))
    return df.join(forms, "word", "left").select("word", F.coalesce("_form", "lemma").alias("form"))


def normalize_phrases(kw: DataFrame, lexicon: DataFrame, stems: DataFrame) -> DataFrame:
    """Adds normalized to rows (seed_id, seed, keyword, language): Russian and Ukrainian words in their base forms, words of other languages by their stem and, where
    that is a seed's word but for a typing error, by the first such word. Brands and models stay. stems: (word, language, stem)."""
    lower = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\w-]+)"), F.lit(1))
    own = kw.drop("language").join(languages(kw), "seed_id", "left")
    df = own.withColumn("_kw", F.coalesce(lower("keyword"), F.array().cast("array<string>"))).withColumn("_sw", lower("seed"))
    words = df.select("language", "_sw", F.explode("_kw").alias("word")).distinct().where(~F.expr(_model("word")))
    cyrillic = F.col("language").isin("ru", "uk")
    formed = words.where(cyrillic).join(base_forms(words.where(cyrillic).select("word"), lexicon), "word").select("language", "_sw", "word", "form")
    stemmed = words.where(~cyrillic).join(stems.groupBy("word", "language").agg(F.min("stem").alias("form")), ["word", "language"], "left").withColumn("form", F.coalesce("form", "word"))
    stemmed = stemmed.select("language", "_sw", "word", "form")
    models = df.where(~cyrillic).select("language", "_sw", F.explode("_kw").alias("word")).distinct().where(F.expr(_model("word"))).withColumn("form", F.col("word"))
    tried = stemmed.unionByName(models).select("language", "_sw", "word", "form", F.posexplode("_sw").alias("at", "s"))
    near = alike(tried.select(F.col("form").alias("a"), F.col("s").alias("b")), ERROR).select(F.col("a").alias("form"), F.col("b").alias("s"))
    spelled = tried.join(near, ["form", "s"]).groupBy("language", "_sw", "word").agg(F.min(F.struct("at", "s"))["s"].alias("_own"))
    others = stemmed.unionByName(models).join(spelled, ["language", "_sw", "word"], "left").select("language", "_sw", "word", F.coalesce("_own", "form").alias("form"))
    into = formed.unionByName(others).groupBy("language", "_sw").agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("_into"))
    df = df.join(into, ["language", "_sw"], "left").withColumn("_into", F.coalesce("_into", F.expr("cast(map() as map<string, string>)")))
    return df.withColumn("normalized", F.array_join(_replaced("_kw", "_into"), " ")).select(*kw.columns, "normalized")
