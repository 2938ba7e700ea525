"""How much of its seed a keyword shows: what decides where the seed was not found, a second look without the seed's last
word, and valid keywords that lack what the seed cannot do without.

A seed's words are numbers, a line of Latin words (brand or product line), models (digits, or letters and digits), and words with content.
Seeds with a model belong to class A, those with a Latin line only to class B; others ask for neither.

Keywords are judged by expressions over their own few words; brands and lemmas join on distinct words. The lexicon is that
of seedsift.operators.morphology; without a score each word has its first lemma only. Unknown words are their own lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import grammar, tails

#: Ukrainian letters and words, letters in Latin as models spell them, and parts of speech with content.
UKRAINIAN_LETTERS = "іїєґІЇЄҐ"
UKRAINIAN_WORDS = ("купити", "замовити", "заказати", "огляд", "розстрочку", "ринок", "ціни", "вартість", "пошта")
MODEL_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "z", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "c", "ш": "s", "щ": "s",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "u", "я": "a",
}
CONTENT = ("NOUN", "VERB", "ADJF", "ADJS", "INFN", "PRTF", "PRTS")

_LETTERS = {k: v for k, v in MODEL_LETTERS.items() if v}
_DROPPED = "".join(k for k, v in MODEL_LETTERS.items() if not v)
_MODEL = "^(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]+$"
_CYRILLIC = "[Ѐ-ӿ]"


def in_latin(c: str) -> str:
    """SQL for a word with its Cyrillic letters in Latin ones."""
    return f"translate({c}, '{''.join(_LETTERS)}{_DROPPED}', '{''.join(_LETTERS.values())}')"


def model_match(word: str, model: str) -> str:
    """SQL: whether a word is a model, or opens with it and goes on with no digit."""
    a, b = in_latin(word), in_latin(model)
    return f"({a} = {b} or (length({a}) > length({b}) and startswith({a}, {b}) and not substring({a}, length({b}) + 1, 1) rlike '^\\\\p{{Nd}}'))"


def _names(words: tuple[str, ...]) -> str:
    return ", ".join(map(repr, words))


def with_brands(df: DataFrame, columns: dict[str, str], brands: DataFrame) -> DataFrame:
    """Adds, by column of parses, which of its words is a brand by itself or its lemma."""
    names = brands.select(F.lower("name").alias("word")).distinct()
    for source, target in columns.items():
        words = df.select(F.explode(source).alias("p")).select(F.explode(F.array("p.word", "p.lemma")).alias("word"), F.col("p.word").alias("of")).distinct()
        known = words.join(names, "word").select("of").distinct()
        each = df.select(F.transform(source, lambda p: p["word"]).alias("_k")).distinct().select("_k", F.explode("_k").alias("of")).join(known, "of")
        df = df.withColumn("_k", F.transform(source, lambda p: p["word"])).join(each.groupBy("_k").agg(F.collect_set("of").alias(target)), "_k", "left").drop("_k")
        df = df.withColumn(target, F.coalesce(target, F.array().cast("array<string>")))
    return df


def seed_profiles(seeds: DataFrame, lexicon: DataFrame | None, brands: DataFrame) -> DataFrame:
    """(seed_id, numbers, line, models, seed_class, n_words, content, latin_brands, latin_models, short_seed) of rows (seed_id, seed).

    content holds the lemmas of each word with content; Latin words that the lexicon has no part of speech for are brands or models.
    short_seed is the seed without its last word where that one may be missing: a noun in the nominative or accusative behind a noun, in
    a seed of three words or more.
    """
    df = seeds.select("seed_id", F.lower("seed").alias("_s"), X.words("seed").alias("_sw"))
    df = grammar.with_parses(df, "_sw", "_sp", lexicon)
    df = df.withColumn("_ss", F.transform("_sw", lambda w: F.array(w))) if lexicon is None else tails.with_lemma_sets(df, "_sw", "_ss", lexicon)
    df = with_brands(df, {"_sp": "_known"}, brands)
    number = r"(p.word rlike '^\\p{Nd}+$' or coalesce(p.pos = 'NUMB', false))"
    bare = f"filter(_sp, p -> not {number} and p.pos is null and p.word rlike '[a-z]')"
    last, before = "get(_sp, size(_sp) - 1)", "get(_sp, size(_sp) - 2)"
    ends = f"size(_sp) >= 3 and coalesce({last}.pos = 'NOUN' and {before}.pos = 'NOUN' and {last}.case in ('nomn', 'accs'), false)"
    rows = {
        "numbers": r"regexp_extract_all(_s, '(?U)\\b\\d+\\b', 0)", "line": "array_distinct(filter(_sw, w -> w rlike '^[a-z]+$'))",
        "models": f"array_distinct(filter(_sw, w -> w rlike '^[0-9]+$' or w rlike '{_MODEL}'))", "n_words": "size(_sw)",
        "content": f"filter(transform(_sp, (p, i) -> if(not {number} and p.pos in ({_names(CONTENT)}), _ss[i], null)), s -> s is not null)",
        "latin_brands": f"array_distinct(transform(filter({bare}, p -> array_contains(_known, p.word)), p -> p.word))",
        "latin_models": f"array_distinct(transform(filter({bare}, p -> not array_contains(_known, p.word)), p -> p.word))",
        "short_seed": f"if({ends}, array_join(slice(_sw, 1, size(_sw) - 1), ' '), null)",
    }
    out = df.select("seed_id", *(F.expr(e).alias(n) for n, e in rows.items()))
    return out.withColumn("seed_class", F.when(F.size("models") > 0, "A").when(F.size("line") > 0, "B").otherwise("none"))


def no_seed_rules(kw: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds no_seed_reason to rows (seed_id, keyword, tail): why a keyword is TRASH before any detector; null where nothing speaks against it.

    wrong_language: a Ukrainian letter, or, where the seed was not found (the tail is null), a Ukrainian word. Only without the seed:
    wrong_number: numbers, but none of the seed's; wrong_model: a class A seed's model is missing; wrong_brand: all of a class B seed's line is.
    """
    df = kw.withColumn("_k", F.lower("keyword")).withColumn("_kw", X.words("keyword")).join(profiles, "seed_id", "left")
    numbers = r"regexp_extract_all(_k, '(?U)\\b\\d+\\b', 0)"
    ukrainian = f"array_min(array_intersect(_kw, array({_names(UKRAINIAN_WORDS)})))"
    line = f"exists(line, b -> array_contains(_kw, b) or exists(_kw, w -> {tails.cross_script('b', 'w')}))"
    model = f"exists(_kw, w -> exists(models, m -> {model_match('w', 'm')}))"
    reason = f"""case when keyword rlike '[{UKRAINIAN_LETTERS}]' then 'wrong_language:letter' when tail is not null then null
        when {ukrainian} is not null then concat('wrong_language:', {ukrainian})
        when size(numbers) > 0 and size({numbers}) > 0 and not arrays_overlap({numbers}, numbers) then concat('wrong_number:', array_join(array_sort(array_distinct({numbers})), ','))
        when seed_class = 'B' and not {line} then 'wrong_brand' when seed_class = 'A' and not {model} then 'wrong_model' end"""
    return df.withColumn("no_seed_reason", X.settled(F.expr(reason))).select(*kw.columns, "no_seed_reason")


def short_seed_tails(kw: DataFrame, profiles: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """kw (seed_id, keyword, tail) with the tail beside the short seed where the whole one was not found; all lemmas of the short seed have to
    stand in the keyword, by their first lemma."""
    own, short = kw.columns, profiles.where("short_seed is not null").select("seed_id", F.col("short_seed").alias("_short"))
    df = kw.join(short, "seed_id", "left")
    open_ = df.where("tail is null and _short is not null").select("seed_id", "keyword", F.col("_short").alias("seed")).distinct()
    again = tails.extract_tail(open_, lexicon).withColumn("_q", X.words("keyword")).withColumn("_s", X.words("seed"))
    again = tails.with_lemmas(tails.with_lemmas(again, "_q", "_ql", lexicon), "_s", "_sl", lexicon)
    found = again.where((F.size(F.array_except("_sl", "_ql")) == 0) & F.col("tail").isNotNull()).select("seed_id", "keyword", F.col("tail").alias("_again"))
    return df.join(found, ["seed_id", "keyword"], "left").withColumn("tail", F.coalesce("tail", "_again")).select(*own)


def sanity_demotions(valid: DataFrame, profiles: DataFrame, lexicon: DataFrame | None, brands: DataFrame) -> DataFrame:
    """Adds demoted_reason to rows (seed_id, keyword): what of the seed is missing; null where nothing is.

    missing_model: each Latin model has to stand there, in Latin or Cyrillic letters. missing_brand: one of the Latin brands, or any brand in
    Cyrillic letters. Then words with content, by the word or a lemma: all of them in seeds with Latin words (missing_intent) and in
    seeds of one or two words; longer ones may miss one (missing_content). Of a word's lemmas the least is named.
    """
    df = valid.withColumn("_kw", X.words("keyword")).join(profiles, "seed_id", "left")
    df = grammar.with_parses(df, "_kw", "_kp", lexicon)
    df = df.withColumn("_ks", F.transform("_kw", lambda w: F.array(w))) if lexicon is None else tails.with_lemma_sets(df, "_kw", "_ks", lexicon)
    df = with_brands(df, {"_kp": "_brands"}, brands)
    shown = "array_union(_kw, transform(_kp, p -> p.lemma))"
    df = df.withColumn("_shown", X.settled(F.expr(shown)))
    df = df.withColumn("_missing", X.settled(F.expr("transform(filter(content, s -> not arrays_overlap(s, _kw) and not exists(_ks, k -> arrays_overlap(s, k))), s -> array_min(s))")))
    spelled = f"exists(_kw, w -> w rlike '{_CYRILLIC}' and {in_latin('w')} = m)"
    lost = f"get(array_sort(filter(latin_models, m -> not array_contains(_shown, m) and not {spelled})), 0)"
    brandless = f"size(latin_brands) > 0 and not arrays_overlap(latin_brands, _shown) and not exists(_brands, b -> b rlike '{_CYRILLIC}')"
    latin = "size(latin_brands) + size(latin_models) > 0"
    reason = f"""case when {lost} is not null then concat('missing_model:', {lost}) when {brandless} then 'missing_brand'
        when {latin} and size(_missing) > 0 then concat('missing_intent:', _missing[0])
        when not {latin} and size(_missing) > if(n_words <= 2, 0, 1) then concat('missing_content:', array_join(slice(_missing, 1, 3), ',')) end"""
    return df.withColumn("demoted_reason", X.settled(F.expr(reason))).select(*valid.columns, "demoted_reason")
