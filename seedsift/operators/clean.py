"""Dedupe and sanitary rules on keywords: (seed_id, seed, pos, keyword, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X


def _first(kw: DataFrame, key: Column, keys: list[str]) -> DataFrame:
    """The first row (by pos, then keyword) of each key. Minima pre-aggregate, so a seed with most of the rows is no hot task."""
    rest = [c for c in kw.columns if c not in keys]
    best = F.min(F.struct("pos", "keyword", *(c for c in rest if c not in ("pos", "keyword")))).alias("_best")
    out = kw.withColumn("_key", X.settled(key)).where("_key <> ''").groupBy(*keys, "_key").agg(best)
    return out.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*kw.columns)


def dedupe_first(kw: DataFrame) -> DataFrame:
    """One row for each keyword in lower case without outer white space; the first wins, empty ones go."""
    return _first(kw, X.norm("keyword"), ["seed_id"])


def dedupe_ws(kw: DataFrame) -> DataFrame:
    """The same with inner white space collapsed."""
    return _first(kw, X.squeeze("keyword"), ["seed_id"])


def dedupe_exact(kw: DataFrame) -> DataFrame:
    """The same on the raw keyword."""
    return _first(kw, F.col("keyword"), ["seed_id"])


def blocked(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before whose keyword is not left after a stage."""
    key = lambda df: df.withColumn("_key", X.norm("keyword"))
    return key(before).join(key(after).select("seed_id", "_key"), ["seed_id", "_key"], "left_anti").select(*before.columns)


#: Letters that stray into a seed, the abbreviation for used goods, and forms of digits with a mark.
NOISE_LETTERS = ("а", "б", "a", "b")
DIGIT_FORMS = (r"^\p{Nd}+[/\-:×хx]\p{Nd}+$", r"^\+\p{Nd}+$", r"^№\p{Nd}+$")


def _at(words: Column, i: Column) -> Column:
    return F.get(words, i)


def _has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{Nd}"), F.lit(False))


def _digit_beside(words: Column, i: Column) -> Column:
    return ((i > 0) & _has_digit(_at(words, i - 1))) | _has_digit(_at(words, i + 1))


def _used_goods(words: Column, w: Column, i: Column) -> Column:
    beside = F.coalesce(_at(words, i + 1) == "у", F.lit(False)) | ((i > 0) & F.coalesce(_at(words, i - 1) == "у", F.lit(False)))
    return (w == "б") & beside


def _seed_word_there(words: Column, s: Column) -> Column:
    """The seed's word, or from four letters on a form of it with up to three letters more."""
    longer = F.exists(words, lambda w: w.startswith(s) & (F.length(w) <= F.length(s) + 3))
    return F.array_contains(words, s) | ((F.length(s) >= 4) & longer)


def pre_columns(kw: DataFrame) -> DataFrame:
    """Adds what the rules look at: _q, _s, their words, and the tail's words if the seed stands at a word's end."""
    df = kw.withColumn("_q", X.squeeze("keyword")).withColumn("_s", X.squeeze("seed"))
    df = df.withColumn("_qw", X.words("_q")).withColumn("_sw", X.words("_s"))
    apart = F.rlike(F.col("_q"), F.concat(F.lit("\\Q"), F.col("_s"), F.lit("\\E(?![\\p{L}\\p{Nd}])")))
    df = df.withColumn("_at", F.expr("locate(_s, _q)"))
    tail = F.trim(F.concat_ws(" ", F.trim(F.expr("substring(_q, 1, _at - 1)")), F.trim(F.expr("substring(_q, _at + length(_s))"))))
    return df.withColumn("_tail", F.when((F.col("_at") > 0) & apart, tail)).withColumn("_tw", X.words("_tail"))


def pre_rules() -> list[tuple[str, Column]]:
    """The rules in their order; the first that fires names the reason."""
    q, s, qw, sw, tail, tw = (F.col(c) for c in ("_q", "_s", "_qw", "_sw", "_tail", "_tw"))
    stray = F.exists(
        F.transform(qw, lambda w, i: w.isin(*NOISE_LETTERS) & ~_used_goods(qw, w, i) & ~_digit_beside(qw, i)), lambda x: x
    )
    some = F.size(tw) > 0
    repeat = F.exists(F.transform(tw, lambda w, i: (i > 0) & (w == _at(tw, i - 1))), lambda x: x)
    near_digit = F.exists(F.transform(qw, lambda w, i: (w == tail) & _digit_beside(qw, i)), lambda x: x)
    form = lambda t: reduce(lambda a, b: a | b, (t.rlike(p) for p in DIGIT_FORMS))
    mark = F.exists(tw, lambda t: ~t.rlike("[а-яёіїєґa-z]") & t.rlike("[^а-яёіїєґa-z0-9]") & ~form(t))
    return [
        ("language", (X.latin_share("keyword") > 0.8) & (X.cyrillic_share("seed") > 0.8)),
        ("dup_seed", X.occurrences(q, s) >= 2),
        ("noise_letter", stray & F.forall(sw, lambda x: _seed_word_there(qw, x))),
        ("echo", some & (F.size(tw) == 1) & F.array_contains(sw, F.get(tw, F.lit(0)))),
        ("all_seed", some & F.forall(tw, lambda w: F.array_contains(sw, w))),
        ("repeat", some & repeat),
        ("single_char", some & (F.length(tail) == 1) & ~X.is_digits(tail) & ~near_digit),
        ("symbol", some & mark),
    ]


def pre_filter(kw: DataFrame) -> DataFrame:
    """Adds reason: the first sanitary rule that rejects the keyword, else null. Null keywords and seeds count as empty."""
    clean = kw.fillna("", ["keyword", "seed"])
    reason = F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in pre_rules()))
    return pre_columns(clean).withColumn("reason", X.settled(reason)).select(*kw.columns, "reason")


def relevant(kw: DataFrame) -> DataFrame:
    """Keywords that contain the root (four letters at most, at least one less than the word) of a seed word of over three lower-case letters."""
    found = F.filter(F.regexp_extract_all("seed", F.lit("[а-яёa-z]+"), 0), lambda w: F.length(w) > 3)
    roots = F.transform(found, lambda w: F.substring(w, F.lit(1), F.least(F.lit(4), F.length(w) - 1)))
    df = kw.withColumn("_roots", roots).withColumn("_low", F.lower("keyword"))
    return df.where(F.exists("_roots", lambda r: F.col("_low").contains(r))).select(*kw.columns)


#: Single letters that are words, by language.
SINGLE_WORDS = {"ru": "вукосиа", "uk": "вузі", "en": "oai"}


def infix_clean(kw: DataFrame, language: str = "ru") -> DataFrame:
    """Keywords without a single character after their first word, other than the language's one-letter words."""
    allowed = list(SINGLE_WORDS.get(language, "")) or [""]
    flags = F.transform(X.words("keyword"), lambda w, i: (i > 0) & (F.length(w) == 1) & ~w.isin(*allowed))
    return kw.where(~F.exists(flags, lambda x: x))
