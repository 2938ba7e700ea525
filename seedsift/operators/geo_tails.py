"""Tails of keywords that name a place: users leave out part of a seed when they add one, so the place is found first and
the tail is what is left beside the seed's words.

A keyword's places follow from the text alone, so each distinct text is looked up once: its words, pairs and triples, in
the forms that a name may have, meet one table of places by an equi-join, and the least of what they say in order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import grammar, tails
from seedsift.operators.places import FUNCTION, LEAST_LEMMA

#: Kinds of what a dictionary says of a term; the sides are home and abroad.
CITY, COUNTRY, DISTRICT = "city", "country", "district"


def place_kinds(geo: DataFrame, countries: DataFrame | None, districts: DataFrame | None, target: str) -> DataFrame:
    """(term, city, country, district): for each whether it is one of the target (true), only of others (false), or none (null).

    geo: (name, countries array<string>); countries: (name, country); districts: (name, city, country), whose country may be empty.
    """
    low = target.lower()
    rows = geo.select(F.lower("name").alias("term"), F.lit(CITY).alias("kind"), F.array_contains("countries", low).alias("home"))
    if countries is not None:
        rows = rows.unionByName(countries.select(F.lower("name").alias("term"), F.lit(COUNTRY).alias("kind"), (F.lower("country") == low).alias("home")))
    if districts is not None:
        known = districts.where("country <> ''")
        rows = rows.unionByName(known.select(F.lower("name").alias("term"), F.lit(DISTRICT).alias("kind"), (F.lower("country") == low).alias("home")))
    return rows.groupBy("term").agg(*(F.bool_or(F.when(F.col("kind") == k, F.col("home"))).alias(k) for k in (CITY, COUNTRY, DISTRICT)))


def _grams(texts: DataFrame) -> DataFrame:
    """(text, n, p, raw, term) of the words, pairs and triples of texts with their lemmas (_w, _l): as they stand, with the lemma of the
    first word, for pairs also with both lemmas; with blanks and hyphens exchanged."""
    gram = """flatten(transform(sequence(1, 3), n -> if(size(_w) >= n, transform(sequence(0, size(_w) - n), p -> named_struct('n', n, 'p', p,
        'raw', array_join(slice(_w, p + 1, n), ' '), 'head', array_join(concat(array(_l[p]), slice(_w, p + 2, n - 1)), ' '), 'full', array_join(slice(_l, p + 1, n), ' '))), array())))"""
    rows = texts.select("text", F.explode(F.expr(gram)).alias("g")).select("text", "g.*")
    forms = F.array("raw", "head", F.when(F.col("n") == 2, F.col("full")))
    forms = F.array_distinct(F.array_compact(F.flatten(F.transform(forms, lambda f: F.array(f, F.replace(f, F.lit(" "), F.lit("-")), F.replace(f, F.lit("-"), F.lit(" ")))))))
    longer = rows.where("n > 1").select("text", "n", "p", F.col("raw").alias("word"), F.explode(forms).alias("term"))
    # A single word is looked up as it stands, and by its lemma if both are long enough and differ.
    single = rows.where("n = 1").select("text", "n", "p", F.col("raw").alias("word"), F.explode(F.when((F.length("raw") >= LEAST_LEMMA) & (F.col("raw") != F.col("full")), F.array("raw", "full")).otherwise(F.array("raw"))).alias("term"))
    return longer.unionByName(single)


def place_cover(texts: DataFrame, kinds: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(text, at, n): the words of each distinct text of (text) that name a place of the target; texts without one, or where a longer name lies
    elsewhere, are absent.

    Triples are looked at first, then pairs, then words, each from the left. A triple or pair that names a city or country decides: for the
    target, or against the whole text; so does a pair that is a district abroad. Words that name something elsewhere are passed over.
    """
    words = texts.select("text").distinct().withColumn("_w", X.words("text"))
    words = tails.with_lemmas(words, "_w", "_l", lexicon)
    hits = _grams(words).join(kinds, "term")
    raw = F.col("term") == F.col("word")
    flag = lambda k, own: F.bool_or(F.when(raw if own else ~raw, F.col(k)))
    by_place = hits.groupBy("text", "n", "p").agg(
        *(F.bool_or(k).alias(k) for k in (CITY, COUNTRY)), *(flag(k, own).alias(f"_{k}{int(own)}") for k in (CITY, COUNTRY, DISTRICT) for own in (True, False)), F.min("word").alias("word"),
        F.bool_or(F.coalesce(~F.col(DISTRICT), F.lit(False))).alias("_away"),
    )
    if lexicon is None:
        by_place = by_place.withColumn("_pos", F.lit(None).cast("string"))
    else:
        first = lexicon.where("rank = 0").groupBy("word").agg(F.min("pos").alias("_pos"))
        by_place = by_place.join(first, "word", "left")
    district_raw, district_lemma = F.coalesce(~F.col("_district1"), F.lit(False)), F.coalesce(~F.col("_district0"), F.lit(False))
    passed = F.coalesce(F.col("_pos").isin(*FUNCTION), F.lit(False)) | district_raw | (~F.coalesce("_city1", F.lit(False)) & district_lemma)
    single = F.coalesce("_city1", "_city0", "_country1", "_country0")
    longer = F.when((F.col("n") == 2) & F.col("_away"), False).otherwise(F.coalesce(CITY, COUNTRY))
    triple = F.col(CITY)
    verdict = F.when(F.col("n") == 1, F.when(~passed & single, True)).when(F.col("n") == 2, longer).otherwise(triple)
    first = by_place.withColumn("_home", verdict).where("_home is not null").groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "_home")).alias("_b"))
    return first.where("_b._home").select("text", F.col("_b.p").alias("at"), (-F.col("_b.n")).alias("n"))


def geo_first_tail(kw: DataFrame, kinds: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds geo_tail to rows with (keyword, seed): the words beside the seed's, the place among them; null where this step does not apply.

    It applies to seeds without Latin letters and numbers, to keywords with a place of the target and, outside the place, a word of the
    seed with content, by word or lemma.
    """
    df = kw.withColumn("_q", X.squeeze("keyword")).withColumn("_qw", X.words("keyword")).withColumn("_sw", X.words("seed"))
    plain = ~F.exists("_sw", lambda w: w.rlike(r"[a-z]|^\p{Nd}+$")) & (F.size("_sw") > 0)
    cover = place_cover(df.where(plain).select(F.col("_q").alias("text")), kinds, lexicon)
    df = df.join(cover.withColumnsRenamed({"text": "_q", "at": "_at", "n": "_n"}), "_q", "left")
    if lexicon is None:
        df = df.withColumns({"_qs": F.transform("_qw", lambda w: F.array(w)), "_ss": F.transform("_sw", lambda w: F.array(w))})
    else:
        df = tails.with_lemma_sets(tails.with_lemma_sets(df, "_qw", "_qs", lexicon), "_sw", "_ss", lexicon)
    df = grammar.with_parses(df, "_sw", "_sp", lexicon)
    names = ", ".join(map(repr, FUNCTION))
    content = f"not coalesce(_sp[s].pos in ({names}), false) and not coalesce(_sp[s].pos = 'NUMB', false)"
    shown = f"exists(sequence(0, size(_sw) - 1), s -> {content} and exists(sequence(0, size(_qw) - 1), q -> not (q between _at and _at + _n - 1) and (_qw[q] = _sw[s] or arrays_overlap(_qs[q], _ss[s]))))"
    df = df.withColumn("_taken", X.settled(F.expr(f"if(_at is not null and size(_qw) > 0, {tails.matched('_qw', '_sw', '_qs', '_ss')}, null)")))
    outside = "exists(sequence(_at, _at + _n - 1), q -> not array_contains(_taken, q))"
    left = tails.left_over("_qw", "_taken")
    tail: Column = F.when(plain & F.col("_at").isNotNull(), F.expr(f"if({shown} and {outside}, nullif({left}, ''), null)"))
    return df.withColumn("geo_tail", X.settled(tail)).select(*kw.columns, "geo_tail")
