"""Detectors on tails, and the registry that callers may extend.

A detector is a boolean column over a row with the tail's words (_tw), the tail, the seed's words (_sw) and
what dictionaries know of the tail: places, foreign places, brands and retailers. Dictionaries are joined
once per distinct tail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import grammar, places

#: How much each signal weighs; any other weighs 0.5.
POSITIVE_WEIGHTS = {
    "geo": 1.0, "brand": 1.0, "commerce": 0.8, "reputation": 0.8, "location": 0.9, "action": 0.7, "time": 0.8, "type_spec": 0.85,
    "contacts": 0.85, "verb_modifier": 0.85, "conjunctive": 0.8, "prep_modifier": 0.85, "info_intent": 0.9, "premod_adj": 0.75,
    "postmod_adj": 0.75, "product_spec": 0.85, "retailer": 0.85, "model_variant": 0.75,
}
NEGATIVE_WEIGHTS = {
    "fragment": 0.8, "meta": 0.9, "dangling": 0.6, "duplicate": 0.9, "brand_collision": 0.5, "noise_suffix": 0.7, "seed_echo": 0.9,
    "broken_grammar": 0.8, "number_hijack": 0.85, "short_garbage": 0.9, "tech_garbage": 0.95, "mixed_alpha": 0.9, "standalone_num": 0.7,
    "category_mismatch": 0.5, "truncated_geo": 0.85, "truncated_geo_foreign": 0.95, "foreign_geo": 0.95, "orphan_genitive": 0.5,
    "single_infinitive": 0.5, "intent_mismatch": 0.9, "wrong_district": 0.95, "wrong_geo_token": 0.95, "unknown_district": 0.4,
    "retailer_foreign": 0.95,
}
#: Detectors that read a column of seedsift.operators.places or of agreement.category_mismatch; without the column they never fire.
BY_FLAG = {
    "category_mismatch": "mismatch", "truncated_geo": "truncated", "truncated_geo_foreign": "truncated_foreign", "wrong_district": "wrong_district",
    "unknown_district": "unknown_district", "wrong_geo_token": "wrong_city",
}
#: Positive signals beside which a mismatch of categories says nothing.
SURE = (
    "geo", "brand", "location", "contacts", "time", "verb_modifier", "prep_modifier", "conjunctive", "info_intent", "premod_adj", "postmod_adj",
    "commerce", "reputation", "action", "type_spec", "product_spec", "retailer",
)
#: Unfinished words, question words, conjunctions, memory units, and model names that are no brands of their own.
NOISE_WORDS = ("различия", "отличия", "особенности", "преимущества", "недостатки", "разница", "разницы", "означает", "значит", "включает", "содержит", "относится")
QUESTION_WORDS = ("где", "как", "куда", "когда", "какой", "какая", "какое", "сколько")
JOINING_WORDS = ("или", "и", "либо", "чи")
MEMORY_UNITS = ("гб", "тб", "gb", "tb", "мб", "mb")
MODEL_NAMES = ("v8", "v10", "v11", "v12", "v15", "s5", "s6", "s7", "s8", "roomba", "2000", "3000", "4000", "5000")
COMPARING = ("vs", "versus")


def tech_garbage() -> Column:
    """Addresses, links, domains, phone numbers and long numbers."""
    t = F.trim("tail")
    digits = F.regexp_replace(t, r"[\s\-()+]", "")
    return (
        t.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
        | t.rlike(r"https?://|www\.")
        | t.rlike(r"\.[a-z]{2,4}$")
        | (X.is_digits(digits) & (F.length(digits) >= 7))
        | t.rlike(r"^\p{Nd}{5,}$")
    )


def mixed_alpha() -> Column:
    return F.exists(X.words("tail"), lambda w: w.rlike(f"[{X.CYRILLIC}]") & w.rlike(f"[{X.LATIN}]"))


def standalone_num() -> Column:
    """A lone number that is no year from 2000 to 2030; up to three digits only if the seed has no number."""
    t = F.trim("tail")
    year = F.length(t).isin(4) & t.between("2000", "2030")
    seed_number = F.exists("_sw", X.is_digits)
    return X.is_digits(t) & ~year & ((F.length(t) >= 4) | ~seed_number)


def duplicate() -> Column:
    """A repeated word or lemma, unless two question words frame something, or a joining word or number stands between the two."""
    n = "size(_tw)"
    questions = f"filter(sequence(0, {n} - 1), i -> _tw[i] in {QUESTION_WORDS})"
    asks = F.expr(f"size(_tw) > 1 and size({questions}) >= 2 and ({questions})[1] - ({questions})[0] >= 2")

    def apart(source: str, cut: str, skip: str) -> Column:
        """Whether some value stands on both sides of a cut."""
        return F.expr(
            f"""exists(sequence(0, {n} - 1), c -> {cut} and exists(sequence(0, {n} - 1), i -> i < c and not ({skip})
                and array_contains(slice({source}, c + 2, {n}), {source}[i])))"""
        )

    joined = apart("_tw", f"_tw[c] in {JOINING_WORDS}", f"_tw[i] in {JOINING_WORDS}") | apart("_tl", f"_tw[c] in {JOINING_WORDS}", f"_tl[i] in {JOINING_WORDS}")
    model = apart("_tw", r"_tw[c] rlike '^\\p{Nd}+$'", r"_tw[i] rlike '^\\p{Nd}+$'") | apart("_tl", r"_tw[c] rlike '^\\p{Nd}+$'", "false")
    again = (F.size(F.array_distinct("_tw")) < F.size("_tw")) | (F.size(F.array_distinct("_tl")) < F.size("_tl"))
    return F.when(F.size("_tw") < 2, F.lit(False)).otherwise(again & ~asks & ~joined & ~model)


def noise_suffix() -> Column:
    return (F.size("_tw") == 1) & F.get("_tw", F.lit(0)).isin(*NOISE_WORDS)


def seed_echo() -> Column:
    return (F.size("_tw") == 1) & F.array_contains("_sl", F.get("_tl", F.lit(0)))


def product_spec() -> Column:
    """A number with one to three letters, joined or apart; in longer tails only units of memory."""
    letters = "[а-яёіїєґa-z]{1,3}"
    one, two = F.get("_tw", F.lit(0)), F.get("_tw", F.lit(1))
    joined = (F.size("_tw") == 1) & one.rlike(rf"^\p{{Nd}}+{letters}$")
    apart = (F.size("_tw") == 2) & X.is_digits(one) & two.rlike(f"^{letters}$")
    units = "|".join(MEMORY_UNITS)
    memory = (F.size("_tw") > 2) & F.array_join("_tw", " ").rlike(rf"(^| )\p{{Nd}}+ ?({units})( |$)")
    return joined | apart | memory


def model_variant() -> Column:
    w = F.get("_tw", F.lit(0))
    return w.rlike("^[a-z0-9]{2,5}$") & w.rlike("[a-z]") & ~w.isin(*COMPARING)


@dataclass(frozen=True)
class Detector:
    name: str
    positive: bool
    weight: float
    build: Callable[[], Column]
    lexical: bool = False


def _known(name: str, build: Callable[[], Column], lexical: bool = False) -> Detector:
    positive = name in POSITIVE_WEIGHTS
    return Detector(name, positive, (POSITIVE_WEIGHTS if positive else NEGATIVE_WEIGHTS)[name], build, lexical)


REGISTRY: dict[str, Detector] = {
    d.name: d
    for d in (
        _known("geo", lambda: F.col("has_geo")),
        _known("brand", lambda: F.col("n_brands") > 0),
        _known("retailer", lambda: F.col("retailer").isNotNull()),
        _known("type_spec", lambda: F.lit(False)),  # kept for its weight and its place in the order of groups
        _known("product_spec", product_spec),
        _known("model_variant", model_variant),
        _known("duplicate", duplicate),
        _known("brand_collision", lambda: (F.size("_tw") > 1) & (F.col("n_brands_apart") >= 2)),
        _known("noise_suffix", noise_suffix),
        _known("seed_echo", seed_echo),
        _known("tech_garbage", tech_garbage),
        _known("mixed_alpha", mixed_alpha),
        _known("standalone_num", standalone_num),
        _known("foreign_geo", lambda: F.col("has_foreign") & ~F.col("has_geo")),
        _known("retailer_foreign", lambda: F.col("retailer_foreign")),
        *(_known(name, lambda c=c: F.col(c)) for name, c in BY_FLAG.items()),
        *(_known(name, build, lexical=True) for table in (grammar.POSITIVE, grammar.NEGATIVE) for name, build in table.items()),
    )
}


def register_detector(name: str, positive: bool, weight: float, build: Callable[[], Column]) -> None:
    """Adds a detector of the caller's own, or replaces one."""
    REGISTRY[name] = Detector(name, positive, weight, build)


def ngrams(tails: DataFrame) -> DataFrame:
    """The rows of tails with term and n: words, pairs and triples of their tail."""
    terms = F.expr(
        """flatten(transform(sequence(1, 3), n -> if(size(_tw) >= n,
            transform(sequence(0, size(_tw) - n), i -> named_struct('term', array_join(slice(_tw, i + 1, n), ' '), 'n', n)), array())))"""
    )
    return tails.withColumn("_tw", X.words("tail")).withColumn("_g", F.explode_outer(terms)).select(*tails.columns, "_g.term", "_g.n")


def dictionary_hits(tails: DataFrame, gazetteer: DataFrame, brands: DataFrame, target: str, retailers: DataFrame | None = None) -> DataFrame:
    """tails, distinct rows with a column tail, and what dictionaries know of it: places in and outside the target, brands, a retailer."""
    grams = ngrams(tails)
    places = gazetteer.groupBy(F.col("name").alias("term")).agg(F.bool_or(F.upper("country") == target.upper()).alias("_own"))
    names = brands.select(F.col("name").alias("term")).distinct().withColumn("_brand", F.lit(True))
    known = grams.join(places, "term", "left").join(names, "term", "left")
    brand = F.when(F.col("_brand") & (F.col("n") == 1), F.col("term"))
    # The longest place decides; of equally long ones, one in the target wins.
    longest = F.max(F.when(F.col("_own").isNotNull(), F.struct("n", "_own")))["_own"]
    out = known.groupBy(*tails.columns).agg(
        longest.alias("_geo"), F.size(F.collect_set(brand)).alias("n_brands"), F.size(F.collect_set(F.when(~brand.isin(*MODEL_NAMES), brand))).alias("n_brands_apart")
    )
    out = out.withColumn("has_geo", F.coalesce("_geo", F.lit(False))).withColumn("has_foreign", F.coalesce(~F.col("_geo"), F.lit(False))).drop("_geo")
    if retailers is None:
        return out.withColumn("retailer", F.lit(None).cast("string")).withColumn("retailer_foreign", F.lit(False))
    matched = match_retailers(ngrams(tails.select("tail").distinct()), retailers, target)
    return out.join(matched, "tail", "left").fillna(False, ["retailer_foreign"])


def match_retailers(grams: DataFrame, retailers: DataFrame, target: str) -> DataFrame:
    """(tail, retailer, retailer_foreign): pairs first, then words, then words with up to three letters more than a name of four or more.

    The last is an equi-join on the word's prefixes, so nothing is compared with every name.
    """
    names = retailers.select(F.lower("name").alias("name"), "countries")
    exact = grams.where("n <= 2").withColumn("key", F.explode(F.array_distinct(F.array("term", F.replace("term", F.lit(" "), F.lit("-"))))))
    exact = exact.join(names, F.col("key") == F.col("name")).select("tail", F.when(F.col("n") == 2, 0).otherwise(1).alias("rank"), "name", "countries")
    long = grams.where("n = 1 and length(term) >= 5").withColumn("k", F.explode(F.sequence(F.greatest(F.lit(4), F.length("term") - 3), F.length("term"))))
    forms = long.withColumn("key", F.expr("substring(term, 1, k)")).join(names.where("name not rlike '[ -]' and length(name) >= 4"), F.col("key") == F.col("name"))
    forms = forms.select("tail", F.lit(2).alias("rank"), "name", "countries")
    best = exact.unionByName(forms).groupBy("tail").agg(F.min(F.struct("rank", "name", "countries")).alias("b"))
    foreign = ~F.array_contains("b.countries", "*") & ~F.array_contains("b.countries", target.lower())
    return best.select("tail", F.col("b.name").alias("retailer"), foreign.alias("retailer_foreign"))


def signals(hits: DataFrame, lexicon: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """(seed_id, tail, side, positive, negative) of distinct rows (seed_id, seed, tail) with dictionary hits: the detectors that fire, in the registry's order.

    side, if the rows have it, says where the tail stands: pre or post the seed's first word, or infix. The detectors of
    words and grammar are looked at only for tails with a Cyrillic letter, unless a lexicon says what other words are.
    The rows may have the flags of places.place_signals with seed_city, own_geo and after_city, and mismatch; own_geo
    and after_city are part of a row's key then and stay.
    """
    from seedsift.operators.tails import with_lemmas

    keys = ["seed_id", "tail", "side", *(c for c in ("own_geo", "after_city") if c in hits.columns)]
    missing = [c for c in (*BY_FLAG.values(), "own_geo", "after_city") if c not in hits.columns]
    df = hits if "side" in hits.columns else hits.withColumn("side", F.lit("none"))
    df = df.withColumns({c: F.lit(False) for c in missing})
    df = df if "seed_city" in df.columns else df.withColumn("seed_city", F.lit(None).cast("string"))
    df = df.withColumn("_sw", X.words("seed")).withColumn("_tw", X.words("tail")).withColumn("_read", F.lit(lexicon is not None) | F.col("tail").rlike(f"[{X.CYRILLIC}]"))
    df = with_lemmas(with_lemmas(df, "_tw", "_tl", lexicon), "_sw", "_sl", lexicon)
    df = grammar.with_parses(grammar.with_parses(df, "_tw", "_tp", lexicon), "_sw", "_sp", lexicon)
    chosen = [REGISTRY[n] for n in names] if names else list(REGISTRY.values())

    def fires(d: Detector) -> Column:
        found = F.coalesce(d.build(), F.lit(False)) & (F.size("_tw") > 0)
        return F.when(F.col("_read") & found if d.lexical else found, F.lit(d.name))

    for side, positive in (("positive", True), ("negative", False)):
        fired = [fires(d) for d in chosen if d.positive is positive]
        df = df.withColumn(side, X.settled(F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>")))
    once = lambda d: d.withColumns({c: X.settled(F.col(c)) for c in ("positive", "negative")})
    if "own_geo" in keys or "after_city" in keys:
        df = once(places.settle_places(df))
    if "mismatch" in hits.columns:
        df = once(df.withColumn("negative", F.when(_explained(), F.array_remove("negative", "category_mismatch")).otherwise(F.col("negative"))))
    df = once(grammar.settle_conflicts(df)) if names is None else df
    return df.select(*keys, "positive", "negative")


def _explained() -> Column:
    """Whether a sure signal, or a verb without a foreign noun, explains why a tail shares no letters with its seed."""
    verb = "exists(p.all, a -> coalesce(a.pos in ('INFN', 'VERB'), false))"
    acts = f"exists(_tp, p -> {verb}) and not exists(_tp, p -> not {verb} and coalesce(p.pos = 'NOUN', false) and not array_contains(p.marks, 'Geox'))"
    return F.arrays_overlap("positive", F.array(*map(F.lit, SURE))) | F.coalesce(F.expr(acts), F.lit(False))
