"""From signals to a label, and from labels to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators.detectors import NEGATIVE_WEIGHTS, POSITIVE_WEIGHTS, REGISTRY

#: Which signals are soft, absolute, backed by a dictionary or hard.
SOFT = ("category_mismatch", "orphan_genitive", "brand_collision", "unknown_district", "standalone_num", "truncated_geo")
ABSOLUTE = ("foreign_geo", "wrong_district", "retailer_foreign", "truncated_geo_foreign", "wrong_geo_token")
BACKED = ("geo", "brand", "verb_modifier", "conjunctive", "prep_modifier", "info_intent", "premod_adj", "postmod_adj")
HARD = ("duplicate", "meta", "tech_garbage", "mixed_alpha", "foreign_geo", "intent_mismatch")
FOR_QUESTIONS = ("meta", "fragment", "dangling", "category_mismatch")
#: The order in which a keyword's first signal names its group, for commercial and for informational seeds.
COMMERCIAL_ORDER = ("geo", "brand", "commerce", "location", "contacts", "reputation", "type_spec", "premod_adj", "postmod_adj", "prep_modifier", "info_intent", "conjunctive", "time", "verb_modifier", "action")
INFO_ORDER = ("info_intent", "prep_modifier", "time", "conjunctive", "location", "geo", "reputation", "commerce", "brand", "type_spec", "premod_adj", "postmod_adj", "contacts", "verb_modifier", "action")
INFO_WORDS = ("как", "что", "почему", "где", "когда", "зачем", "куда", "чем", "сколько", "какой", "какая", "какие", "кто")


def _list(names) -> Column:
    return F.array(*(F.lit(n) for n in names))


def _score(signals: str) -> Column:
    """The summed weights; signals that nobody weighs count 0.5."""
    weights = {**POSITIVE_WEIGHTS, **NEGATIVE_WEIGHTS, **{d.name: d.weight for d in REGISTRY.values()}}
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + F.coalesce(F.element_at(table, s), F.lit(0.5)))


def _any(signals: str, names) -> Column:
    return F.arrays_overlap(signals, _list(names))


def _all(signals: str, names) -> Column:
    return F.size(F.array_except(signals, _list(names))) == 0


def arbitrate(df: DataFrame) -> DataFrame:
    """Adds label, confidence and the two scores to rows with positive and negative signals."""
    df = df.withColumn("positive_score", _score("positive")).withColumn("negative_score", _score("negative"))
    p, n = F.col("positive_score"), F.col("negative_score")
    has_p, has_n = F.size("positive") > 0, F.size("negative") > 0
    both, hard = has_p & has_n, _any("negative", HARD)
    sure = lambda score: F.least(0.85 + score * 0.05, F.lit(0.99))
    rules = [
        (has_p & ~has_n, "VALID", sure(p)),
        (has_n & ~has_p & (_all("negative", SOFT) | (n < 0.6)), "GREY", F.lit(0.4)),
        (has_n & ~has_p, "TRASH", sure(n)),
        (both & _any("negative", ABSOLUTE), "TRASH", F.lit(0.9)),
        (both & F.array_contains("positive", "info_intent") & _all("negative", FOR_QUESTIONS), "VALID", F.lit(0.7)),
        (both & _any("positive", BACKED) & ~hard, "VALID", F.lit(0.75)),
        (both & hard & (p > n * 1.5), "GREY", F.lit(0.3)),
        (both & hard, "TRASH", F.lit(0.65)),
        (both & (p > n * 1.2), "VALID", F.lit(0.6)),
        (both & (n > p * 1.2), "TRASH", F.lit(0.6)),
        (both, "GREY", F.lit(0.3)),
    ]
    out = F.coalesce(*(F.when(c, F.struct(F.lit(label).alias("label"), conf.alias("confidence"))) for c, label, conf in rules), F.struct(F.lit("GREY").alias("label"), F.lit(0.5).alias("confidence")))
    return df.withColumn("_out", out).withColumn("label", F.col("_out.label")).withColumn("confidence", F.col("_out.confidence")).drop("_out")


def group_keywords(kw: DataFrame) -> DataFrame:
    """Adds group: the first of the seed kind's order among the positive signals, exact_seed for the seed itself, else other."""
    info = F.arrays_overlap(X.words("seed"), _list(INFO_WORDS))
    order = F.when(info, _list(INFO_ORDER)).otherwise(_list(COMMERCIAL_ORDER))
    first = F.get(F.filter(order, lambda s: F.array_contains("positive", s)), F.lit(0))
    own = F.when(X.squeeze("keyword") == X.squeeze("seed"), F.lit("exact_seed")).otherwise(F.lit("other"))
    return kw.withColumn("group", F.coalesce(first, own))


def group_summary(grouped: DataFrame) -> DataFrame:
    """Keywords in each seed's groups; rank: exact_seed first, then the order of commercial seeds, other last."""
    rank = F.array_position(_list(("exact_seed", *COMMERCIAL_ORDER, "other")), F.col("group"))
    return grouped.groupBy("seed_id", "group").agg(F.count("*").alias("n_keywords")).withColumn("rank", rank.cast("int"))
