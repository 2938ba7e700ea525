"""The cascade: dedupe, sanitary rules, places, tails, detectors, arbitration, anchors of meaning,
statistics of grey tails, verdicts, groups; one plan for all seeds.

The stages geo, anchor and l2 read their input several times, so it is written to the shared folder once before each.

Every deduped keyword comes out once, with the stage that decided it, so VALID, GREY and TRASH add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.operators import agreement, anchors, arbitration, clean, detectors, geo, geo_tails, places as seed_places, seed_match, statistics, tails
from seedsift.sources.shared import written

STAGES = ("pre", "l0")
#: All stages in their order.
ALL_STAGES = ("pre", "geo", "l0", "anchor", "l2", "verdict")


def places_of(gazetteer: DataFrame) -> DataFrame:
    """(name, countries) in lower case, from (name, country)."""
    return gazetteer.groupBy(F.lower("name").alias("name")).agg(F.collect_set(F.lower("country")).alias("countries"))


def _block_places(df: DataFrame, places: DataFrame, districts: DataFrame | None, target: str, lexicon: DataFrame | None) -> DataFrame:
    """Gives keywords that have no reason yet the reason of the first geography rule. After dedupe a keyword is a seed's own key."""
    rest = df.where("reason is null").select("seed_id", F.col("keyword").alias("kw_id"), "keyword")
    found = geo.geo_rules(rest, df.select("seed_id", "seed").distinct(), places, districts, target, lexicon=lexicon)
    found = found.select("seed_id", F.col("kw_id").alias("keyword"), F.col("reason").alias("_geo"))
    df = df.join(found, ["seed_id", "keyword"], "left")
    return df.withColumn("stage", F.when(F.col("reason").isNull() & F.col("_geo").isNotNull(), "geo")).withColumn("reason", F.coalesce("reason", "_geo")).drop("_geo")


def _prove_anchors(df: DataFrame, lexicon: DataFrame, thesaurus: dict[str, DataFrame]) -> DataFrame:
    """Grey keywords that show too little of their seed become TRASH. Valid keywords give a seed's neighbours."""
    axes = anchors.seed_axes(df.select("seed_id", "seed").distinct(), lexicon, thesaurus.get("facts"))
    grey, valid = (df.where(F.col("label") == x).select("seed_id", "keyword") for x in ("GREY", "VALID"))
    judged = anchors.judge_grey(grey, valid, written(axes), lexicon, thesaurus.get("relations"), thesaurus.get("vectors"))
    gone = judged.where("anchor_label = 'TRASH'").select("seed_id", "keyword", F.col("anchor_reason").alias("_anchor"))
    df = df.join(gone, ["seed_id", "keyword"], "left").withColumn("stage", F.when(F.col("_anchor").isNotNull(), "anchor").otherwise(F.col("stage")))
    return df.withColumn("label", F.when(F.col("_anchor").isNotNull(), "TRASH").otherwise(F.col("label"))).withColumn("reason", F.coalesce("reason", "_anchor")).drop("_anchor")


def label_tails(
    kw: DataFrame, gazetteer: DataFrame, brands: DataFrame, target: str, retailers: DataFrame | None = None, lexicon: DataFrame | None = None,
    geo_db: DataFrame | None = None, names: DataFrame | None = None, districts: DataFrame | None = None, vectors: DataFrame | None = None,
    categories: bool = False, detector_names: list[str] | None = None,
) -> DataFrame:
    """kw (seed_id, seed, keyword, tail, side, ...) with positive, negative, label and confidence; each seed's distinct tails are decided once.

    With geo_db (name, countries), names (name, canonical) and districts places count beside the seed's city, and a column own_geo of kw may say
    that earlier rules confirmed a place. categories adds the mismatch of seed and tail, with vectors (text, embedding) where triples do not decide.
    """
    keys = ["seed_id", "tail", "side"]
    if geo_db is not None:
        dims = (geo_db, names, districts, target, lexicon)
        kw = seed_places.content_after_city(kw, *dims)
        kw, keys = kw if "own_geo" in kw.columns else kw.withColumn("own_geo", F.lit(False)), [*keys, "own_geo", "after_city"]
        kw = written(kw)
    pairs = kw.select("seed", *keys).where("tail <> ''").distinct()
    hits = detectors.dictionary_hits(pairs, gazetteer, brands, target, retailers)
    if geo_db is not None:
        found = seed_places.place_signals(pairs.select("seed_id", "seed", "tail").distinct(), *dims).drop("seed")
        hits = hits.join(found, ["seed_id", "tail"], "left")
    if categories:
        hits = hits.join(agreement.category_mismatch(pairs, vectors).select("seed_id", "tail", "mismatch"), ["seed_id", "tail"], "left")
    fired = detectors.signals(hits, lexicon, detector_names)
    df = kw.join(arbitration.arbitrate(fired), keys, "left").drop("after_city")
    none = F.array().cast("array<string>")
    df = df.withColumn("positive", F.coalesce("positive", none)).withColumn("negative", F.coalesce("negative", none))
    return df.withColumn("label", F.coalesce("label", F.lit("GREY"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def _demote(df: DataFrame, profiles: DataFrame, lexicon: DataFrame | None, brands: DataFrame) -> DataFrame:
    """Valid keywords that lack what their seed cannot do without become GREY."""
    valid = df.where("label = 'VALID'").select("seed_id", "keyword").distinct()
    lost = seed_match.sanity_demotions(valid, profiles, lexicon, brands).where("demoted_reason is not null")
    df = df.join(lost, ["seed_id", "keyword"], "left").withColumn("demoted", (F.col("label") == "VALID") & F.col("demoted_reason").isNotNull())
    reason = F.when(F.col("demoted"), F.concat(F.lit("sanity_mismatch:"), "demoted_reason")).otherwise(F.col("reason"))
    return df.withColumn("reason", reason).withColumn("label", F.when(F.col("demoted"), "GREY").otherwise(F.col("label"))).drop("demoted_reason")


def _decide_grey(df: DataFrame) -> DataFrame:
    """Grey tails by their statistics; one decision for all keywords of a tail."""
    decided = statistics.l2_decisions(df if "demoted" in df.columns else df.withColumn("demoted", F.lit(False))).select("seed_id", "tail", "l2_label")
    hit = (F.col("label") == "GREY") & F.col("l2_label").isNotNull()
    df = df.join(decided, ["seed_id", "tail"], "left").withColumn("stage", F.when(hit, "l2").otherwise(F.col("stage")))
    return df.withColumn("label", F.when(hit, F.col("l2_label")).otherwise(F.col("label"))).drop("l2_label")


def _apply_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Landed verdicts on what is VALID or GREY: 1 is VALID, 0 is TRASH; without one the label stays. verdicts: (seed_id, keyword, verdict)."""
    one = verdicts.where("verdict in (0, 1)").groupBy("seed_id", "keyword").agg(F.min("verdict").alias("_verdict"))
    hit = F.col("label").isin("VALID", "GREY") & F.col("_verdict").isNotNull()
    df = df.join(one, ["seed_id", "keyword"], "left").withColumn("stage", F.when(hit, "verdict").otherwise(F.col("stage")))
    return df.withColumn("label", F.when(hit, F.when(F.col("_verdict") == 1, "VALID").otherwise("TRASH")).otherwise(F.col("label"))).drop("_verdict")


def run_cascade(
    kw: DataFrame, gazetteer: DataFrame, brands: DataFrame, target: str, retailers: DataFrame | None = None,
    lexicon: DataFrame | None = None, stages: tuple[str, ...] = STAGES, places: DataFrame | None = None,
    districts: DataFrame | None = None, verdicts: DataFrame | None = None,
    thesaurus: dict[str, DataFrame] | None = None, names: DataFrame | None = None, seed_rules: bool = False,
) -> DataFrame:
    """(seed_id, seed, pos, keyword, family) with stage, reason, tail, signals, label, confidence and group.

    stages names those of ALL_STAGES that run. geo needs places (name, countries) and may have districts; places come
    from the gazetteer where none are given. anchor, l2 and verdict follow l0; anchor needs the lexicon and may have a
    thesaurus of the tables facts, relations and vectors; verdict needs verdicts (seed_id, keyword, verdict), of which
    the least one counts. The confidence is that of the detectors.

    With names (name, canonical), and districts, tails that name a place come first and places count beside the seed's city. seed_rules judges keywords
    without their seed, looks again without its last word, adds the mismatch of categories (by the thesaurus's texts where triples do not
    decide) and demotes valid keywords that lack what the seed needs.
    """
    if {"anchor", "l2", "verdict"} & {*stages} and "l0" not in stages:
        raise ValueError("anchor, l2 and verdict judge what l0 labelled")
    if "anchor" in stages and lexicon is None:
        raise ValueError("the anchor stage needs a lexicon")
    if names is not None and districts is None:
        raise ValueError("places beside the seed's city need districts")
    if "verdict" in stages and verdicts is None:
        raise ValueError("the verdict stage needs verdicts")
    df = clean.dedupe_first(kw)
    df = clean.pre_filter(df) if "pre" in stages else df.withColumn("reason", F.lit(None).cast("string"))
    if "geo" in stages:
        df = _block_places(written(df), places_of(gazetteer) if places is None else places, districts, target, lexicon)
    else:
        df = df.withColumn("stage", F.lit(None).cast("string"))
    kinds = None if names is None else geo_tails.place_kinds(places_of(gazetteer) if places is None else places, None, districts, target)
    df = df if kinds is None else written(df)
    df = tails.extract_tail(df, lexicon, places=kinds).withColumn("tail", F.when(F.col("reason").isNull(), F.col("tail")))
    profiles = None
    if seed_rules:
        df = written(df)
        profiles = written(seed_match.seed_profiles(df.select("seed_id", "seed").distinct(), lexicon, brands))
        judged = seed_match.no_seed_rules(written(seed_match.short_seed_tails(df, profiles, lexicon)), profiles)
        df = judged.withColumn("stage", F.when(F.col("reason").isNull() & F.col("no_seed_reason").isNotNull(), "l0").otherwise(F.col("stage")))
        df = df.withColumn("reason", F.coalesce("reason", "no_seed_reason")).withColumn("tail", F.when(F.col("reason").isNull(), F.col("tail"))).drop("no_seed_reason")
    if "l0" in stages:
        where = {} if names is None else {"geo_db": places_of(gazetteer) if places is None else places, "names": names, "districts": districts}
        df = label_tails(df.withColumn("side", tails.side()), gazetteer, brands, target, retailers, lexicon, **where, categories=seed_rules, vectors=(thesaurus or {}).get("texts")).drop("side", "own_geo")
    is_seed = F.coalesce(F.col("tail") == "", F.lit(False))
    df = df.withColumn("stage", F.coalesce("stage", F.when(F.col("reason").isNotNull(), "pre").otherwise("l0")))
    label = F.when(F.col("reason").isNotNull(), "TRASH").when(is_seed, "VALID").otherwise(F.col("label"))
    df = df.withColumn("label", label).withColumn("confidence", F.when(is_seed | F.col("reason").isNotNull(), 1.0).otherwise(F.col("confidence")))
    if seed_rules and "l0" in stages:
        df = _demote(written(df), profiles, lexicon, brands)
    if "anchor" in stages:
        df = _prove_anchors(written(df), lexicon, thesaurus or {})
    if "l2" in stages:
        df = _decide_grey(written(df))
    if "verdict" in stages:
        df = _apply_verdicts(df, verdicts)
    grouped = arbitration.group_keywords(df)
    return grouped.withColumn("group", F.when(F.col("label") == "VALID", F.col("group")))
