"""Anchors of meaning: a grey keyword has to show its seed's number, object and action, or it is TRASH.

The lexicon has (word, rank, lemma, pos, known) and may have grammemes; words that it lacks are their own lemma and have
no part of speech. A thesaurus is two tables: facts (lemma, hyponyms, deverbal), one row for a lemma, and relations
(lemma, rel, other), where rel is synonym or cohyponym. vectors has (lemma, embedding). All but the lexicon may be
missing; then their ways of proof never hold.

Keywords meet what is known of their seed by equi-joins on (seed_id, lemma), and one aggregate of a keyword's lemmas
settles all ways of proof. Only a seed's or a keyword's own words are gathered into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators.statistics import cosine

#: Parts of speech without content, those that may stand for an action, and the thresholds of the proofs.
NOT_CONTENT = ("PREP", "CONJ", "PRCL", "INTJ", "ADVB", "COMP", "NUMR", "NPRO")
ACTION_POS = ("NOUN", "VERB", "INFN", "ADVB")
COS_OBJECT, COS_ACTION, COS_GAP, COS_NUMBER = 0.78, 0.87, 0.05, 0.82
LEAST_LEMMA, SHORT_WORD = 3, 4


def tokens(c) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(X.col(c)), F.lit("([a-zа-яёіїєґ0-9]+)"), F.lit(1))


def _has(lexicon: DataFrame, grammeme: str) -> Column:
    if "grammemes" not in lexicon.columns:
        return F.lit(False)
    return F.coalesce(F.array_contains("grammemes", grammeme), F.lit(False))


def _chosen(lexicon: DataFrame, facts: DataFrame | None) -> DataFrame:
    """(word, lemma, pos, deverbal): the parse that a seed's word is read as; words without a content parse have none.

    An unknown word is read as a noun where it can be; of nouns in the thesaurus the one with most hyponyms counts;
    otherwise the first content parse.
    """
    content = lexicon.where(F.col("pos").isNotNull() & ~F.col("pos").isin(*NOT_CONTENT) & ~_has(lexicon, "Apro"))
    if facts is None:
        content = content.withColumn("hyponyms", F.lit(None).cast("long")).withColumn("deverbal", F.lit(None).cast("boolean"))
    else:
        content = content.join(facts.select("lemma", F.col("hyponyms").cast("long"), "deverbal"), "lemma", "left")
        content = content.withColumn("deverbal", F.coalesce("deverbal", F.lit(False)))
    noun = F.col("pos") == "NOUN"
    way = F.when(noun & ~F.coalesce("known", F.lit(True)), 0).when(noun & F.col("hyponyms").isNotNull(), 1).otherwise(2)
    size = F.when(way == 1, -F.col("hyponyms")).otherwise(0)
    best = content.groupBy("word").agg(F.min(F.struct(way.alias("way"), size.alias("size"), "rank", "lemma", "pos", "deverbal")).alias("_best"))
    return best.select("word", "_best.lemma", "_best.pos", "_best.deverbal")


def seed_axes(seeds: DataFrame, lexicon: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(seed_id, action, object, others, content, qualifier) of each row of (seed_id, seed).

    The action is the first verb, else the first noun that comes from a verb, else the first noun; the object is the
    first other noun that does not come from a verb, else the last other noun. A single content word is the object.
    The qualifier is the first word of digits only.
    """
    words = seeds.select("seed_id", F.posexplode_outer(tokens("seed")).alias("p", "word")).join(_chosen(lexicon, facts), "word", "left")
    one = F.when(F.col("lemma").isNotNull(), F.struct("p", "lemma", "pos", "deverbal"))
    number = F.when(F.col("word").rlike("^[0-9]+$"), F.struct("p", "word"))
    per_seed = words.groupBy("seed_id").agg(F.array_sort(F.collect_list(one)).alias("_c"), F.min(number).alias("_q"))

    nouns = F.filter("_c", lambda x: x["pos"] == "NOUN")
    verbs = F.filter("_c", lambda x: x["pos"].isin("VERB", "INFN"))
    first = per_seed.withColumn("_n", nouns).withColumn(
        "_action", F.coalesce(F.get(verbs, F.lit(0))["lemma"], F.get(F.filter("_n", lambda x: x["deverbal"]), F.lit(0))["lemma"], F.get("_n", F.lit(0))["lemma"])
    )
    first = first.withColumn("_rest", F.filter("_n", lambda x: x["lemma"] != F.col("_action")))
    first = first.withColumn("_object", F.coalesce(F.get(F.filter("_rest", lambda x: ~x["deverbal"]), F.lit(0))["lemma"], F.get("_rest", F.size("_rest") - 1)["lemma"]))
    single = F.col("_object").isNull() & (F.size("_c") == 1)
    out = first.withColumn("action", F.when(~single, F.col("_action"))).withColumn("object", F.when(single, F.get("_c", F.lit(0))["lemma"]).otherwise(F.col("_object")))
    content = F.array_distinct(F.transform("_c", lambda x: x["lemma"]))
    others = F.filter(content, lambda x: ~F.coalesce(x == F.col("action"), F.lit(False)) & ~F.coalesce(x == F.col("object"), F.lit(False)))
    return out.select("seed_id", "action", "object", others.alias("others"), content.alias("content"), F.col("_q.word").alias("qualifier"))


def _lemmas(kw: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, keyword, p, word, lemma, noun, adverb, acts, numeral): all lemmas of each word; a keyword without words has one row of nulls."""
    pos = F.col("pos")
    numeral = (F.col("rank") == 0) & (F.coalesce(pos == "NUMR", F.lit(False)) | _has(lexicon, "NUMR") | _has(lexicon, "Anum"))
    flags = {"noun": pos == "NOUN", "acts": pos.isin(*ACTION_POS), "numeral": numeral}
    dim = lexicon.groupBy("word", "lemma").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()))
    adverbs = lexicon.where(pos == "ADVB").groupBy("word").agg(F.min(F.struct("rank", "lemma"))["lemma"].alias("_adverb"))
    dim = dim.join(adverbs, "word", "left").withColumn("adverb", F.coalesce(F.col("_adverb") == F.col("lemma"), F.lit(False))).drop("_adverb")
    words = kw.select("seed_id", "keyword").distinct().select("seed_id", "keyword", F.posexplode_outer(tokens("keyword")).alias("p", "word"))
    return words.join(dim, "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))


def seed_words(valid: DataFrame, axes: DataFrame, lexicon: DataFrame, reach: int = 2, least: int = 2) -> DataFrame:
    """(seed_id, lemma, neighbour, question) from valid keywords (seed_id, keyword).

    Neighbours are nouns within reach of the object, question words adverbs that open a keyword with the action; both
    in at least so many keywords.
    """
    known = axes.select("seed_id", "action", "object", F.array_append("others", F.col("action")).alias("_not"))
    flat = _lemmas(valid, lexicon).join(known, "seed_id")
    other = F.col("noun") & (F.col("lemma") != F.col("object")) & ~F.coalesce(F.array_contains("_not", F.col("lemma")), F.lit(False))
    per = flat.groupBy("seed_id", "keyword").agg(
        F.collect_set(F.when(F.col("lemma") == F.col("object"), F.col("p"))).alias("_at"),
        F.collect_set(F.when(other, F.struct("p", "lemma"))).alias("_near"),
        F.bool_or(F.col("lemma") == F.col("action")).alias("_acts"),
        F.min(F.when((F.col("p") == 0) & F.col("adverb"), F.col("lemma"))).alias("_first"),
    )
    near = F.filter("_near", lambda x: F.exists("_at", lambda q: (q != x["p"]) & (F.abs(q - x["p"]) <= reach)))
    rows = F.transform(F.array_distinct(F.transform(near, lambda x: x["lemma"])), lambda x: F.struct(x.alias("lemma"), F.lit(True).alias("neighbour")))
    asks = F.when(F.col("_acts") & F.col("_first").isNotNull(), F.array(F.struct(F.col("_first").alias("lemma"), F.lit(False).alias("neighbour")))).otherwise(F.slice(rows, 1, 0))
    counted = per.select("seed_id", F.explode(F.concat(rows, asks)).alias("_x")).groupBy("seed_id", "_x.lemma").agg(
        (F.count_if("_x.neighbour") >= least).alias("neighbour"), (F.count_if(~F.col("_x.neighbour")) >= least).alias("question")
    )
    return counted.where("neighbour or question")


def _relatives(axes: DataFrame, relations: DataFrame) -> DataFrame:
    """(seed_id, lemma, syn_of, cohyp_of): which of a seed's lemmas a lemma is a synonym or a cohyponym of."""
    own = axes.select("seed_id", F.explode("content").alias("_axis"))
    wide = own.join(relations.select(F.col("lemma").alias("_axis"), F.col("other").alias("lemma"), "rel"), "_axis")
    of = {k: F.collect_set(F.when(F.col("rel") == k, F.col("_axis"))) for k in ("synonym", "cohyponym")}
    return wide.groupBy("seed_id", "lemma").agg(of["synonym"].alias("syn_of"), of["cohyponym"].alias("cohyp_of"))


def _cosines(flat: DataFrame, vectors: DataFrame) -> DataFrame:
    """(seed_id, lemma, cos_object, cos_action, cos_number) of the distinct lemmas of each seed's keywords."""
    pairs = flat.select("seed_id", "lemma", "object", "action", "qualifier").distinct().join(vectors.select("lemma", F.col("embedding").alias("_v")), "lemma")
    for axis in ("object", "action", "qualifier"):
        pairs = pairs.join(vectors.select(F.col("lemma").alias(axis), F.col("embedding").alias(f"_{axis}")), axis, "left")
    return pairs.select(
        "seed_id", "lemma", cosine("_v", "_object").alias("cos_object"), cosine("_v", "_action").alias("cos_action"), cosine("_v", "_qualifier").alias("cos_number")
    )


def judge_grey(
    grey: DataFrame, valid: DataFrame, axes: DataFrame, lexicon: DataFrame, relations: DataFrame | None = None, vectors: DataFrame | None = None,
    cos_object: float = COS_OBJECT, cos_action: float = COS_ACTION, cos_gap: float = COS_GAP, cos_number: float = COS_NUMBER,
) -> DataFrame:
    """(seed_id, keyword, anchor_label, anchor_reason, object_proof, action_proof, missing), one row for each distinct (seed_id, keyword) of grey.

    GREY where object, action and all other words of the seed are proven, GREY_SOFT where only others are missing,
    else TRASH. A keyword without words and one without the seed's number are TRASH. A seed without axes asks nothing.
    """
    flat = _lemmas(grey, lexicon).join(axes, "seed_id", "left")
    flat = flat.join(seed_words(valid, axes, lexicon), ["seed_id", "lemma"], "left")
    none = F.lit(None).cast("double")
    if relations is None:
        flat = flat.withColumn("syn_of", F.array().cast("array<string>")).withColumn("cohyp_of", F.array().cast("array<string>"))
    else:
        flat = flat.join(_relatives(axes, relations), ["seed_id", "lemma"], "left")
    if vectors is None:
        flat = flat.withColumns(dict.fromkeys(("cos_object", "cos_action", "cos_number"), none))
    else:
        flat = flat.join(_cosines(flat.where("lemma is not null"), vectors), ["seed_id", "lemma"], "left")

    lemma, obj, act, number = (F.col(c) for c in ("lemma", "object", "action", "qualifier"))
    excluded = F.coalesce((lemma == act) | F.array_contains("others", lemma), F.lit(False))
    candidate = F.col("noun") & (lemma != obj) & ~excluded & F.col("neighbour")
    gap = F.col("cos_object") - F.coalesce("cos_action", F.lit(0.0))
    hyponym = candidate & (F.length(lemma) >= LEAST_LEMMA) & (F.col("cos_object") >= cos_object) & (gap >= cos_gap)
    likely = F.col("acts") & (lemma != act) & (F.length(lemma) >= LEAST_LEMMA) & (F.col("cos_action") >= cos_action)
    numbered = F.col("word").startswith(number) & ~F.coalesce(F.substring(F.col("word"), F.length(number) + 1, F.lit(1)).rlike("[0-9]"), F.lit(False))
    ever = {
        "_num": numbered | (F.col("numeral") & (F.col("cos_number") >= cos_number)),
        "_obj_lemma": lemma == obj, "_obj_syn": F.array_contains("syn_of", obj), "_obj_cohyp": F.array_contains("cohyp_of", obj), "_obj_hyp": hyponym,
        "_obj_short": candidate & (F.col("p") == 0) & (F.length("word") <= SHORT_WORD),
        "_act_lemma": lemma == act, "_act_syn": F.array_contains("syn_of", act), "_act_ask": F.col("adverb") & F.col("question"), "_act_cos": likely,
    }
    proven = F.array_distinct(F.flatten(F.collect_set("syn_of")))
    per = flat.groupBy("seed_id", "keyword").agg(
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in ever.items()),
        F.concat(F.collect_set("lemma"), proven).alias("_shown"), *(F.first(c).alias(c) for c in ("object", "action", "qualifier", "others")),
    )
    text = F.array_join(tokens("keyword"), " ")
    object_proof = F.when(obj.isNull(), "no_object_in_seed").when(F.contains(text, obj), "substring")
    for flag, name in (("_obj_lemma", "lemma"), ("_obj_syn", "synonym"), ("_obj_cohyp", "cohyponym"), ("_obj_hyp", "hyponym"), ("_obj_short", "short_first_word")):
        object_proof = object_proof.when(F.col(flag), name)
    action_proof = F.when(act.isNull(), "no_action_in_seed").when(F.contains(text, act), "substring")
    for flag, name in (("_act_lemma", "lemma"), ("_act_syn", "synonym"), ("_act_ask", "question_word"), ("_act_cos", "near_action")):
        action_proof = action_proof.when(F.col(flag), name)
    missing = F.filter("others", lambda x: ~F.contains(text, x) & ~F.array_contains("_shown", x))
    per = per.withColumn("object_proof", object_proof).withColumn("action_proof", action_proof).withColumn("missing", F.coalesce(missing, F.array().cast("array<string>")))

    failed = F.array_compact(F.concat(
        F.array(F.when(F.col("object_proof").isNull(), "obj"), F.when(F.col("action_proof").isNull(), "act")),
        F.transform("missing", lambda x: F.concat(F.lit("other:"), x)),
    ))
    empty, lacks = F.coalesce(F.size(tokens("keyword")) == 0, F.lit(True)), number.isNotNull() & ~F.col("_num")
    main = F.col("object_proof").isNotNull() & F.col("action_proof").isNotNull()
    label = F.when(empty | lacks | ~main, "TRASH").when(F.size("missing") > 0, "GREY_SOFT").otherwise("GREY")
    reason = (
        F.when(empty, "empty").when(lacks, F.concat(F.lit("qualifier_missing:"), number)).when(~main, F.concat(F.lit("axis_unproven:"), F.array_join(failed, ",")))
        .when(F.size("missing") > 0, F.concat(F.lit("others_missing:"), F.array_join("missing", ","))).otherwise("all_axes_proven")
    )
    return per.select("seed_id", "keyword", label.alias("anchor_label"), reason.alias("anchor_reason"), "object_proof", "action_proof", "missing")
