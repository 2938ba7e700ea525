"""Domain anchors: the older scheme for grey keywords. A keyword has to show its seed's object, or something that
scores near it, and then its action.

Unlike seedsift.operators.anchors, the object follows from case and preposition, what a seed's valid and rejected
keywords say is summed up in a profile, and an action may be shown by any word of a set that is learned from the
keywords. Tables are those of that module; the lexicon has case, too, and only its parse of rank 0 counts. Words that
it lacks are their own lemma and have no part of speech.

Words meet the lexicon, a seed's scores and its actions by equi-joins; only a keyword's own words are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators.statistics import centroids, cosine, norm

#: Words that say nothing, ordinals by number, and parts of speech.
STOP_WORDS = (
    "купить", "заказать", "цена", "стоимость", "отзывы", "продажа", "доставка",
    "в", "на", "с", "и", "или", "без", "для", "под", "через", "у", "к", "от",
    "из", "о", "об", "как", "где", "почему", "что", "это", "до", "по", "за",
    "про", "со", "но", "же", "ли", "бы", "не", "ни", "весь", "все", "всё",
)
ORDINALS = {
    "1": "первый", "2": "второй", "3": "третий", "4": "четвертый", "5": "пятый", "6": "шестой", "7": "седьмой", "8": "восьмой", "9": "девятый", "10": "десятый",
    "11": "одиннадцатый", "12": "двенадцатый", "13": "тринадцатый", "14": "четырнадцатый", "15": "пятнадцатый", "16": "шестнадцатый", "17": "семнадцатый",
    "18": "восемнадцатый", "19": "девятнадцатый", "20": "двадцатый",
}
ACTION_POS = ("NOUN", "INFN", "VERB")
CONTENT_POS = ("NOUN", "INFN", "VERB", "ADJF", "PRTF", "ADJS")
#: The profile's thresholds, the scores of a keyword's noun, and what makes an action.
FLOOR, FEW, FEW_THRESHOLD, TOP, TOO_CLOSE, LEAST_TRASH = 0.45, 5, 0.50, 10, 0.55, 3
SCORE, SIGNAL_BONUS, NEIGHBOUR_BONUS, FIRST_NOUNS = 0.50, 0.10, 0.05, 5
REACH, LEAST_NEAR, LEAST_VERB, MOST_VERBS, ACTION_COSINE, ABBREVIATION, LEAST_GREY = 2, 2, 3, 30, 0.50, 4, 10


def _parses(lexicon: DataFrame) -> DataFrame:
    """(word, lemma, pos, case) of rank 0, the least of several."""
    first = lexicon.where("rank = 0").groupBy("word").agg(F.min(F.struct("lemma", "pos", "case")).alias("_p"))
    return first.select("word", "_p.lemma", "_p.pos", "_p.case")


def object_axes(seeds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, object, qualifier, ordinal, action, root, content, seed_words) of each row of (seed_id, seed).

    The object is the first noun in the genitive, else the first after a preposition, else the first in the accusative,
    else the last one. The action is the first noun or verb; its root are the first letters of its lemma, five at most.
    The qualifier is the last word of digits only.
    """
    words = seeds.select("seed_id", F.posexplode_outer(X.words("seed")).alias("p", "word")).join(_parses(lexicon), "word", "left")
    per = words.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("p", "word", "lemma", "pos", "case")))).alias("_w"))
    digits = F.filter("_w", lambda x: x["word"].rlike(r"^\p{Nd}+$"))
    plain = F.filter("_w", lambda x: ~x["word"].rlike(r"^\p{Nd}+$"))

    def place(x: Column) -> Column:
        after = F.coalesce(F.get("_w", x["p"] - 1)["pos"] == "PREP", F.lit(False))
        way = F.when(F.coalesce(x["case"] == "gent", F.lit(False)), 0).when(after, 1).when(F.coalesce(x["case"] == "accs", F.lit(False)), 2).otherwise(3)
        return F.struct(way.alias("way"), F.when(way == 3, -x["p"]).otherwise(x["p"]).alias("at"), x["lemma"].alias("lemma"))

    nouns = F.transform(F.filter(plain, lambda x: x["pos"] == "NOUN"), place)
    action = F.get(F.filter(plain, lambda x: x["pos"].isin(*ACTION_POS)), F.lit(0))["lemma"]
    content = F.filter("_w", lambda x: x["pos"].isin(*CONTENT_POS) & (F.length(x["word"]) > 2) & ~x["word"].isin(*STOP_WORDS))
    named = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    out = per.select(
        "seed_id", F.array_min(nouns)["lemma"].alias("object"), F.get(digits, F.size(digits) - 1)["word"].alias("qualifier"), action.alias("action"),
        F.array_distinct(F.transform(content, lambda x: x["lemma"])).alias("content"), F.transform("_w", lambda x: x["word"]).alias("seed_words"),
    )
    root = F.substring(F.col("action"), F.lit(1), F.least(F.lit(5), F.greatest(F.lit(4), F.length("action") - 2)))
    return out.select("seed_id", "object", "qualifier", F.element_at(named, F.col("qualifier")).alias("ordinal"), "action", root.alias("root"), "content", "seed_words")


def _words(kw: DataFrame, axes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, keyword, p, word, lemma, pos) with the seed's axes, of the distinct keywords."""
    text = F.regexp_extract_all(F.lower("keyword"), F.lit("([а-яёa-z]+)"), F.lit(1))
    flat = kw.select("seed_id", "keyword").distinct().select("seed_id", "keyword", F.posexplode(text).alias("p", "word"))
    return flat.join(_parses(lexicon).drop("case"), "word", "left").withColumn("lemma", F.coalesce("lemma", "word")).join(axes, "seed_id")


def _own_noun() -> Column:
    """A noun of three letters or more that says something and is no word of the seed."""
    return F.coalesce(F.col("pos") == "NOUN", F.lit(False)) & (F.length("word") > 2) & ~F.col("word").isin(*STOP_WORDS) & ~F.array_contains("seed_words", F.col("word"))


def object_neighbours(words: DataFrame, reach: int = REACH, least: int = LEAST_NEAR) -> DataFrame:
    """(seed_id, lemma): nouns within reach of the object in at least so many valid keywords."""
    lemma, obj = F.col("lemma"), F.col("object")
    at = F.collect_list(F.when((F.length("word") > 2) & lemma.startswith(obj), F.col("p")))
    per = words.groupBy("seed_id", "keyword").agg(at.alias("_at"), F.collect_list(F.when(_own_noun(), F.struct("p", "lemma"))).alias("_nouns"))
    near = F.filter("_nouns", lambda x: F.exists("_at", lambda q: (q != x["p"]) & (F.abs(q - x["p"]) <= reach)))
    rows = per.select("seed_id", F.explode(F.array_distinct(F.transform(near, lambda x: x["lemma"]))).alias("lemma"))
    return rows.groupBy("seed_id", "lemma").count().where(F.col("count") >= least).select("seed_id", "lemma")


def _units(vectors: DataFrame) -> DataFrame:
    return vectors.select("lemma", F.transform("embedding", lambda x: x.cast("double") / norm("embedding")).alias("embedding"))


def _near_to(rows: DataFrame, axes: DataFrame, axis: str, vectors: DataFrame, name: str) -> DataFrame:
    """Rows of (seed_id, lemma) with a vector, beside their cosine to the seed's axis; the axis needs a vector, too."""
    to = axes.select("seed_id", F.col(axis).alias("_axis")).join(vectors.select(F.col("lemma").alias("_axis"), F.col("embedding").alias("_to")), "_axis").drop("_axis")
    wide = rows.join(vectors.select("lemma", F.col("embedding").alias("_v")), "lemma").join(to, "seed_id")
    return wide.withColumn(name, cosine("_v", "_to")).drop("_v", "_to")


def domain_profile(
    valid: DataFrame, trash: DataFrame, axes: DataFrame, lexicon: DataFrame, vectors: DataFrame,
    floor: float = FLOOR, few_threshold: float = FEW_THRESHOLD, top: int = TOP, too_close: float = TOO_CLOSE,
) -> DataFrame:
    """(seed_id, n_lemmas, threshold, centroid, trash_cos, trash_centroid) of each seed whose object has a vector.

    Lemmas are the nouns of valid keywords. The threshold is the cosine to the object that a tenth of them stay below, not
    under the floor; with fewer than five lemmas a fixed one. The centroid is the mean of the nearest ones. Nouns of
    rejected keywords only give a centroid, too, if at least three have vectors; it is dropped (null) if it lies too
    close to the object. All lemmas count.
    """
    units = _units(vectors)
    own = _words(valid, axes, lexicon).where(_own_noun()).select("seed_id", "lemma").distinct()
    sims = _near_to(own, axes, "object", units, "_cos")
    n = sims.groupBy("seed_id").agg(F.count("*").alias("n_lemmas"))
    rising = F.row_number().over(Window.partitionBy("seed_id").orderBy("_cos", "lemma"))
    falling = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("_cos"), "lemma"))
    tenth = sims.withColumn("_rank", rising).join(n, "seed_id").where(F.col("_rank") == F.floor(F.col("n_lemmas") * 0.1) + 1)
    low = tenth.select("seed_id", F.when(F.col("n_lemmas") >= FEW, F.greatest(F.lit(floor), "_cos")).alias("_low"))
    nearest = sims.withColumn("_rank", falling).where(F.col("_rank") <= top).join(units, "lemma").select("seed_id", "embedding")

    rejected = _words(trash, axes, lexicon).where(_own_noun()).select("seed_id", "lemma").distinct().join(own, ["seed_id", "lemma"], "left_anti").join(units, "lemma")
    enough = rejected.groupBy("seed_id").count().where(F.col("count") >= LEAST_TRASH).select("seed_id")
    away = centroids(rejected.select("seed_id", "embedding").join(enough, "seed_id"), "seed_id").withColumnRenamed("centroid", "_away")

    known = axes.select("seed_id", F.col("object").alias("lemma")).join(units.withColumnRenamed("embedding", "_object"), "lemma").drop("lemma")
    out = known.join(n, "seed_id", "left").join(low, "seed_id", "left").join(centroids(nearest, "seed_id"), "seed_id", "left").join(away, "seed_id", "left")
    return out.withColumn("trash_cos", cosine("_away", "_object")).select(
        "seed_id", F.coalesce("n_lemmas", F.lit(0)).alias("n_lemmas"), F.coalesce("_low", F.lit(few_threshold)).alias("threshold"), "centroid", "trash_cos",
        F.when(F.col("trash_cos") <= too_close, F.col("_away")).alias("trash_centroid"),
    )


def action_set(valid: DataFrame, grey: DataFrame, axes: DataFrame, lexicon: DataFrame, vectors: DataFrame | None = None, least_cosine: float = ACTION_COSINE, most_verbs: int = MOST_VERBS) -> DataFrame:
    """(seed_id, lemma, source): the action, verbs that stand three times or more in valid keywords (the most frequent ones, the feature's
    limit), and nouns of valid or grey keywords that are near to the action and not nearer to the object. Lemmas with the object
    inside or the action's root in front are left out."""
    lemma, acting = F.col("lemma"), axes.where("action is not null")
    other = ~F.coalesce(F.contains(lemma, F.col("object")), F.lit(False)) & ~lemma.startswith(F.col("root")) & ~F.col("word").isin(*STOP_WORDS)
    said = _words(valid, acting, lexicon).where(other)
    verbs = said.where(F.col("pos").isin("INFN", "VERB") & (F.length("word") > 3)).groupBy("seed_id", "lemma").count().where(F.col("count") >= LEAST_VERB)
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("count"), "lemma"))
    verbs = verbs.withColumn("_rank", rank).where(F.col("_rank") <= most_verbs).select("seed_id", "lemma", F.lit("verb").alias("source"))
    out = acting.select("seed_id", F.col("action").alias("lemma"), F.lit("action").alias("source")).unionByName(verbs)
    if vectors is None:
        return out
    both = said.unionByName(_words(grey, acting, lexicon).where(other))
    nouns = both.where((F.col("pos") == "NOUN") & (F.length("word") > 2)).select("seed_id", "lemma").distinct().join(out, ["seed_id", "lemma"], "left_anti")
    near = _near_to(nouns, acting, "action", vectors, "_act").where(F.col("_act") >= least_cosine)
    to_object = _near_to(near.select("seed_id", "lemma"), acting, "object", vectors, "_obj")
    kept = near.join(to_object, ["seed_id", "lemma"], "left").where("_obj is null or _obj <= _act")
    return out.unionByName(kept.select("seed_id", "lemma", F.lit("noun").alias("source")))


def judge_domain(
    grey: DataFrame, valid: DataFrame, axes: DataFrame, lexicon: DataFrame, relations: DataFrame | None = None, vectors: DataFrame | None = None,
    least_score: float = SCORE, least_cosine: float = ACTION_COSINE, first_nouns: int = FIRST_NOUNS, least_grey: int = LEAST_GREY, most_verbs: int = MOST_VERBS, actions: bool = True,
) -> DataFrame:
    """(seed_id, keyword, domain_label, domain_reason, anchor_signal, action_signal, near_lemma, near_score), one row for each distinct
    (seed_id, keyword) of grey; null columns of what was not asked.

    grey may have a boolean column positive: whether earlier rules found something good in the keyword. Seeds with fewer grey
    keywords than least_grey, and those without object, ask nothing. Of several parents in the thesaurus the least is named.
    """
    good = F.coalesce(F.bool_or("positive"), F.lit(False)) if "positive" in grey.columns else F.lit(False)
    keys = grey.groupBy("seed_id", "keyword").agg(good.alias("positive"))
    many = keys.groupBy("seed_id").agg((F.count("*") >= least_grey).alias("_many"))
    flat = _words(grey, axes, lexicon)
    said = _words(valid, axes, lexicon)
    near = object_neighbours(said).withColumn("_near", F.lit(True))
    scored = flat.select("seed_id", "keyword", "p", "word", "lemma", "pos", _own_noun().alias("_own")).join(near, ["seed_id", "lemma"], "left")
    if vectors is None:
        scored = scored.withColumn("_cos", F.lit(None).cast("double"))
    else:
        scored = scored.join(_near_to(flat.where(_own_noun()).select("seed_id", "lemma").distinct(), axes, "object", vectors, "_cos"), ["seed_id", "lemma"], "left")
    acts = action_set(valid, grey, axes, lexicon, vectors, least_cosine, most_verbs).select("seed_id", "lemma", F.lit(True).alias("_acts"))
    scored = scored.join(acts, ["seed_id", "lemma"], "left")
    per = scored.groupBy("seed_id", "keyword").agg(F.array_sort(F.collect_list(F.struct("p", "word", "lemma", "pos", "_own", "_near", "_cos", "_acts"))).alias("_w"))
    wide = keys.join(per, ["seed_id", "keyword"], "left").join(many, "seed_id").join(axes, "seed_id", "left")
    if relations is None:
        wide = wide.withColumn("_kin", F.array().cast("array<string>"))
    else:
        kin = axes.select("seed_id", "object").join(relations.select(F.col("lemma").alias("object"), F.lower("other").alias("_other")), "object").where("_other <> object")
        wide = wide.join(kin.groupBy("seed_id").agg(F.collect_set("_other").alias("_kin")), "seed_id", "left")

    text, obj, number = F.lower("keyword"), F.col("object"), F.col("qualifier")
    lemmas = F.transform(F.col("_w"), lambda x: x["lemma"])
    alone = F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?<!\p{Nd})"), number, F.lit(r"(?!\p{Nd})"))), F.lit(False))
    spelled = F.coalesce(F.contains(text, F.col("ordinal")), F.lit(False))
    inside = F.contains(text, obj)
    shown = F.coalesce(F.arrays_overlap(lemmas, "content"), F.lit(False))
    kin_inside = F.array_min(F.filter("_kin", lambda x: F.contains(text, x)))
    kin_lemma = F.array_min(F.array_intersect(lemmas, "_kin"))
    nouns = F.slice(F.filter("_w", lambda x: x["_own"]), 1, first_nouns)
    bonus = F.when(F.col("positive"), SIGNAL_BONUS).otherwise(0.0)

    def score(x: Column) -> Column:
        total = x["_cos"] + bonus + F.when(x["_near"], NEIGHBOUR_BONUS).otherwise(0.0)
        return F.struct(total.alias("score"), (-x["p"]).alias("at"), x["lemma"].alias("lemma"))

    best = F.array_max(F.filter(F.transform(nouns, score), lambda x: x["score"] > 0))
    wide = wide.withColumns({"_best": best, "_alone": alone, "_kin_in": kin_inside, "_kin_lemma": kin_lemma})
    asked = obj.isNotNull() & F.col("_many")
    anchor = (
        F.when(~asked, None)
        .when(number.isNotNull() & ~F.col("_alone") & ~spelled, F.concat(F.lit("-no_qualifier:"), number))
        .when((F.size("content") > 0) & ~shown & ~inside, "-no_seed_lemma")
        .when(inside, "substring")
        .when(F.col("_alone"), "qualifier_digit").when(spelled, "qualifier_text")
        .when(F.coalesce(F.array_contains(lemmas, obj), F.lit(False)), "lemma")
        .when(F.col("_kin_in").isNotNull(), F.concat(F.lit("synonym_substring:"), "_kin_in"))
        .when(F.col("_kin_lemma").isNotNull(), F.concat(F.lit("synonym_lemma:"), "_kin_lemma"))
        .when(F.col("_best").isNull(), "-no_anchor").when(F.col("_best.score") >= least_score, "score").otherwise("-score_low")
    )
    wide = wide.withColumn("anchor_signal", X.settled(anchor))
    found = F.coalesce(~F.col("anchor_signal").startswith("-"), F.lit(False))
    first = F.get(F.filter("_w", lambda x: x["lemma"].startswith(F.col("root")) | F.coalesce(x["_acts"], F.lit(False))), F.lit(0))
    opens = F.get("_w", F.lit(0))
    short = inside & F.length(opens["word"]).between(2, ABBREVIATION) & (opens["pos"] == "NOUN") & ~F.contains(opens["lemma"], obj)
    action = (
        F.when(~found | (F.lit(not actions)), None).when(F.col("action").isNull(), "no_action_extracted")
        .when(first["lemma"].startswith(F.col("root")), F.concat(F.lit("action_root:"), first["lemma"])).when(first.isNotNull(), F.concat(F.lit("action_lemma:"), first["lemma"]))
        .when(F.coalesce(short, F.lit(False)), F.concat(F.lit("action_abbrev:"), opens["lemma"])).otherwise("-no_action")
    )
    wide = wide.withColumn("action_signal", X.settled(action))
    acts_not = F.coalesce(F.col("action_signal") == "-no_action", F.lit(False))
    reason = F.when(~F.col("_many"), "too_few").when(obj.isNull(), "no_object").when(~found, "no_domain_anchor").when(acts_not, "no_action").otherwise("shown")
    label = F.when(asked & (~found | acts_not), "TRASH").otherwise("GREY")
    semantic = F.col("anchor_signal").isin("score", "-score_low")
    return wide.select(
        "seed_id", "keyword", label.alias("domain_label"), reason.alias("domain_reason"), "anchor_signal", "action_signal",
        F.when(semantic, F.col("_best.lemma")).alias("near_lemma"), F.when(semantic, F.col("_best.score")).alias("near_score"),
    )


def apply_domain(kw: DataFrame, axes: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """kw (seed_id, keyword, label, ...) with grey keywords that fail turned to TRASH, beside domain_reason (null for others)."""
    grey = kw.where("label = 'GREY'")
    judged = judge_domain(grey, kw.where("label = 'VALID'"), axes, lexicon, **options).select("seed_id", "keyword", F.lit("GREY").alias("label"), "domain_label", "domain_reason")
    left = kw.join(judged, ["seed_id", "keyword", "label"], "left").withColumn("label", F.coalesce("domain_label", "label"))
    return left.select(*kw.columns, "domain_reason")
