"""Statistics over tails, vectors and neighbourhoods: what decides grey keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from seedsift.functions import text as X

#: Thresholds of the rules for grey tails, and signals that are soft there.
PMI_VALID, MORPH_VALID = 2.5, 0.7
SOFT = ("category_mismatch",)


def word_df(tails: DataFrame, keys: tuple[str, ...] = ("seed_id",)) -> DataFrame:
    """In how many rows of (keys, tail) each word stands; words of a tail count once."""
    w = tails.select(*keys, F.explode(F.array_distinct(X.words("tail"))).alias("word"))
    return w.groupBy(*keys, "word").agg(F.count("*").alias("df"))


def pmi(tails: DataFrame, df: DataFrame, keys: tuple[str, ...] = ("seed_id",)) -> DataFrame:
    """(keys, tail, pmi): the least log2(df + 1) over a tail's content words, those of over two letters or all digits; over all, if it has none; 0 without words."""
    w = tails.where("tail is not null").select(*keys, "tail").distinct().select(*keys, "tail", F.explode_outer(F.array_distinct(X.words("tail"))).alias("word"))
    score = F.log2(F.coalesce("df", F.lit(0)) + 1)
    content = (F.length("word") > 2) | X.is_digits("word")
    out = w.join(df, [*keys, "word"], "left").groupBy(*keys, "tail")
    return out.agg(F.coalesce(F.min(F.when(content, score)), F.min(score)).alias("pmi"))


def spec_token(c) -> Column:
    """The first word that mixes digits and letters, or null."""
    return F.get(F.filter(X.words(c), lambda w: w.rlike(r"\p{Nd}") & w.rlike(r"\p{L}")), F.lit(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, centroid): the mean of each place of the vectors; means pre-aggregate per place."""
    places = vectors.select(key, F.posexplode("embedding").alias("p", "x")).groupBy(key, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("p", "m")))
    return places.groupBy(key).agg(F.transform(pairs, lambda x: x["m"]).alias("centroid"))


def pole_contrast(vectors: DataFrame, poles: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """Each vector's cosine to its own pole's centroid, to the best other one, and the margin. poles: (key, centroid), any number of rows.

    Poles are dealt into blocks of bounded size. A vector meets each block once and keeps the best of its poles there, so what is
    shuffled are a block's maxima, and no list of all poles is held anywhere.
    """
    n = max(1, -(-poles.count() // block))
    dealt = poles.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_block"), F.struct(F.col(key).alias("k"), "centroid").alias("p"))
    blocks = dealt.groupBy("_block").agg(F.collect_list("p").alias("_poles"))
    asked = vectors.select("vec_id", key, "embedding", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"))
    met = asked.join(blocks, "_block")
    cosines = F.transform("_poles", lambda p: F.struct((p["k"] == F.col(key)).alias("own"), cosine("embedding", p["centroid"]).alias("c")))
    met = met.select("vec_id", key, X.settled(cosines).alias("_c"))
    best = lambda own: F.array_max(F.transform(F.filter("_c", lambda x: x["own"] == own), lambda x: x["c"]))
    out = met.select("vec_id", key, best(True).alias("own"), best(False).alias("other")).groupBy("vec_id", key)
    return out.agg(F.max("own").alias("own"), F.max("other").alias("other")).withColumn("margin", F.col("own") - F.col("other"))


def knn_score(queries: DataFrame, base: DataFrame, key: str, k: int = 3, block: int = 4096) -> DataFrame:
    """Mean cosine of each query to its k nearest base vectors of the same key.

    A key's base vectors are dealt into blocks of bounded size, as many as its count asks for, so a key with most of the
    rows is spread. The k best of a query are found by rank, which Spark limits before and after the shuffle.
    """
    blocks = base.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    q = queries.select("vec_id", key, F.col("embedding").alias("_q")).join(blocks, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    b = base.select(key, F.col("vec_id").alias("_id"), F.col("embedding").alias("_b")).join(blocks, key)
    b = b.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_n")
    wide = q.join(b, [key, "_block"]).where("vec_id <> _id").select("vec_id", "_id", cosine("_q", "_b").alias("_cos"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("_cos"), F.desc("_id")))
    return wide.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy("vec_id").agg(F.avg("_cos").alias("score"))


def neighbours(kw: DataFrame, word: str, reach: int = 2, least: int = 2) -> DataFrame:
    """Words within reach of the object in enough keywords. kw: (seed_id, keyword, object)."""
    w = kw.select("seed_id", "keyword", F.col(word).alias("_o"), X.words("keyword").alias("_w")).withColumn("_at", F.array_position("_w", F.col("_o")).cast("int"))
    near = w.where("_at > 0").select("seed_id", "keyword", "_o", F.explode(F.expr(f"slice(_w, greatest(1, _at - {reach}), least(size(_w), _at + {reach}) - greatest(1, _at - {reach}) + 1)")).alias("word"))
    return near.where("word <> _o").groupBy("seed_id", "word").agg(F.count_distinct("keyword").alias("n")).where(F.col("n") >= least)


def question_anchors(kw: DataFrame, adverbs, least: int = 2) -> DataFrame:
    """Question words that open enough keywords of a seed."""
    first = F.get(X.words("keyword"), F.lit(0))
    return kw.withColumn("word", first).where(F.col("word").isin(*adverbs)).groupBy("seed_id", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _grey(known: DataFrame) -> DataFrame:
    hard = F.size(F.array_except("negative", F.array(*(F.lit(s) for s in SOFT)))) > 0
    return known.where("label = 'GREY'").withColumn("_pure", hard & (F.size("positive") == 0))


def l2_decisions(kw: DataFrame, pmi_valid: float = PMI_VALID, morph: DataFrame | None = None) -> DataFrame:
    """(seed_id, tail, pmi, rule, l2_label): one decision for each grey tail. kw: (seed_id, pos, tail, label, positive, negative, demoted).

    Document frequencies come from valid and grey tails. The first keyword of a tail gives its signals. morph (seed_id,
    tail, morph) has the agreement of tails with their seed's head; leave out tails that follow a place of the seed.
    """
    known = kw.where("label in ('VALID', 'GREY') and tail <> ''")
    scores = pmi(known, word_df(known))
    per_tail = _grey(known).groupBy("seed_id", "tail").agg(F.min(F.struct("pos", "_pure", "demoted")).alias("_first"))
    per_tail = per_tail.join(scores, ["seed_id", "tail"]).withColumn("_spec", spec_token("tail"))
    scored = per_tail.withColumn("morph", F.lit(None).cast("double")) if morph is None else per_tail.join(morph, ["seed_id", "tail"], "left")
    high, pure, demoted = F.col("pmi") >= pmi_valid, F.col("_first._pure"), F.col("_first.demoted")
    rule = (
        F.when(demoted, "r0_demoted").when(high & ~pure, "r1_pmi").when(high & pure, "r2_conflict")
        .when((F.col("morph") >= MORPH_VALID) & ~pure, "r25_morph").when(F.col("_spec").isNotNull() & ~pure, "r28_spec").otherwise("r6_grey")
    )
    decided = scored.withColumn("rule", rule).withColumn("l2_label", F.when(F.col("rule").isin("r1_pmi", "r25_morph", "r28_spec"), "VALID").otherwise("GREY"))
    return decided.select("seed_id", "tail", "pmi", "rule", "l2_label")


def apply_l2(kw: DataFrame, pmi_valid: float = PMI_VALID, morph: DataFrame | None = None) -> DataFrame:
    """The grey keywords with the decision of their tail. kw: as for l2_decisions, with keyword."""
    grey = kw.where("label = 'GREY' and tail <> ''").select("seed_id", "pos", "keyword", "tail")
    return grey.join(l2_decisions(kw, pmi_valid, morph), ["seed_id", "tail"])


def l2_stats(decided: DataFrame) -> DataFrame:
    return decided.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.min("pmi"), 6).alias("lo"), F.round(F.max("pmi"), 6).alias("hi"), F.round(F.avg("pmi"), 6).alias("mean"))
