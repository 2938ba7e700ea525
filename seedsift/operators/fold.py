"""Suggestions folded to keywords, and what each probe yielded.

log: one row per probe (seed_id, struct, agent, letter, grp, gap, http_status, n_results, time_ms, ts, seq).
suggestions: one row per suggestion (seed_id, struct, agent, letter, keyword, seq, family).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X

#: Single letters that are words, and marks that make a word garbage when it has nothing else.
SINGLE_LETTERS = ("в", "с", "к", "у", "о", "а", "и", "б")
BAD_MARKS = r"""-*|~%\\!:^@#$&+=\[\]{}()<>/?'\""""


def garbage_suffix(keyword, seed) -> Column:
    """A word of marks only, a stray letter, or no word of four letters beyond the seed's."""
    w, s = F.filter(F.split(X.col(keyword), r"(?U)\s+"), lambda x: x != ""), X.words(seed)
    marks = F.exists(w, lambda x: x.rlike(f"^[{BAD_MARKS}]+$"))
    stray = F.exists(w, lambda x: x.rlike(r"^\p{L}$") & ~F.lower(x).isin(*SINGLE_LETTERS))
    own = F.filter(w, lambda x: ~F.array_contains(s, F.lower(x)))
    return marks | stray | ((F.size(own) > 0) & ~F.exists(own, lambda x: x.rlike(r"^\p{L}{4,}$")))


def garbage_basic(keyword) -> Column:
    """A mark of probes, or a stray letter."""
    stray = F.exists(X.words(keyword), lambda x: x.rlike(r"^\p{L}$") & ~x.isin(*SINGLE_LETTERS))
    return X.col(keyword).rlike(r"[*:|&\\]") | stray


def letter_artifact(keyword, seed) -> Column:
    """A single letter, or a dash and one, right after the seed's words."""
    w, n = X.words(keyword), F.size(X.words(seed))
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    starts = F.array_join(F.slice(w, F.lit(1), n), " ") == X.squeeze(seed)
    one = at(n).rlike(r"^\p{L}$") & ~at(n).isin(*SINGLE_LETTERS)
    dashed = (at(n) == "-") & at(n + 1).rlike(r"^\p{L}$")
    return starts & (one | dashed) & (F.size(w) > n + 1)


def fold_keywords(suggestions: DataFrame) -> DataFrame:
    """(seed_id, keyword) with weight, the number of hits, and its sources as agent:struct; hits pre-aggregate per source."""
    by = suggestions.groupBy("seed_id", "keyword", "agent", "struct").agg(F.count("*").alias("n"))
    source = F.concat_ws(":", "agent", "struct")
    return by.groupBy("seed_id", "keyword").agg(F.sum("n").alias("weight"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def by_weight(folded: DataFrame) -> DataFrame:
    """Folded keywords in the order of a reply: heavier ones first, then by the keyword."""
    return folded.orderBy(F.desc("weight"), "keyword")


def exclusive_keywords(suggestions: DataFrame) -> DataFrame:
    """Keywords that exactly one struct produced, with it."""
    by = suggestions.groupBy("seed_id", F.lower(F.trim("keyword")).alias("keyword"))
    return by.agg(F.min("struct").alias("struct"), F.max("struct").alias("_last")).where("struct = _last").drop("_last")


def alt_seed(kw: DataFrame) -> DataFrame:
    """Adds alt_seed: the keyword does not contain the seed's text."""
    return kw.withColumn("alt_seed", ~F.lower("keyword").contains(F.lower("seed")))


def fetch_status(log: DataFrame) -> DataFrame:
    """Adds status: ok, empty, timeout, blocked or the code."""
    code = F.col("http_status")
    status = F.when(code == 0, "timeout").when(code.isin(403, 429), "blocked").when(code != 200, F.concat(F.lit("http_"), code.cast("string")))
    return log.withColumn("status", F.coalesce(status, F.when(F.col("n_results") > 0, "ok").otherwise("empty")))


def status_counts(log: DataFrame) -> DataFrame:
    return fetch_status(log).groupBy("status").agg(F.count("*").alias("n"))


def yield_by(log: DataFrame, *keys: str) -> DataFrame:
    """Per key: probes sent, with results, empty, suggestions and mean time."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("sent"), F.count_if(F.col("n_results") > 0).alias("with_results"), F.count_if(F.col("n_results") == 0).alias("empty"),
        F.sum("n_results").alias("suggestions"), F.round(F.avg("time_ms"), 3).alias("avg_ms"),
    )


def yield_by_group(suggestions: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """Per struct and agent, distinct keywords, and those that only this struct produced; agents become columns."""
    key = F.lower(F.trim("keyword")).alias("keyword")
    distinct = suggestions.select("seed_id", "struct", "agent", key).distinct()
    wide = distinct.groupBy("struct").pivot("agent", list(agents)).agg(F.count_distinct("seed_id", "keyword"))
    own = exclusive_keywords(suggestions).groupBy("struct").agg(F.count("*").alias("n_exclusive"))
    total = distinct.groupBy("struct").agg(F.count_distinct("seed_id", "keyword").alias("n_distinct"))
    return total.join(own, "struct", "left").join(wide, "struct", "left").fillna(0)


def last_by_label(log: DataFrame) -> DataFrame:
    """The last probe of each struct and letter."""
    return log.groupBy("struct", "letter").agg(F.max_by(F.struct("seq", "n_results", "http_status"), "seq").alias("r")).select("struct", "letter", "r.*")


def stage_stats(log: DataFrame) -> DataFrame:
    """Per struct: requests, wall seconds, summed and mean time, requests a second."""
    out = log.groupBy("struct").agg(
        F.count("*").alias("requests"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("wall_us"), F.round(F.sum("time_ms"), 2).alias("sum_ms"), F.round(F.avg("time_ms"), 3).alias("avg_ms")
    )
    return out.withColumn("per_s", F.round(F.when(F.col("wall_us") > 0, F.col("requests") * 1e6 / F.col("wall_us")).otherwise(0.0), 6))


def unique_to(suggestions: DataFrame, case: str, inside: tuple[str, ...] = ()) -> DataFrame:
    """Keywords that stand in one case only (within the columns of inside), with it: no set is compared with every other."""
    by = suggestions.groupBy(*inside, F.lower(F.trim("keyword")).alias("keyword"))
    return by.agg(F.min(case).alias(case), F.max(case).alias("_last")).where(f"{case} = _last").drop("_last")


def case_stats(suggestions: DataFrame, case: str) -> DataFrame:
    """Raw and distinct keywords of each case, and those unique to it."""
    raw = suggestions.groupBy(case).agg(F.count("*").alias("n_raw"), F.count_distinct(F.lower(F.trim("keyword"))).alias("n_distinct"))
    own = unique_to(suggestions, case).groupBy(case).agg(F.count("*").alias("n_unique"))
    return raw.join(own, case, "left").fillna(0, ["n_unique"])


def active_letters(log: DataFrame, least: int = 10) -> DataFrame:
    """(seed_id, letter) of letters whose simple probe gave enough results."""
    return log.groupBy("seed_id", "letter").agg(F.max("n_results").alias("_n")).where(F.col("_n") >= least).select("seed_id", "letter")


def candidate_words(kw: DataFrame, gazetteer: DataFrame, least: int = 2, letters: str = "а-яёіїєґ") -> DataFrame:
    """Words of four letters or more that stand in enough keywords and are neither the seed's nor places."""
    w = kw.select("seed_id", "keyword", F.explode(F.array_distinct(X.words("keyword"))).alias("word"), X.words("seed").alias("_sw"))
    w = w.where(F.col("word").rlike(f"^[{letters}]{{4,}}$") & ~F.array_contains("_sw", F.col("word")))
    counts = w.groupBy("seed_id", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(gazetteer.select(F.lower("name").alias("word")).distinct(), "word", "left_anti")


def novelty_cutoff(fp: DataFrame, least: int = 2) -> DataFrame:
    """fp: (seed_id, batch, fp), earlier phases as batch -1. The batches up to the first that adds fewer than least new fingerprints."""
    new = fp.groupBy("seed_id", "fp").agg(F.min("batch").alias("batch")).groupBy("seed_id", "batch").agg(F.count("*").alias("n"))
    all_batches = fp.select("seed_id", "batch").where("batch >= 0").distinct()
    added = all_batches.join(new, ["seed_id", "batch"], "left").fillna(0, ["n"])
    stop = added.groupBy("seed_id").agg(F.min(F.when(F.col("n") < least, F.col("batch"))).alias("stop"))
    return added.join(stop, "seed_id").where("stop is null or batch <= stop").select("seed_id", "batch", F.col("n").alias("n_new"))


def merge_families(suggestions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row per seed and keyword in lower case; the last family's display form wins, and families are listed."""
    rank = F.array_position(F.array(*(F.lit(f) for f in order)), F.col("family"))
    rows = suggestions.withColumn("key", X.norm("keyword")).where("key <> ''")
    return rows.groupBy("seed_id", "key").agg(
        F.max_by("keyword", F.struct(rank, "seq", "keyword")).alias("keyword"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families")
    )


def family_counts(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode(F.split("families", ",")).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


def keep_relevant(kw: DataFrame, anchors: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Both sets after a filter that runs once over their union."""
    kept = keep(kw.select("seed_id", "seed", "keyword").union(anchors.select("seed_id", "seed", "keyword")).distinct())
    ids = kept.select("seed_id", "keyword")
    return kw.join(ids, ["seed_id", "keyword"], "left_semi"), anchors.join(ids, ["seed_id", "keyword"], "left_semi")
