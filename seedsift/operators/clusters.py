"""Clusters of payloads from landed replies, and reports on payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from seedsift.functions import text as X

CHUNK = 185


def chunk(payloads: DataFrame, order: str = "id", size: int = CHUNK) -> DataFrame:
    """Adds chunk and the id inside it to rows with a running number."""
    return payloads.withColumn("chunk", F.floor(F.col(order) / size)).withColumn("local_id", F.col(order) % size + 1)


#: What a search without a place or language is about.
REGION, LANGUAGE = "Украина", "русский"


def cluster_inputs(results: DataFrame) -> DataFrame:
    """(seed, keyword, region, language), one row for each keyword of rows (seed, keywords array<string>, region, language). A row without seed or keywords is an error."""
    asked = F.assert_true(F.coalesce(F.col("seed") != "", F.lit(False)), "seed missing"), F.assert_true(F.coalesce(F.size("keywords") > 0, F.lit(False)), "keywords missing or empty")
    checked = results.withColumn("_checked", F.struct(*(a.isNull().alias(f"c{i}") for i, a in enumerate(asked)))).where("_checked.c0 and _checked.c1")
    return checked.select("seed", F.explode("keywords").alias("keyword"), F.coalesce("region", F.lit(REGION)).alias("region"), F.coalesce("language", F.lit(LANGUAGE)).alias("language"))


def validate_payloads(p: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Per seed: payloads, empty ones, those of one and of up to two characters, and those with a seed word. p: (seed_id, seed, payload, n_keywords)."""
    leaked = F.arrays_overlap(X.words("payload"), X.words("seed"))
    return p.groupBy("seed_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("payload") == "").alias("n_empty"), F.count_if(F.length("payload") == 1).alias("n_one"),
        F.count_if(F.length("payload").between(1, 2)).alias("n_short"), F.count_if(leaked).alias("n_leaked"),
    )


def length_histogram(p: DataFrame) -> DataFrame:
    return p.groupBy("seed_id", F.size(X.words("payload")).alias("n_words")).agg(F.count("*").alias("n"))


def top_payloads(p: DataFrame, k: int = 15) -> DataFrame:
    """The k payloads of each seed with the most keywords (a report), by rank, which Spark limits before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("n_keywords"), F.desc("payload")))
    return p.withColumn("rank", rank - 1).where(F.col("rank") < k).select("seed_id", "rank", "payload", "n_keywords")


def _pairs(reply: Column) -> Column:
    """Comma-separated pairs; a comma inside brackets does not separate."""
    flat = F.regexp_replace(F.regexp_replace(reply, r"^\s*```\w*|```\s*$", ""), r"[\r\n]", "")
    return F.transform(F.regexp_extract_all(flat, F.lit(r"((?:[^,()]|\([^()]*\))+)"), 1), lambda x: F.trim(x))


def parse_assignments(replies: DataFrame) -> DataFrame:
    """(chunk, local_id, code, name, problem) of replies like '1:A(name),2:B'.

    A code's name is the first one given with it; of an id's pairs the first counts. problem: bad_pair, duplicate_id
    or unknown_code, else null.
    """
    pairs = replies.select("chunk", F.posexplode(_pairs(F.col("reply"))).alias("i", "pair"))
    parts = pairs.select(
        "chunk", "i", F.regexp_extract("pair", r"^\s*(\d+)\s*:", 1).alias("id"), F.regexp_extract("pair", r"^\s*\d+\s*:\s*([A-Z]+)\s*(?:\(|$)", 1).alias("code"), F.trim(F.regexp_extract("pair", r"\(([^()]*)\)\s*$", 1)).alias("given")
    )
    good = parts.where("id <> '' and code <> ''")
    bad = parts.where("id = '' or code = ''").select("chunk", F.lit(None).cast("int").alias("local_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name"), F.lit("bad_pair").alias("problem"))
    legend = good.where("given <> ''").groupBy("chunk", "code").agg(F.min_by("given", "i").alias("name"))
    first = good.groupBy("chunk", "id").agg(F.min(F.struct("i", "code"))["code"].alias("code"), F.count("*").alias("_n"))
    named = first.join(legend, ["chunk", "code"], "left")
    problem = F.when(F.col("name").isNull(), "unknown_code").when(F.col("_n") > 1, "duplicate_id")
    return named.select("chunk", F.col("id").cast("int").alias("local_id"), "code", "name", problem.alias("problem")).unionByName(bad)


def remap_clusters(assigned: DataFrame, names: DataFrame, size: int = CHUNK) -> DataFrame:
    """Global ids, and names with their chunk's prefix mapped to merged ones where there is one. names: (name, merged)."""
    own = F.concat(F.lit("c"), F.col("chunk").cast("string"), F.lit("_"), F.col("name"))
    rows = assigned.where("name is not null").select((F.col("chunk") * size + F.col("local_id") - 1).alias("id"), own.alias("_own"))
    return rows.join(names.select(F.col("name").alias("_own"), "merged"), "_own", "left").select("id", F.coalesce("merged", "_own").alias("cluster"))


def expand_clusters(assigned: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every payload with its cluster; UNASSIGNED where it has none. payloads: (id, ...)."""
    return payloads.join(assigned, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit("UNASSIGNED")))


def cluster_metrics(clusters: DataFrame) -> DataFrame:
    """Clusters, payloads, the largest cluster's share and the unassigned, in one row."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count_if(F.col("cluster") != "UNASSIGNED").alias("n_clusters"), F.sum("n").alias("n_payloads"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"),
        F.coalesce(F.sum(F.when(F.col("cluster") == "UNASSIGNED", F.col("n"))), F.lit(0)).alias("n_unassigned"),
    )
