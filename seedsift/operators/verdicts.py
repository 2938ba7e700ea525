"""Verdicts that a language model gave elsewhere: prompts out, replies in, keywords routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.sources.shared import written


def make_batches(kw: DataFrame, n: int = 20) -> DataFrame:
    """(seed_id, bucket, batch, size, prompt): numbered lists of up to n keywords, in the order of a seed's keywords; all of a seed are bucket 0.

    Keywords are dealt by ranges of their order, and each range is numbered from the count of those before it, so that
    numbering needs no single task for a seed that owns most rows.
    """
    dealt = written(kw.select("seed_id", "keyword").where("keyword is not null").repartitionByRange("seed_id", "keyword").withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy("seed_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("seed_id", "_range").agg(F.count("*").alias("_n")).select("seed_id", "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("seed_id", "_range").orderBy("keyword")) - 1
    placed = dealt.withColumn("_at", place).join(starts, ["seed_id", "_range"]).withColumn("_at", F.col("_at") + F.col("_start"))
    cut = placed.groupBy("seed_id", F.expr(f"cast(_at div {n} as int)").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_at", "keyword"))).alias("k"))
    lines = F.array_join(F.transform("k", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["keyword"])), "\n")
    return cut.select("seed_id", F.lit(0).cast("long").alias("bucket"), "batch", F.size("k").alias("size"), lines.alias("prompt"))


def parse_labels(reply, n) -> Column:
    """The first line's comma-separated 0 and 1 as an array of length n; anything else, and what is missing, is null."""
    line = F.regexp_replace(F.get(F.split(F.coalesce(reply, F.lit("")), "\n"), F.lit(0)), r"[^\p{Nd}, ]", "")
    parts = F.filter(F.transform(F.split(line, ","), lambda p: F.trim(p)), lambda p: p != "")
    labels = F.transform(parts, lambda p: F.when(p.rlike("^0*[01]$"), p.cast("int")))
    return F.slice(F.concat(labels, F.array_repeat(F.lit(None).cast("int"), n)), F.lit(1), n)


def labels_table(replies: DataFrame) -> DataFrame:
    """(batch_id, i, verdict) of every place of every batch. replies: (batch_id, n, reply)."""
    return replies.select("batch_id", F.posexplode(parse_labels(F.col("reply"), F.col("n"))).alias("i", "verdict"))


def route(kw: DataFrame, verdicts: DataFrame, keys: list[str], missing: str) -> DataFrame:
    """Adds label: 1 is VALID, 0 is TRASH, and missing says what becomes of no verdict."""
    label = F.when(F.col("verdict") == 1, "VALID").when(F.col("verdict") == 0, "TRASH").otherwise(missing)
    return kw.join(verdicts.select(*keys, "verdict"), keys, "left").withColumn("label", label)


def apply_verdict_grey(kw, verdicts, keys):
    """For grey keywords: without a verdict they stay grey."""
    return route(kw, verdicts, keys, "GREY")


def apply_verdict_valid(kw, verdicts, keys):
    """For valid keywords: without a verdict they stay valid."""
    return route(kw, verdicts, keys, "VALID")


def merge_fork(valid: DataFrame, grey: DataFrame) -> DataFrame:
    """Both branches' rows with the branch's name: kept and promoted keywords, and anchors."""
    return valid.withColumn("branch", F.lit("valid")).unionByName(grey.withColumn("branch", F.lit("grey")))


def verdict_cost(log: DataFrame, price_in: str, price_out: str) -> DataFrame:
    """Calls, tokens and cost in exact decimals. log: (stage, tokens_in, tokens_out)."""
    cost = lambda c, p: F.col(c).cast("decimal(20,0)") * F.lit(p).cast("decimal(12,6)") / F.lit(1_000_000)
    return log.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(cost("tokens_in", price_in)) + F.sum(cost("tokens_out", price_out)), 6).cast("double").alias("cost"),
    )
