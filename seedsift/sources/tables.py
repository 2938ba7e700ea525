"""Seeds, keywords and dictionaries as tables, read from files or derived from the star schema's tables.

The star schema holds no search keywords, so a fixed projection makes them: part names are seeds, and each
line item is one keyword in one of ten shapes. PROJECTION has the same in SQL, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions import text as X

FAMILIES = ("suffix", "prefix", "infix")

PROJECTION = """
seeds as (select min(p_partkey)::bigint as seed_id, p_name as seed from part group by p_name),
brands as (select distinct lower(p_brand) as name from part),
gazetteer as (select lower(n_name) as name, r_name as country from nation join region on n_regionkey = r_regionkey),
keywords as (select s.seed_id, s.seed, l_orderkey * 10 + l_linenumber as pos,
  case when l_suppkey % 2 = 0 then upper(k) else k end as keyword, ['suffix', 'prefix', 'infix'][l_linenumber % 3 + 1] as family
  from (select l.*, p_name, case (l_orderkey + l_linenumber) % 10
      when 0 then p_name || ' ' || lower(p_type) when 1 then lower(n_name) || ' ' || p_name when 2 then p_name || ' ' || p_size || ' mm'
      when 3 then p_name || ' ' || p_name when 4 then p_name || '  ' || lower(p_brand) when 5 then p_name || ' ' || lower(p_type) || ' ' || lower(p_type)
      when 6 then p_name || ' a' when 7 then p_name || ' ***' when 8 then p_name || ' ' || (38000000 + l_orderkey)::varchar
      else lower(p_brand) || ' ' || p_name || ' ' || lower(n_name) end as k
    from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) x
  join seeds s on s.seed = x.p_name)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, seed): distinct part names; the id is the smallest part's."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("seed")).agg(F.min("p_partkey").cast("long").alias("seed_id")).select("seed_id", "seed")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name")).distinct()


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, country): nations as places, regions as their countries."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.lower("n_name").alias("name"), F.col("r_name").alias("country"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, seed, pos, keyword, family), one row for each line item."""
    item, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    wide = (
        item.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    n, kind, brand, place = F.col("p_name"), F.lower("p_type"), F.lower("p_brand"), F.lower("n_name")
    shapes = [
        (n, kind), (place, n), (n, F.col("p_size").cast("string"), F.lit("mm")), (n, n), (n, F.lit(""), brand),
        (n, kind, kind), (n, F.lit("a")), (n, F.lit("***")), (n, (F.lit(38000000) + F.col("l_orderkey")).cast("string")),
    ]
    pick = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    text = F.when(pick == 0, F.concat_ws(" ", *shapes[0]))
    for i, parts in enumerate(shapes[1:], 1):
        text = text.when(pick == i, F.concat_ws(" ", *parts))
    text = text.otherwise(F.concat_ws(" ", brand, n, place))
    # Settled: the text's branches stand in the plan once, however often later columns and filters read the keyword.
    wide = wide.withColumn("_text", X.settled(text))
    text = F.col("_text")
    rows = wide.select(
        n.alias("seed"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"),
        X.settled(F.when(F.col("l_suppkey") % 2 == 0, F.upper(text)).otherwise(text)).alias("keyword"),
        F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("family"),
    )
    return rows.join(seeds(spark, sf_dir), "seed").select("seed_id", "seed", "pos", "keyword", "family")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of probes, from the events: (seq, seed_id, struct, agent, letter, gap, http_status, n_results, time_ms, ts, keyword, family, batch)."""
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    """The same projection for a batch or a stream of events."""
    e = events.withColumn("k", F.from_json("props", "k long")["k"])
    k, user = F.col("k"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("seq"),
        (user % 20).alias("seed_id"),
        F.col("event_type").alias("struct"),
        F.when(k % 2 == 0, "one").otherwise("two").alias("agent"),
        F.char(97 + k % 26).alias("letter"),
        (k % 4).alias("gap"),
        F.when(k % 10 == 9, 429).when(k % 17 == 3, 0).when(k % 23 == 5, 503).otherwise(200).alias("http_status"),
        (k % 13).alias("n_results"),
        F.col("value").alias("time_ms"),
        "ts",
        F.concat(F.lit("word"), (k % 40).cast("string"), F.when(k % 3 == 0, " Alpha").otherwise(" beta")).alias("keyword"),
        F.element_at(F.array(*map(F.lit, FAMILIES)), (k % 3 + 1).cast("int")).alias("family"),
        ((user + k) % 6).alias("batch"),
    )
