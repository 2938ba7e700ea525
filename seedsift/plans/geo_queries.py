"""Queries of dictionaries and geography, with SQL that gives the same rows.

Nations stand for cities: each has an alternate name that it shares with others, the balance of its suppliers
as population, and its region as country. Each brand is a district of a nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.operators import geo
from seedsift.sources import dictionaries as D
from seedsift.sources import tables as S
from seedsift.sources.tables import PROJECTION

TARGET = "asia"


def _cities(spark, sf):
    nation, region, supplier = (S.table(spark, sf, t) for t in ("nation", "region", "supplier"))
    size = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.sum("s_acctbal")).cast("long").alias("population"))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).join(size, "n_nationkey", "left")
    alt = F.array(F.concat(F.lit("Town "), F.translate((F.col("n_nationkey") % 7).cast("string"), "0123456", "abcdefg")))
    return rows.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), F.col("r_name").alias("country"), F.coalesce("population", F.lit(0)).alias("population"), alt.alias("alternatenames"))


def _districts(spark, sf):
    part = S.table(spark, sf, "part").select(F.lower("p_brand").alias("name"), F.length("p_brand").alias("l")).distinct()
    return part.select("name", F.concat(F.lit("nation_"), (F.length("name") - 6).cast("string")).alias("city"), F.when(F.col("l") > 7, "ASIA").otherwise("EUROPE").alias("country"))


_CITIES = f"""with {PROJECTION}, sz as (select s_nationkey, round(sum(s_acctbal))::bigint as population from supplier group by 1),
cities as (select n_nationkey::bigint as seq, n_name as name, r_name as country, coalesce(population, 0) as population, 'Town ' || 'abcdefg'[(n_nationkey % 7 + 1)::int] as alt from nation join region on n_regionkey = r_regionkey left join sz on s_nationkey = n_nationkey),
al as (select seq, lower(name) as name, lower(country) as country, population, lower(name) as canonical from cities union all select seq, lower(alt), lower(country), population, lower(name) from cities),
gm as (select name, list_sort(list_distinct(list(country))) as countries from al group by 1),
ds as (select distinct lower(p_brand) as name, 'nation_' || (length(p_brand) - 6) as city, case when length(p_brand) > 7 then 'asia' else 'europe' end as country from part),
kw as (select seed_id, pos as kw_id, lower(keyword) as keyword, string_split_regex(lower(keyword), '\\s+') as w from (select distinct on (seed_id, pos) * from keywords order by seed_id, pos, keyword)),
tk as (select seed_id, kw_id, unnest(w) as term from kw)"""


def _kw(spark, sf):
    """The position leads the keys: strings' minima sort by them, and seeds are few."""
    k = S.keywords(spark, sf).groupBy(F.col("pos").alias("kw_id"), "seed_id").agg(F.min("keyword").alias("keyword"))
    return k


def multi(spark, sf):
    return D.gazetteer_multi(_cities(spark, sf)).select("name", F.array_join("countries", ",").alias("countries"))


def pop(spark, sf):
    return D.gazetteer_pop(_cities(spark, sf))


def geo_filter(spark, sf):
    g = D.gazetteer_multi(_cities(spark, sf))
    return geo.geo_rules(_kw(spark, sf), S.seeds(spark, sf), g, _districts(spark, sf), TARGET)


def own(spark, sf):
    return geo.own_geo(_kw(spark, sf), D.gazetteer_multi(_cities(spark, sf)), TARGET)


def override(spark, sf):
    one = D.gazetteer_one(_cities(spark, sf))
    forced = S.table(spark, sf, "region").select(F.lower("r_name").alias("country"), F.concat(F.lit("nation_"), F.col("r_regionkey").cast("string")).alias("name"))
    return D.gazetteer_override(one, forced, True)


def db(spark, sf):
    return D.geo_db(_cities(spark, sf), _districts(spark, sf)).select("name", F.array_join("countries", ",").alias("countries"))


def dims(spark, sf):
    return D.district_dims(_districts(spark, sf), D.city_canonical(_cities(spark, sf))).select("city", F.array_join("districts", ",").alias("districts"))


def decoded(spark, sf):
    """Bodies in the four forms, around a page's words."""
    p = S.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r'["\\]', "").alias("u"))
    items = F.concat(F.lit('["q",["'), "u", F.lit('",["<b>b</b> '), "u", F.lit('",0],{"query":"x y"}]]'))
    k = F.col("page_id") % 5
    body = F.when(k == 0, items).when(k == 1, F.concat(F.lit(")]}'\n"), items)).when(k == 2, F.concat(F.lit("cb("), items, F.lit(");")))
    body = body.when(k == 3, F.concat(F.lit('{"results":[{"text":"'), "u", F.lit('"},{"text":"t"}]}'))).otherwise(F.concat(F.lit('{"AS":{"Results":[{"Suggests":[{"Txt":"'), "u", F.lit('"},{"Txt":"z"}]}]}}')))
    raw = p.select(F.col("page_id").alias("id"), F.when(k == 3, "results").when(k == 4, "nested").otherwise("list").alias("source"), body.alias("body"))
    return D.decode_suggestions(raw)


def metrics(spark, sf):
    part = S.table(spark, sf, "part")
    m = part.groupBy(F.upper("p_name").alias("keyword")).agg(F.sum("p_size").alias("searches"), F.max("p_type").alias("competition"), F.min(F.col("p_partkey") * 12345).alias("low_micros"), F.max(F.col("p_partkey") * 12345).alias("high_micros"))
    return D.with_metrics(S.seeds(spark, sf).withColumnRenamed("seed", "keyword"), m).select("seed_id", "keyword", "searches", "competition", F.col("low_bid").cast("double").alias("low_bid"), F.col("high_bid").cast("double").alias("high_bid"))


def found(spark, sf):
    out = geo.find_terms(_kw(spark, sf), S.brands(spark, sf))
    return out.select("seed_id", "kw_id", F.array_join("found", ",").alias("found"))


QUERIES = {
    "gazetteer_multi": (multi, _CITIES + " select name, array_to_string(countries, ',') as countries from gm"),
    "gazetteer_one": (lambda s, d: D.gazetteer_one(_cities(s, d)), _CITIES + " select name, arg_min(country, k) as country from (select lower(name) as name, lower(country) as country, -seq as k from cities union all select lower(alt), lower(country), 1000000 + seq from cities) group by 1"),
    "gazetteer_pop": (pop, _CITIES + ", f as (select distinct seq, population, country, unnest([name, replace(name, ' ', '-')]) as name from al where population >= 1000) select name, arg_max(country, population * 1000 - seq) as country, max(population) as population from f group by 1"),
    "gazetteer_override": (override, _CITIES + ", o as (select name, arg_min(country, k) as country from (select lower(name) as name, lower(country) as country, -seq as k from cities union all select lower(alt), lower(country), 1000000 + seq from cities) group by 1), f as (select 'nation_' || r_regionkey as name, lower(r_name) as country from region) select coalesce(f.name, o.name) as name, coalesce(f.country, o.country) as country from o full join f on f.name = o.name"),
    "city_canonical": (lambda s, d: D.city_canonical(_cities(s, d)), _CITIES + " select name, arg_max(canonical, population * 1000 - seq) as canonical from al group by 1"),
    "geo_db": (db, _CITIES + " select name, string_agg(distinct upper(country), ',' order by upper(country)) as countries from (select lower(name) as name, country from cities union all select name, country from ds) group by 1"),
    "district_dims": (dims, _CITIES + ", cn as (select name, arg_max(canonical, population * 1000 - seq) as canonical from al group by 1) select coalesce(canonical, city) as city, string_agg(distinct ds.name, ',' order by ds.name) as districts from ds left join cn on cn.name = ds.city group by 1"),
    "geo_filter": (geo_filter, _CITIES + """, h as (select seed_id, kw_id, 2 as r, 'foreign_city:' || term as reason from tk join gm on gm.name = term where not list_contains(countries, 'asia')
 union all select seed_id, kw_id, 3, 'foreign_district:' || term from tk join ds on ds.name = term where country <> 'asia') select seed_id, kw_id, (list(reason order by r, reason))[1] as reason from h group by 1, 2"""),
    "geo_rule_counts": (lambda s, d: geo.rule_counts(geo_filter(s, d)), _CITIES + """, h as (select seed_id, kw_id, 2 as r from tk join gm on gm.name = term where not list_contains(countries, 'asia')
 union all select seed_id, kw_id, 3 from tk join ds on ds.name = term where country <> 'asia'), m as (select seed_id, kw_id, min(r) as r from h group by 1, 2) select case r when 2 then 'foreign_city' else 'foreign_district' end as rule, count(*) as n from m group by 1"""),
    "own_geo": (own, _CITIES + " select distinct seed_id, kw_id, term from tk join gm on gm.name = term where list_contains(countries, 'asia')"),
    "find_terms": (found, _CITIES + " select seed_id, kw_id, string_agg(distinct term, ',' order by term) as found from tk where term in (select name from brands) group by 1, 2"),
    "decode_suggestions": (decoded, """with p as (select page_id as id, regexp_replace(url, '["\\\\]', '', 'g') as u, page_id % 5 as k from pages)
 select id, 0::int as i, u as suggestion from p union all select id, 1::int, case when k < 3 then 'b ' || u when k = 3 then 't' else 'z' end from p union all select id, 2::int, 'x y' from p where k < 3"""),
    "with_metrics": (metrics, f"with {PROJECTION}, m as (select p_name as k, sum(p_size)::bigint as searches, max(p_type) as competition, min(p_partkey * 12345) as lo, max(p_partkey * 12345) as hi from part group by 1) select seed_id, seed as keyword, searches, competition, lo / 1000000.0 as low_bid, hi / 1000000.0 as high_bid from seeds join m on k = seed"),
}
