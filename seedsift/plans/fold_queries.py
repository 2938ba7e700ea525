"""Queries of the folding operators over the projected log, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import fold
from seedsift.sources import tables as S
from seedsift.sources.tables import PROJECTION

_LOG = """log as (select event_id as seq, user_id % 20 as seed_id, event_type as struct, case when k % 2 = 0 then 'one' else 'two' end as agent, chr((97 + k % 26)::int) as letter, k % 4 as gap,
  case when k % 10 = 9 then 429 when k % 17 = 3 then 0 when k % 23 = 5 then 503 else 200 end as http_status, k % 13 as n_results, value as time_ms, ts,
  'word' || (k % 40) || ' ' || case when k % 3 = 0 then 'Alpha' else 'beta' end as keyword, ['suffix', 'prefix', 'infix'][k % 3 + 1] as family, (user_id + k) % 6 as batch
  from (select *, json_extract(props, '$.k')::bigint as k from events))"""
_SUGG = _LOG + ", sugg as (select * from log where n_results > 0)"


def _q(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"


def _sugg(spark, sf):
    return S.fetch_log(spark, sf).where("n_results > 0")


def _yield(*keys):
    return lambda spark, sf: fold.yield_by(S.fetch_log(spark, sf), *keys)


_YIELD = "count(*) as sent, count(*) filter (n_results > 0) as with_results, count(*) filter (n_results = 0) as empty, sum(n_results)::bigint as suggestions, round(avg(time_ms), 3) as avg_ms from log group by"


def rollup_yield(spark, sf):
    return S.fetch_log(spark, sf).rollup("family", "struct").agg(F.count("*").alias("sent"), F.sum("n_results").alias("suggestions"))


def _kw(spark, sf):
    return S.keywords(spark, sf)


def garbage(spark, sf):
    k = _kw(spark, sf)
    return k.groupBy("seed_id").agg(
        F.count_if(fold.garbage_suffix("keyword", "seed")).alias("n_suffix"), F.count_if(fold.garbage_basic("keyword")).alias("n_basic"),
        F.count_if(fold.letter_artifact("keyword", "seed")).alias("n_artifact"), F.count("*").alias("n"),
    )


def alt_seeds(spark, sf):
    return fold.alt_seed(_kw(spark, sf)).groupBy("seed_id").agg(F.count_if("alt_seed").alias("n_alt"))


def candidates(spark, sf):
    return fold.candidate_words(_kw(spark, sf), S.gazetteer(spark, sf), 2, "a-z")


def novelty(spark, sf):
    log = S.fetch_log(spark, sf)
    fp = log.select("seed_id", F.col("batch").cast("int").alias("batch"), X.fingerprint("keyword").alias("fp"))
    return fold.novelty_cutoff(fp, 12)


def merged(spark, sf):
    return fold.merge_families(_sugg(spark, sf), S.FAMILIES)


def kept_relevant(spark, sf):
    k = _kw(spark, sf)
    from seedsift.operators.clean import relevant

    a, b = fold.keep_relevant(k.where("pos % 2 = 0").select("seed_id", "seed", "keyword"), k.where("pos % 2 = 1").select("seed_id", "seed", "keyword"), relevant)
    return a.withColumn("side", F.lit("keywords")).union(b.withColumn("side", F.lit("anchors"))).groupBy("side").agg(F.count("*").alias("n"))


QUERIES = {
    "fold_keywords": (lambda s, d: fold.fold_keywords(_sugg(s, d)), _q(_SUGG, "select seed_id, keyword, count(*) as weight, string_agg(distinct agent || ':' || struct, ',' order by agent || ':' || struct) as sources from sugg group by all")),
    "exclusive_keywords": (lambda s, d: fold.exclusive_keywords(_sugg(s, d)), _q(_SUGG, "select seed_id, lower(keyword) as keyword, min(struct) as struct from sugg group by 1, 2 having count(distinct struct) = 1")),
    "alt_seed": (alt_seeds, f"with {PROJECTION} select seed_id, count(*) filter (not contains(lower(keyword), lower(seed))) as n_alt from keywords group by 1"),
    "fetch_status": (lambda s, d: fold.status_counts(S.fetch_log(s, d)), _q(_LOG, "select case when http_status = 0 then 'timeout' when http_status in (403, 429) then 'blocked' when http_status <> 200 then 'http_' || http_status when n_results > 0 then 'ok' else 'empty' end as status, count(*) as n from log group by 1")),
    "yield_by_type": (_yield("struct"), _q(_LOG, f"select struct, {_YIELD} struct")),
    "yield_by_gap": (_yield("gap"), _q(_LOG, f"select gap, {_YIELD} gap")),
    "yield_rollup": (rollup_yield, _q(_LOG, "select family, struct, count(*) as sent, sum(n_results)::bigint as suggestions from log group by rollup(family, struct)")),
    "yield_by_group": (lambda s, d: fold.yield_by_group(_sugg(s, d), ("one", "two")), _q(_SUGG, """, x as (select lower(keyword) as k, seed_id, min(struct) as struct from sugg group by 1, 2 having count(distinct struct) = 1)
 select struct, count(distinct (seed_id, lower(keyword))) as n_distinct, (select count(*) from x where x.struct = sugg.struct) as n_exclusive,
 count(distinct (seed_id, lower(keyword))) filter (agent = 'one') as one, count(distinct (seed_id, lower(keyword))) filter (agent = 'two') as two from sugg group by struct""")),
    "last_by_label": (lambda s, d: fold.last_by_label(S.fetch_log(s, d)), _q(_LOG, "select struct, letter, max(seq) as seq, arg_max(n_results, seq) as n_results, arg_max(http_status, seq) as http_status from log group by 1, 2")),
    "stage_stats": (lambda s, d: fold.stage_stats(S.fetch_log(s, d)), _q(_LOG, "select struct, count(*) as requests, epoch_us(max(ts)) - epoch_us(min(ts)) as wall_us, round(sum(time_ms), 2) as sum_ms, round(avg(time_ms), 3) as avg_ms, round(count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) as per_s from log group by 1")),
    "unique_to_case": (lambda s, d: fold.unique_to(_sugg(s, d), "family"), _q(_SUGG, "select lower(keyword) as keyword, min(family) as family from sugg group by 1 having count(distinct family) = 1")),
    "unique_in_case": (lambda s, d: fold.unique_to(_sugg(s, d), "letter", ("struct",)), _q(_SUGG, "select struct, lower(keyword) as keyword, min(letter) as letter from sugg group by 1, 2 having count(distinct letter) = 1")),
    "case_stats": (lambda s, d: fold.case_stats(_sugg(s, d), "letter"), _q(_SUGG, ", u as (select min(letter) as letter from sugg group by lower(keyword) having count(distinct letter) = 1) select letter, count(*) as n_raw, count(distinct lower(keyword)) as n_distinct, (select count(*) from u where u.letter = sugg.letter) as n_unique from sugg group by letter")),
    "active_letters": (lambda s, d: fold.active_letters(S.fetch_log(s, d)), _q(_LOG, "select seed_id, letter from log group by 1, 2 having max(n_results) >= 10")),
    "garbage_keywords": (garbage, f"with {PROJECTION}" + r""" , x as (select *, list_filter(string_split_regex(keyword, '\s+'), lambda w: w <> '') as w, string_split(lower(seed), ' ') as sw from keywords)
 select seed_id, count(*) filter (len(list_filter(w, lambda y: regexp_matches(y, '^[-*|~%!:^@#$&+=]+$') or regexp_matches(y, '^[A-Za-z]$'))) > 0
   or (len(list_filter(w, lambda y: not list_contains(sw, lower(y)))) > 0 and len(list_filter(w, lambda y: not list_contains(sw, lower(y)) and regexp_matches(y, '^[A-Za-z]{4,}$'))) = 0)) as n_suffix,
 count(*) filter (regexp_matches(keyword, '[*:|&]') or len(list_filter(w, lambda y: regexp_matches(y, '^[A-Za-z]$'))) > 0) as n_basic, 0::bigint as n_artifact, count(*) as n from x group by seed_id"""),
    "candidate_words": (candidates, f"with {PROJECTION}" + """, w as (select seed_id, unnest(list_distinct(list_filter(string_split_regex(lower(keyword), '\\s+'), lambda x: regexp_matches(x, '^[a-z]{4,}$') and not list_contains(string_split(seed, ' '), x)))) as word from keywords)
 select seed_id, word, count(*) as n from w where word not in (select name from gazetteer) group by 1, 2 having count(*) >= 2"""),
    "novelty_cutoff": (novelty, _q(_LOG, """, f as (select distinct seed_id, batch::int as batch, array_to_string(list_sort(list_distinct(string_split(lower(keyword), ' '))), '|') as fp from log),
 m as (select seed_id, fp, min(batch) as batch from f group by 1, 2), b as (select distinct seed_id, batch from f),
 n as (select b.seed_id, b.batch, count(m.fp) as n from b left join m using (seed_id, batch) group by 1, 2),
 s as (select seed_id, min(batch) filter (n < 12) as stop from n group by 1)
 select seed_id, batch, n as n_new from n join s using (seed_id) where stop is null or batch <= stop""")),
    "merge_families": (merged, _q(_SUGG, "select seed_id, lower(keyword) as key, arg_max(keyword, list_position(['suffix', 'prefix', 'infix'], family)::bigint * 1000000000 + seq) as keyword, string_agg(distinct family, ',' order by family) as families from sugg group by 1, 2")),
    "family_counts": (lambda s, d: fold.family_counts(merged(s, d)), _q(_SUGG, ", m as (select distinct seed_id, lower(keyword), family from sugg) select family, count(*) as n from m group by 1")),
    "keep_relevant": (kept_relevant, f"with {PROJECTION}" + """ select case when pos % 2 = 0 then 'keywords' else 'anchors' end as side, count(*) as n from keywords
 where len(list_filter(list_filter(string_split(seed, ' '), lambda w: length(w) > 3), lambda w: contains(lower(keyword), substr(w, 1, least(4, length(w) - 1))))) > 0 group by 1"""),
}
