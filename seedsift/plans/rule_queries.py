"""Queries of rules, detectors and helpers over tables that make each of them say both yes and no, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import clean, clusters, detectors, expand, fold, geo, morphology, tails
from seedsift.plans import form_queries as FQ
from seedsift.plans import place_queries as PQ
from seedsift.plans.expand_queries import _PROBES, _SEEDS
from seedsift.plans.expand_queries import _seeds as expand_seeds
from seedsift.plans.keyword_queries import _PRE, _with
from seedsift.plans.place_queries import _cy, cyrillic
from seedsift.plans.seed_queries import _SOUND
from seedsift.plans.word_queries import _STEM
from seedsift.sources import tables as S
from seedsift.sources.shared import written


def _kw(spark, sf):
    return PQ._keywords(spark, sf).select("seed_id", F.col("keyword").alias("kw_id"), "keyword").distinct()


def geo_rules(spark, sf):
    """All six rules, with places, districts and countries in any case form."""
    part = PQ._parts(spark, sf)
    listed = part.where("length(n2) = 3").select(cyrillic("n2").alias("name")).distinct()
    short = part.where("length(n1) = 3").select(cyrillic("n1").alias("name"), F.lit("europe").alias("country")).distinct()
    args = {"blocklist": listed, "lexicon": written(PQ._lexicon(spark, sf)), "countries": PQ._countries(spark, sf), "abbreviations": short}
    out = geo.geo_rules(written(_kw(spark, sf)), PQ._seeds(spark, sf), written(PQ._geo(spark, sf)), PQ._districts(spark, sf), PQ.TARGET, **args)
    return out.select("seed_id", F.col("kw_id").alias("keyword"), "reason")


def placeless(spark, sf):
    return geo.without_seed_place(written(_kw(spark, sf)), PQ._seeds(spark, sf), written(PQ._geo(spark, sf))).select("seed_id", "keyword")


def fingerprints(spark, sf):
    kw = FQ._kw(spark, sf).where("seed_id % 2 = 1").withColumn("kw_id", F.col("keyword"))
    places = FQ._base(spark, sf).where("length(w) = 5").select(cyrillic("w").alias("name"))
    return morphology.intent_fingerprint(kw, written(FQ._lexicon(spark, sf)), places).select("seed_id", F.col("kw_id").alias("keyword"), "fp")


def nominatives(spark, sf):
    return morphology.normalize_nominative(FQ._kw(spark, sf).where("seed_id % 2 = 1"), written(FQ._lexicon(spark, sf)))


def retailer_signals(spark, sf):
    kw = tails.extract_tail(clean.dedupe_first(S.keywords(spark, sf)))
    pairs = written(kw.select("seed_id", "seed", "tail").where("tail <> ''").distinct())
    size = F.length("name")
    shops = S.table(spark, sf, "part").select(F.lower("p_type").alias("name")).distinct().unionByName(S.table(spark, sf, "region").select(F.lit("nation").alias("name")).distinct())
    shops = shops.withColumn("countries", F.when(size == 5, F.array(F.lit("*"))).when(size == 6, F.array(F.lit("europe"))).otherwise(F.array(F.lit("asia"))))
    fired = detectors.signals(detectors.dictionary_hits(pairs, S.gazetteer(spark, sf), S.brands(spark, sf), "ASIA", shops), None, ["retailer", "retailer_foreign"])
    return fired.select("seed_id", "tail", F.array_join(F.concat("positive", "negative"), ",").alias("signals"))


def sides(spark, sf):
    return tails.extract_tail(clean.dedupe_first(S.keywords(spark, sf))).select("seed_id", "pos", tails.side().alias("side"))


def numbers(spark, sf):
    seeds = expand_seeds(spark, sf)
    some = seeds.withColumn("seed", F.when(F.col("seed_id") % 2 == 0, F.concat("seed", F.lit(" 7"))).otherwise(F.col("seed")))
    return expand.expand_numbers(expand.analyze_seeds(some.select("seed_id", "seed")), spark).select("seed_id", "query", "cp")


def chunks(spark, sf):
    part = S.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return clusters.chunk(part).select("id", F.col("chunk").cast("long").alias("chunk"), F.col("local_id").cast("long").alias("local_id"))


def spelled(spark, sf):
    """Words of one script against changed words of the other."""
    base = FQ._base(spark, sf)
    forms = base.select(F.explode(F.array(cyrillic("w"), F.concat(cyrillic("w"), F.lit("ник")), cyrillic(F.reverse("w")))).alias("b"))
    pairs = base.withColumn("k", F.length("w") % 2).join(forms.withColumn("k", F.length("b") % 2), "k").select(F.col("w").alias("a"), "b").distinct()
    return pairs.select("a", "b", F.expr(tails.cross_script("a", "b")).alias("alike"))


def lemma_sets(spark, sf):
    w, size = F.col("w"), F.length("w")
    low = F.when(F.ascii(w) % 2 == 0, 0.95).otherwise(0.85)
    rows = FQ._base(spark, sf).select(F.explode(F.array(F.struct(w.alias("word"), w.alias("lemma"), (size / 10.0).alias("score")), F.struct(w.alias("word"), F.concat(w, F.lit("a")).alias("lemma"), (size / 10.0 * low).alias("score")))).alias("r")).select("r.*")
    return morphology.top_lemmas(rows).select("word", F.array_join("lemmas", ",").alias("lemmas"))


def artifacts(spark, sf):
    kw = S.table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("seed"), F.lower("p_type").alias("ty"))
    k = F.col("p_partkey") % 5
    middle = F.when(k == 0, "x").when(k == 1, "- y").when(k == 2, "xx").when(k == 3, "i").otherwise("-")
    text = F.concat_ws(" ", "seed", middle, F.when(F.col("p_partkey") % 7 != 0, F.col("ty")))
    return kw.select("p_partkey", text.alias("keyword"), F.coalesce(fold.letter_artifact(text, "seed"), F.lit(False)).alias("artifact"))


def pruned(spark, sf):
    skip = spark.createDataFrame([("suffix", f"{v} *_v{i}") for v in ("в", "купить", "как") for i in (1, 3)], "family string, struct string")
    return expand.expand(expand_seeds(spark, sf), expand.prune_templates(expand.suffix_templates(spark, "ua"), skip)).select("seed_id", "grp", "struct")


def _gram(source: str) -> str:
    """Words, pairs and triples of (seed_id, kw, t) with their forms and neighbours."""
    return f"""(select seed_id, kw, i, n, array_to_string(w[i:i + n - 1], ' ') as term, array_to_string(list_transform(w[i:i + n - 1], lambda x: coalesce(lm[x], x)), ' ') as lterm, array_to_string(list_transform(w[i:i + n - 1], lambda x: st[x]), ' ') as sterm, w[i - 1] as before, w[i + n] as after
  from (select *, unnest(range(1, len(w) + 1)) as i from (select seed_id, kw, string_split(t, ' ') as w from {source})), (values (1), (2), (3)) ns(n), fm where i + n - 1 <= len(w))"""


_BASE = (
    PQ._DIMS
    + f""",
vo as (select distinct unnest(string_split(t, ' ')) as x from (select seed as t from sd union select keyword from kr union select name from ge union select name from ds union select name from cn)),
fm as (select map(list(x), list(l)) as lm, map(list(x), list(s)) as st from (select x, (select min(lemma) from lx where lx.word = x) as l, {_STEM.format('x')} as s from vo)),
kg as {_gram("(select distinct seed_id, keyword as kw, keyword as t from kr)")},
sg as {_gram("(select seed_id, '' as kw, seed as t from sd)")},
gs as (select name, countries, array_to_string(list_transform(string_split(name, ' '), lambda x: st[x]), ' ') as sname from ge, fm),
dd as (select ds.*, array_to_string(list_transform(string_split(name, ' '), lambda x: st[x]), ' ') as sname from ds, fm), cc as (select cn.*, array_to_string(list_transform(string_split(name, ' '), lambda x: st[x]), ' ') as sname from cn, fm)"""
)


def _forms(grams: str, dim: str, columns: str, lemmas: bool = True) -> str:
    by_lemma = f" union all select g.*, {columns}, 1 from {grams} g join {dim} d on g.lterm = d.name" if lemmas else ""
    return f"""(select * from (select *, min(form) over (partition by seed_id, kw, i, n) as best from (select g.*, {columns}, 0 as form from {grams} g join {dim} d on g.term = d.name{by_lemma} union all select g.*, {columns}, 2 from {grams} g join {dim} d on g.sterm = d.sname)) where form = best)"""


_NAMED = "(regexp_matches(term, '(ая|ий|ой|ый|ого|ской)$') and coalesce(after in (" + ", ".join(f"'{x}'" for x in geo.STREETS) + "), false)) or coalesce(before in (" + ", ".join(f"'{x}'" for x in geo.COMPLEXES) + "), false)"
_GEO = (
    _BASE
    + f""",
kp as {_forms('kg', 'gs', 'd.name as place, d.countries')}, sp as {_forms('sg', 'gs', 'd.name as place, d.countries')},
sl as (select seed_id, list(distinct place) as places from sp group by 1),
pl as (select seed_id, kw, i, n, term, before, after, list(distinct place) as names, list_distinct(flatten(list(countries))) as countries from kp group by all),
lo as (select *, row_number() over (partition by seed_id, kw, i order by n desc, term desc) as r from pl),
ar as (select x.*, sl.places from {_forms('kg', 'dd', 'd.city, d.country')} x left join sl on sl.seed_id = x.seed_id),
oc as (select seed_id, unnest(countries) as country from sp union select seed_id, country from {_forms('sg', 'cc', 'd.country')}),
h as (select lo.seed_id, kw, 2 as r, 'foreign_city:' || term as reason from lo left join sl on sl.seed_id = lo.seed_id where lo.r = 1 and not list_contains(countries, 'asia') and not coalesce(list_has_any(places, names), false) and not ({_NAMED})
  union all select seed_id, kw, 3, 'foreign_district:' || term from ar where country <> 'asia' union all select seed_id, kw, 4, 'other_district:' || term from ar where country = 'asia' and len(coalesce(places, [])) > 0 and not list_contains(places, city)
  union all select seed_id, kw, 1, 'listed:' || term from kg where term in (select {_cy('n2')} from pt where length(n2) = 3) union all select seed_id, kw, 5, 'abbreviation:' || term from kg where term in (select {_cy('n1')} from pt where length(n1) = 3) and not ({_NAMED})
  union all select x.seed_id, kw, 6, 'country:' || term from {_forms('kg', 'cc', 'd.country')} x where country <> 'asia' and not ({_NAMED}) and not coalesce(before in ('в', 'во', 'из', 'до', 'через', 'на'), false) and not exists (select 1 from oc where oc.seed_id = x.seed_id and oc.country = x.country))
select seed_id, kw as keyword, arg_min(reason, (r, reason)) as reason from h group by 1, 2"""
)
_PLACELESS = (
    _BASE
    + f""",
wa as (select distinct seed_id, place from {_forms('sg', 'gs', 'd.name as place', False)}), fo as (select distinct seed_id, kw, place from {_forms('kg', 'gs', 'd.name as place', False)})
select distinct kr.seed_id, kr.keyword from kr where seed_id in (select seed_id from wa) and not exists (select 1 from fo join wa on wa.seed_id = fo.seed_id and wa.place = fo.place where fo.seed_id = kr.seed_id and fo.kw = kr.keyword)"""
)

_FP = (
    FQ._P
    + FQ._KW
    + f""",
l1 as (select word, min(lemma) as lemma, min(pos) as pos from lx group by 1),
ks as (select * from kw where seed_id % 2 = 1),
se as (select distinct seed_id, coalesce(l1.lemma, w) as lemma from (select seed_id, unnest(regexp_extract_all(lower(seed), '[а-яёa-z0-9]+')) as w from ks) left join l1 on l1.word = w),
to_ as (select distinct t.seed_id, keyword, coalesce(l1.lemma, w) as lemma, pos from (select seed_id, keyword, unnest(regexp_extract_all(lower(keyword), '[а-яёa-z0-9]+')) as w from ks) t left join l1 on l1.word = w),
ke as (select seed_id, keyword, case when lemma in (select {_cy('w')} from bw where length(w) = 5) then '__GEO__' else lemma end as term from to_ where not exists (select 1 from se where se.seed_id = to_.seed_id and se.lemma = to_.lemma))
select ks.seed_id, ks.keyword, coalesce(string_agg(distinct term, '|' order by term), '__EMPTY__') as fp from ks left join ke on ke.seed_id = ks.seed_id and ke.keyword = ks.keyword group by 1, 2"""
)
_NOMN = (
    FQ._P
    + FQ._KW
    + """,
ks as (select *, string_split(lower(keyword), ' ') as w, string_split(seed, ' ')[1] as s from kw where seed_id % 2 = 1),
nn as (select distinct word, lemma, num from lx where pos = 'NOUN' and score >= 0.3)
select distinct seed_id, array_to_string([n.word] || w[2:], ' ') as keyword from ks join nn a on a.word = s join nn f on f.word = w[1] and f.lemma = a.lemma join lx n on n.lemma = f.lemma and n.pos = 'NOUN' and n.cas = 'nomn' and n.num = f.num"""
)
_SHOPS = (
    _PRE
    + """,
pr as (select distinct seed_id, t from (select seed_id, case when q = s then '' else t end as t from pre) where t <> ''),
rt as (select name, case length(name) when 5 then ['*'] when 6 then ['europe'] else ['asia'] end as countries from (select distinct lower(p_type) as name from part union select 'nation')),
wd as (select distinct t, unnest(string_split(t, ' ')) as w from pr),
ma as (select t, 1 as rank, name, countries from wd join rt on name = w union all select t, 2, name, countries from wd join rt on length(name) >= 4 and length(w) >= 5 and starts_with(w, name) and length(w) - length(name) <= 3),
be as (select t, arg_min(countries, (rank, name)) as countries from ma group by 1)
select seed_id, pr.t as tail, case when countries is null then '' when list_has_any(countries, ['*', 'asia']) then 'retailer' else 'retailer,retailer_foreign' end as signals from pr left join be on be.t = pr.t"""
)
_SIDES = (
    _PRE
    + """ select seed_id, pos, case when len(tl) <> 1 or a = 0 then 'none' when len(pl) > 1 and a > list_min(pl) and a < list_max(pl) then 'infix' when f > 0 and a < f then 'pre' when f > 0 and a > f then 'post' else 'none' end as side
from (select seed_id, pos, case when q = s or t is null or t = '' then [] else string_split(t, ' ') end as tl, coalesce(list_position(qw, case when q = s then null else string_split(t, ' ')[1] end), 0) as a, coalesce(list_position(qw, sw[1]), 0) as f, list_filter(range(1, len(qw) + 1), lambda i: list_contains(sw, qw[i])) as pl from pre)"""
)

QUERIES = {
    "geo_rules_all": (geo_rules, _GEO),
    "without_seed_place": (placeless, _PLACELESS),
    "intent_fingerprint": (fingerprints, _FP),
    "normalize_nominative": (nominatives, _NOMN),
    "retailer_signals": (retailer_signals, _with(_SHOPS, "")),
    "tail_sides": (sides, _with(_SIDES, "")),
    "expand_numbers": (numbers, _SEEDS + " select seed_id, seed || ' 7 * ' || i as query, length(seed || ' 7 * ' || i)::int as cp from an, range(10) r(i) where seed_id % 2 = 0"),
    "payload_chunks": (chunks, "select p_partkey::bigint as id, (p_partkey // 185)::bigint as chunk, (p_partkey % 185 + 1)::bigint as local_id from part"),
    "cross_script": (
        spelled,
        FQ._P
        + f""", fo as (select distinct unnest([{_cy('w')}, {_cy('w')} || 'ник', {_cy('reverse(w)')}]) as b from bw), pa as (select w as a, b, {_SOUND.format('b')} as x, w as w0 from bw join fo on length(w) % 2 = length(b) % 2),
 pb as (select *, {_SOUND.format('a')} as y from pa), pc as (select *, list_distinct(list_transform(range(1, length(x)), lambda i: x[i:i + 1])) as p, list_distinct(list_transform(range(1, length(y)), lambda i: y[i:i + 1])) as q from pb)
 select a, b, 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.5 and len(list_intersect(p, q)) >= 0.2 * len(list_distinct(p || q)) and len(p) + len(q) > 0 as alike from pc""",
    ),
    "top_lemmas": (lemma_sets, FQ._P + " select w as word, case when ascii(w) % 2 = 0 then w || ',' || w || 'a' else w end as lemmas from bw"),
    "letter_artifacts": (artifacts, """with k as (select p_partkey, lower(p_name) as seed, case p_partkey % 5 when 0 then 'x' when 1 then '- y' when 2 then 'xx' when 3 then 'i' else '-' end as m, case when p_partkey % 7 <> 0 then lower(p_type) end as ty, p_partkey % 5 as r from part)
 select p_partkey, concat_ws(' ', seed, m, ty) as keyword, (r = 0 and ty is not null) or r = 1 or (r = 3 and ty is not null) as artifact from k"""),
    "prune_templates": (pruned, _SEEDS + _PROBES + " select seed_id, grp, struct from done where grp <> 'A_ru' and struct not in ('в *_v1', 'в *_v3', 'купить *_v1', 'купить *_v3', 'как *_v1', 'как *_v3')"),
}
