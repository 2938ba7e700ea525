"""Queries of places beside the seed's own and of tails that name a place, with SQL that gives the same rows.

Words of the star schema are written in Cyrillic letters here, because these steps look at such words only. Nations are
cities of their region, part names with a hyphen compound places, first words of part names with `район` districts, and
regions countries. Each line item gives a tail of ten kinds and a keyword that has all of its seed or only one word of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import detectors, geo_tails, places
from seedsift.plans import cascade
from seedsift.sources import tables as S
from seedsift.sources.shared import written

TARGET = "asia"
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz0123456789_", "абцдефгхижклмнопярстувшщйзэюьъыёіїєґч"


def cyrillic(c) -> Column:
    return F.translate(F.lower(X.col(c)), LATIN, CYRILLIC)


def _parts(spark, sf):
    part = S.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.lower("p_name").alias("nm"), F.lower("p_type").alias("ty"))
    words, k = X.words("nm"), F.col("p_partkey") % 3
    more = F.when(k == 1, F.concat(F.lit("nation_"), (F.col("p_partkey") % 5).cast("string"))).when(k == 2, F.col("ty"))
    return part.select("*", F.get(words, F.lit(0)).alias("n1"), F.get(words, F.lit(1)).alias("n2"), cyrillic(F.concat_ws(" ", "nm", more)).alias("seed"))


def _seeds(spark, sf):
    return _parts(spark, sf).groupBy("seed").agg(F.min("p_partkey").alias("seed_id")).select("seed_id", "seed")


def _nations(spark, sf):
    nation, region = (S.table(spark, sf, t) for t in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"), F.concat(F.lit("alt"), F.col("n_nationkey").cast("string")).alias("alt"))


def _geo(spark, sf):
    nations = _nations(spark, sf)
    names = nations.select(cyrillic("nation").alias("name"), F.array("region").alias("countries")).unionByName(nations.select(cyrillic("alt").alias("name"), F.array("region").alias("countries")))
    odd = F.length("n1") % 2 == 1
    both = _parts(spark, sf).select(F.replace(cyrillic("nm"), F.lit(" "), F.lit("-")).alias("name"), F.array(F.when(odd, "asia").otherwise("europe")).alias("countries")).distinct()
    return names.unionByName(both)


def _names(spark, sf):
    nations = _nations(spark, sf)
    return nations.select(cyrillic("nation").alias("name"), F.col("nation").alias("canonical")).unionByName(nations.select(cyrillic("alt").alias("name"), F.col("nation").alias("canonical")))


def _districts(spark, sf):
    part = _parts(spark, sf)
    pairs = part.select(F.concat(cyrillic("n1"), F.lit(" район")).alias("name"), cyrillic(F.concat(F.lit("nation_"), F.length("n1").cast("string"))).alias("city"), F.when(F.length("n1") > 3, "asia").otherwise("europe").alias("country")).where("length(name) <> 11")
    single = part.where("length(ty) = 5").select(cyrillic("ty").alias("name"), cyrillic(F.lit("nation_1")).alias("city"), F.lit("europe").alias("country"))
    return pairs.unionByName(single).distinct()


def _countries(spark, sf):
    return S.table(spark, sf, "region").select(cyrillic("r_name").alias("name"), F.lower("r_name").alias("country"))


def _lexicon(spark, sf):
    part, w, size = _parts(spark, sf), F.col("w"), F.length("w")
    words = part.select(F.explode(F.array("n1", "ty")).alias("w"), F.lit("a").alias("kind")).unionByName(part.select(F.col("n2").alias("w"), F.lit("n").alias("kind"))).unionByName(_nations(spark, sf).select(F.col("nation").alias("w"), F.lit("g").alias("kind"))).distinct()
    words = words.groupBy("w").agg(F.max("kind").alias("kind"))
    pos = F.when(F.col("kind") != "a", "NOUN").when(size == 3, "ADJF").when(size == 4, "PREP").when(size == 8, "NUMR").otherwise("NOUN")
    base = words.select(cyrillic(w).alias("word"), F.lit(0).alias("rank"), cyrillic(w).alias("lemma"), pos.alias("pos"), (F.ascii(w) % 2 == 0).alias("known"), F.when(F.col("kind") == "g", F.array(F.lit("Geox"))).otherwise(F.array().cast("array<string>")).alias("grammemes"))
    forms = base.where("pos = 'NOUN'").withColumn("word", F.concat("word", F.lit("ом")))
    own = spark.range(1).select(F.explode(F.array(F.lit("район"), F.lit("районе"))).alias("word"), F.lit(0).alias("rank"), F.lit("район").alias("lemma"), F.lit("NOUN").alias("pos"), F.lit(True).alias("known"), F.array().cast("array<string>").alias("grammemes"))
    return base.unionByName(forms).unionByName(own)


def _keywords(spark, sf):
    """(seed_id, seed, tail, keyword), distinct."""
    part, item = _parts(spark, sf), S.table(spark, sf, "lineitem")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), cyrillic("n1").alias("o1"), cyrillic("n2").alias("o2"))
    regions = _nations(spark, sf).select("nation", cyrillic("region").alias("region"))
    wide = item.join(part, item["l_partkey"] == part["p_partkey"]).join(other, "l_suppkey").join(_seeds(spark, sf), "seed").withColumn("nation", F.concat(F.lit("nation_"), (F.col("l_suppkey") % 25).cast("string"))).join(regions, "nation")
    o1, o2, city = F.col("o1"), F.col("o2"), cyrillic("nation")
    tails = [
        city, o1, o2, F.concat(o1, F.lit(" район")), F.concat(o1, F.lit(" районе")), F.concat_ws(" ", city, o1), F.concat(F.lit("жк "), city), F.concat(city, F.lit("ом")), F.concat_ws(" ", o1, o2), F.col("region"),
        cyrillic(F.concat(F.lit("alt"), (F.col("l_suppkey") % 25).cast("string"))), F.concat_ws("-", o1, o2),
    ]
    pick = (F.col("l_orderkey") + F.col("l_linenumber")) % len(tails)
    wide = wide.withColumn("tail", F.coalesce(*(F.when(pick == i, t) for i, t in enumerate(tails))))
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.concat_ws(" ", "seed", "tail")).when(k == 1, F.concat_ws(" ", cyrillic("n2"), "tail")).otherwise(F.concat_ws(" ", "tail", cyrillic("n1")))
    return wide.select("seed_id", "seed", "tail", text.alias("keyword")).distinct()


def parts(spark, sf):
    return places.name_parts(_geo(spark, sf)).select("part", "name", F.array_join("countries", ",").alias("countries"))


def _dims(spark, sf):
    return _geo(spark, sf), _names(spark, sf), _districts(spark, sf), TARGET, written(_lexicon(spark, sf))


def cities(spark, sf):
    geo, names, districts, target, lexicon = _dims(spark, sf)
    return places.seed_cities(_seeds(spark, sf), places.place_terms(geo, names, districts, target), lexicon).select("seed_id", "city", F.array_join("cities", ",").alias("cities"))


def signals(spark, sf):
    rows = written(_keywords(spark, sf).select("seed_id", "seed", "tail").distinct())
    return places.place_signals(rows, *_dims(spark, sf)).drop("seed")


def after(spark, sf):
    rows = written(_keywords(spark, sf).select("seed_id", "seed", "keyword").distinct())
    return places.content_after_city(rows, *_dims(spark, sf)).drop("seed")


def tails(spark, sf):
    rows = written(_keywords(spark, sf).select("seed_id", "seed", "keyword").distinct())
    kinds = geo_tails.place_kinds(_geo(spark, sf), _countries(spark, sf), _districts(spark, sf), TARGET)
    return geo_tails.geo_first_tail(rows, written(kinds), written(_lexicon(spark, sf))).drop("seed")


def labels(spark, sf):
    """Tails by places, brands and categories alone. Keywords with another spelling of a city count as confirmed."""
    geo, names, districts, target, lexicon = _dims(spark, sf)
    gazetteer = geo.select("name", F.explode("countries").alias("country"))
    brands = _parts(spark, sf).where("length(n2) = 4").select(cyrillic("n2").alias("name")).distinct()
    kw = _keywords(spark, sf).withColumns({"side": F.lit("none"), "own_geo": F.contains("keyword", cyrillic(F.lit("alt")))})
    chosen = ["geo", "brand", "foreign_geo", *detectors.BY_FLAG]
    out = cascade.label_tails(kw, gazetteer, brands, target, None, lexicon, geo, names, districts, categories=True, detector_names=chosen)
    joined = {c: F.array_join(F.array_sort(c), ",") for c in ("positive", "negative")}
    return out.select("seed_id", "keyword", "tail", *(c.alias(n) for n, c in joined.items()), "label")


def _cy(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{CYRILLIC}')"


_DIMS = f"""with pt as (select *, string_split(nm, ' ')[1] as n1, string_split(nm, ' ')[2] as n2, {_cy("concat_ws(' ', nm, case p_partkey % 3 when 1 then 'nation_' || (p_partkey % 5) when 2 then ty end)")} as seed
  from (select p_partkey::bigint as p_partkey, lower(p_name) as nm, lower(p_type) as ty from part)),
sd as (select min(p_partkey) as seed_id, seed from pt group by seed),
na as (select lower(n_name) as nation, lower(r_name) as region, 'alt' || n_nationkey as alt from nation join region on n_regionkey = r_regionkey),
ge as (select {_cy('nation')} as name, [region] as countries from na union all select {_cy('alt')}, [region] from na union all select distinct replace({_cy('nm')}, ' ', '-'), [case when length(n1) % 2 = 1 then 'asia' else 'europe' end] from pt),
nm as (select {_cy('nation')} as name, nation as canonical from na union all select {_cy('alt')}, nation from na),
ds as (select distinct * from (select {_cy('n1')} || ' район' as name, {_cy("'nation_' || length(n1)")} as city, case when length(n1) > 3 then 'asia' else 'europe' end as country from pt where length(n1) <> 5 union all select {_cy('ty')}, {_cy("'nation_1'")}, 'europe' from pt where length(ty) = 5)),
cn as (select {_cy('r_name')} as name, lower(r_name) as country from region),
lw as (select w, max(kind) as kind from (select unnest([n1, ty]) as w, 'a' as kind from pt union select n2, 'n' from pt union select nation, 'g' from na) group by w),
lb as (select {_cy('w')} as word, {_cy('w')} as lemma, case when kind <> 'a' then 'NOUN' when length(w) = 3 then 'ADJF' when length(w) = 4 then 'PREP' when length(w) = 8 then 'NUMR' else 'NOUN' end as pos, ascii(w) % 2 = 0 as known, kind = 'g' as geox from lw),
lx as (select * from lb union all select word || 'ом', lemma, pos, known, geox from lb where pos = 'NOUN' union all select unnest(['район', 'районе']), 'район', 'NOUN', true, false),
np as (select part, arg_min(name, name) as name, arg_min(countries, name) as countries from (select name, countries, unnest(list_distinct([p[1], case when length(p[len(p)]) >= 4 then p[len(p)] end])) as part from (select *, string_split(name, '-') as p from ge where contains(name, '-'))) where part is not null group by 1),
kr as (select distinct seed_id, seed, tail, case k when 0 then seed || ' ' || tail when 1 then {_cy('n2')} || ' ' || tail else tail || ' ' || {_cy('n1')} end as keyword
  from (select sd.seed_id, sd.seed, p.n1, p.n2, l_linenumber % 3 as k, case (l_orderkey + l_linenumber) % 12 when 0 then c when 1 then o1 when 2 then o2 when 3 then o1 || ' район' when 4 then o1 || ' районе' when 5 then c || ' ' || o1 when 6 then 'жк ' || c
      when 7 then c || 'ом' when 8 then o1 || ' ' || o2 when 9 then {_cy('region')} when 10 then {_cy("'alt' || (l_suppkey % 25)")} else o1 || '-' || o2 end as tail
    from (select l.*, {_cy("'nation_' || (l_suppkey % 25)")} as c, {_cy('o.n1')} as o1, {_cy('o.n2')} as o2, 'nation_' || (l_suppkey % 25) as nation from lineitem l join pt o on l_suppkey = o.p_partkey) x join pt p on l_partkey = p.p_partkey join sd on sd.seed = p.seed join na on na.nation = x.nation)),
ws as (select distinct unnest(string_split(t, ' ')) as word from (select seed as t from sd union select tail from kr union select keyword from kr)),
wf as (select ws.word, coalesce(lx.lemma, ws.word) as lemma, pos, coalesce(known, false) as known, coalesce(geox, false) as geox, n1.canonical as city, n2.canonical as l_city,
    exists (select 1 from ge where ge.name = ws.word) as geo, exists (select 1 from ge where ge.name = coalesce(lx.lemma, ws.word)) as l_geo, exists (select 1 from ge where ge.name = ws.word and list_contains(countries, 'asia')) as home,
    exists (select 1 from ge where ge.name = coalesce(lx.lemma, ws.word) and list_contains(countries, 'asia')) as l_home, exists (select 1 from ds where ds.name = ws.word) as district,
    p1.name as part_of, p2.name as l_part_of, case when p1.name is not null then not list_contains(p1.countries, 'asia') else not list_contains(p2.countries, 'asia') end as abroad
  from ws left join lx on lx.word = ws.word left join nm n1 on n1.name = ws.word left join nm n2 on n2.name = coalesce(lx.lemma, ws.word) left join np p1 on p1.part = ws.word left join np p2 on p2.part = coalesce(lx.lemma, ws.word)),
sw as (select seed_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select seed_id, string_split(seed, ' ') as w from sd)),
sc as (select seed_id, i, coalesce(city, l_city) as c from sw join wf on wf.word = sw.word where not (coalesce(pos = 'NOUN', false) and not geox) and coalesce(city, l_city) is not null),
ct as (select sd.seed_id, (select arg_min(c, i) from sc where sc.seed_id = sd.seed_id) as city, coalesce((select list_sort(list(distinct c)) from sc where sc.seed_id = sd.seed_id), []) as cities from sd)"""

_SIGNALS = _DIMS + r""",
tl as (select distinct seed_id, tail from kr),
tw as (select seed_id, tail, i, wf.*, count(*) over (partition by seed_id, tail) as n, lead(wf.word) over w as nxt, lead(lemma) over w as nxtl, lag(wf.word) over w as prv
  from (select seed_id, tail, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select *, string_split(tail, ' ') as w from tl)) t join wf on wf.word = t.word window w as (partition by seed_id, tail order by i)),
tr as (select seed_id, tail, n = 1 and length(word) >= 3 and not geo and not l_geo and coalesce(pos not in ('ADJF', 'ADJS', 'NUMR'), true) and coalesce(part_of, l_part_of) is not null as truncated, known, geox, abroad from tw where i = 1),
wc as (select distinct tw.seed_id, tail from tw join ct on ct.seed_id = tw.seed_id where len(cities) > 0 and not district and coalesce(pos not in ('CONJ', 'PREP', 'PRCL', 'INTJ'), true) and not coalesce(prv = 'жк', false)
  and case when home then not list_contains(cities, coalesce(city_, word)) when length(word) >= 5 and lemma <> word and l_home then not list_contains(cities, coalesce(l_city, lemma)) else false end),
dp as (select seed_id, tail, arg_min(word, i) as a, arg_min(lemma, i) as al, arg_min(nxt, i) as b, arg_min(nxtl, i) as bl from tw where (nxt = 'район' or nxtl = 'район') and pos in ('ADJF', 'ADJS', 'NOUN', 'PRTF', 'PRTS') group by 1, 2),
dd as (select seed_id, tail, (select coalesce(canonical, ds.city) from ds left join nm on nm.name = ds.city where ds.name in (a || ' ' || b, a || ' ' || bl, al || ' ' || b, al || ' ' || bl)) as dc from dp)
select tl.seed_id, tl.tail, truncated, truncated and not (known and not geox) and abroad as truncated_foreign, wc.tail is not null as wrong_city, ct.city as seed_city,
  ct.city is not null and dd.tail is not null and coalesce(dc <> ct.city, false) as wrong_district, ct.city is not null and dd.tail is not null and dc is null as unknown_district
from tl join tr on tr.seed_id = tl.seed_id and tr.tail = tl.tail join ct on ct.seed_id = tl.seed_id left join wc on wc.seed_id = tl.seed_id and wc.tail = tl.tail left join dd on dd.seed_id = tl.seed_id and dd.tail = tl.tail""".replace("coalesce(city_, word)", "coalesce(tw.city, word)")

_AFTER = _DIMS + r""",
kd as (select distinct seed_id, keyword from kr),
kt as (select k.seed_id, keyword, i, pos, list_contains(cities, coalesce(wf.city, l_city)) as own from (select seed_id, keyword, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select *, string_split(keyword, ' ') as w from kd)) k join wf on wf.word = k.word join ct on ct.seed_id = k.seed_id),
la as (select seed_id, keyword, max(i) as pl from kt where own group by 1, 2)
select kd.seed_id, kd.keyword, exists (select 1 from la join kt on kt.seed_id = la.seed_id and kt.keyword = la.keyword where la.seed_id = kd.seed_id and la.keyword = kd.keyword and i > pl and coalesce(pos not in ('CONJ', 'PREP', 'PRCL', 'INTJ'), true)) as after_city from kd"""

_TAILS = _DIMS + r""",
ki as (select name, bool_or(home) filter (kind = 1) as city, bool_or(home) filter (kind = 2) as country, bool_or(home) filter (kind = 3) as district from (select name, 1 as kind, list_contains(countries, 'asia') as home from ge union all select name, 2, country = 'asia' from cn union all select name, 3, country = 'asia' from ds) group by 1),
qd as (select distinct keyword as q, string_split(keyword, ' ') as w from kr),
qt as (select q, i, t.word, lemma, pos from (select q, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from qd) t join wf on wf.word = t.word),
g as (select q, 1 as n, i, unnest([word, case when length(word) >= 5 and lemma <> word then lemma end]) as term, word, pos from qt
  union all select a.q, 2, a.i, unnest([a.word || ' ' || b.word, a.lemma || ' ' || b.word, a.lemma || ' ' || b.lemma]), '', null from qt a join qt b on a.q = b.q and b.i = a.i + 1
  union all select a.q, 3, a.i, unnest([a.word || ' ' || b.word || ' ' || c.word, a.lemma || ' ' || b.word || ' ' || c.word]), '', null from qt a join qt b on a.q = b.q and b.i = a.i + 1 join qt c on a.q = c.q and c.i = a.i + 2),
gf as (select distinct q, n, i, word, pos, unnest(case when n = 1 then [term] else [term, replace(term, ' ', '-'), replace(term, '-', ' ')] end) as term from g where term is not null),
ev as (select q, n, i, bool_or(city) as city, bool_or(country) as country, bool_or(not district) as away, bool_or(city) filter (term = word) as c1, bool_or(city) filter (term <> word) as c0, bool_or(country) filter (term = word) as k1, bool_or(country) filter (term <> word) as k0,
    bool_or(not district) filter (term = word) as d1, bool_or(not district) filter (term <> word) as d0, max(pos) as pos from gf join ki on ki.name = gf.term group by 1, 2, 3),
vd as (select q, n, i, case n when 3 then city when 2 then case when coalesce(away, false) then false else coalesce(city, country) end
    else case when coalesce(pos in ('CONJ', 'PREP', 'PRCL', 'INTJ'), false) or coalesce(d1, false) or (not coalesce(c1, false) and coalesce(d0, false)) then null when coalesce(c1, c0, k1, k0) then true end end as home from ev),
cv as (select q, arg_min(n, k) as n, arg_min(i, k) as pl, arg_min(home, k) as home from (select *, (3 - n) * 100 + i as k from vd where home is not null) group by 1),
ks as (select distinct kr.seed_id, keyword, qd.w as qw, string_split(seed, ' ') as sw, cv.n, cv.pl from kr join qd on qd.q = kr.keyword join cv on cv.q = kr.keyword and cv.home),
lm as (select map(list(word), list(lemma)) as m, map(list(word), list(coalesce(pos, ''))) as p from wf),
ma as (select seed_id, keyword, qw, sw, n, pl, list_transform(qw, lambda x: m[x]) as ql, list_transform(sw, lambda x: m[x]) as sl, list_transform(sw, lambda x: p[x]) as sp from ks, lm),
tk as (select *, list_reduce(range(1, len(sw) + 1), lambda acc, s: list_append(acc, coalesce(list_filter(range(1, len(qw) + 1), lambda x: not list_contains(acc, x) and (qw[x] = sw[s] or ql[x] = sl[s]))[1], -1)), []::bigint[]) as taken,
    list_bool_or(list_transform(range(1, len(sw) + 1), lambda s: not list_contains(['CONJ', 'PREP', 'PRCL', 'INTJ'], sp[s]) and len(list_filter(range(1, len(qw) + 1), lambda x: not (x between pl and pl + n - 1) and (qw[x] = sw[s] or ql[x] = sl[s]))) > 0)) as shown from ma),
ou as (select seed_id, keyword, nullif(array_to_string(list_transform(list_filter(range(1, len(qw) + 1), lambda x: not list_contains(taken, x)), lambda x: qw[x]), ' '), '') as tail from tk where shown and len(list_filter(range(pl, pl + n), lambda x: not list_contains(taken, x))) > 0)
select kd.seed_id, kd.keyword, ou.tail as geo_tail from (select distinct seed_id, keyword from kr) kd left join ou on ou.seed_id = kd.seed_id and ou.keyword = kd.keyword"""

_LABELS = (
    _SIGNALS.replace("select tl.seed_id, tl.tail, truncated,", "sg as (select tl.seed_id, tl.tail, truncated,", 1).replace("\nsg as", ",\nsg as", 1)
    + r""")"""
    + _AFTER.removeprefix(_DIMS).replace("select kd.seed_id, kd.keyword, exists", "af as (select kd.seed_id, kd.keyword, exists", 1).replace("\naf as", ",\naf as", 1)
    + r"""),
gz as (select name, bool_or(list_contains(countries, 'asia')) as own from ge group by 1),
br as (select distinct """
    + _cy("n2")
    + r""" as name from pt where length(n2) = 4),
hi as (select seed_id, tail, coalesce(bool_or(gz.own), false) as own, coalesce(bool_or(gz.name is not null), false) as place, bool_or(br.name is not null) as brand from (select seed_id, tail, unnest(string_split(tail, ' ')) as word from tl) x left join gz on gz.name = word left join br on br.name = word group by 1, 2),
tt as (select distinct kr.seed_id, kr.tail, replace(seed, ' ', '_') as a, replace(tail, ' ', '_') as b from kr),
tp as (select seed_id, tail, list_distinct(list_transform(range(1, greatest(length(a) - 2, 1) + 1), lambda i: a[i:i + 2])) as x, list_distinct(list_transform(range(1, greatest(length(b) - 2, 1) + 1), lambda i: b[i:i + 2])) as y from tt),
mi as (select seed_id, tail, len(list_intersect(x, y)) / least(len(x), len(y)) <= 0.05 as far from tp),
j as (select kr.seed_id, kr.keyword, kr.tail, own or (contains(kr.keyword, """
    + _cy("'alt'")
    + r""") and sg.seed_city is null) as g0, contains(kr.keyword, """
    + _cy("'alt'")
    + r""") as conf, after_city, own, place, brand, far, truncated, truncated_foreign, wrong_district, unknown_district, wrong_city
  from kr join sg on sg.seed_id = kr.seed_id and sg.tail = kr.tail join af on af.seed_id = kr.seed_id and af.keyword = kr.keyword join hi on hi.seed_id = kr.seed_id and hi.tail = kr.tail join mi on mi.seed_id = kr.seed_id and mi.tail = kr.tail),
f as (select *, list_filter([case when brand then 'brand' end, case when g0 and not after_city then 'geo' end], lambda x: x is not null) as positive from j),
n as (select *, list_sort(list_filter([case when far and len(positive) = 0 then 'category_mismatch' end, case when place and not own and not conf then 'foreign_geo' end, case when truncated and not conf then 'truncated_geo' end, case when truncated_foreign and not conf then 'truncated_geo_foreign' end,
    case when unknown_district then 'unknown_district' end, case when wrong_district then 'wrong_district' end, case when wrong_city then 'wrong_geo_token' end], lambda x: x is not null)) as negative,
    list_has_any([case when place and not own and not conf then 'x' end, case when truncated_foreign and not conf then 'x' end, case when wrong_district then 'x' end, case when wrong_city then 'x' end], ['x']) as absolute from f)
select seed_id, keyword, tail, array_to_string(positive, ',') as positive, array_to_string(negative, ',') as negative, case when len(positive) > 0 and len(negative) = 0 then 'VALID' when len(positive) = 0 and len(negative) = 0 then 'GREY' when absolute then 'TRASH' when len(positive) > 0 then 'VALID' else 'GREY' end as label from n"""
)

QUERIES = {
    "place_parts": (parts, _DIMS + " select part, name, array_to_string(countries, ',') as countries from np"),
    "seed_cities": (cities, _DIMS + " select seed_id, city, array_to_string(cities, ',') as cities from ct"),
    "place_signals": (signals, _SIGNALS),
    "after_city": (after, _AFTER),
    "geo_tails": (tails, _TAILS),
    "place_labels": (labels, _LABELS),
}
