"""Queries of words beside places, with SQL that gives the same rows.

The words are those of part names and types in Latin and in Cyrillic letters, with and without endings of a region's adjective. Places are
made of the same words; their population and class follow from a word's letters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import place_words
from seedsift.plans.place_queries import _cy, cyrillic
from seedsift.sources import tables as S
from seedsift.sources.shared import written

TARGET = "asia"


def _base(spark, sf):
    """(w): distinct words of names and types."""
    part = S.table(spark, sf, "part")
    return part.select(F.explode(X.words(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()


def _words(spark, sf):
    w = _base(spark, sf)
    c = cyrillic("w")
    return w.select(F.explode(F.array(F.col("w"), F.initcap("w"), c, F.concat(c, F.lit("ская")), F.concat(c, F.lit("кий")), F.concat(c, F.lit("ё")), F.lit("бош"), F.lit("bosch"), F.substring(c, 1, 2))).alias("word")).distinct()


def _places(spark, sf):
    w, size, code = _base(spark, sf), F.length("w"), F.ascii("w")
    country = F.element_at(F.array(*map(F.lit, ("asia", "europe", "africa"))), (code % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("P", "T", "A", "C"))), (size % 4 + 1).cast("int"))
    rows = w.select(cyrillic("w").alias("name"), country.alias("country"), (code * 1000).cast("long").alias("pop"), (code % 5).cast("string").alias("admin1"), kind.alias("fclass"))
    latin = w.select(F.col("w").alias("name"), country.alias("country"), (code * 400).cast("long").alias("pop"), F.lit("1").alias("admin1"), F.lit("P").alias("fclass"))
    again = w.select(cyrillic("w").alias("name"), F.lit("europe").alias("country"), F.lit(109000).cast("long").alias("pop"), F.lit("7").alias("admin1"), F.lit("P").alias("fclass"))
    town = w.select(F.concat(cyrillic("w"), F.when(code % 2 == 0, "ск").otherwise("а")).alias("name"), country.alias("country"), F.lit(60000).cast("long").alias("pop"), (code % 5).cast("string").alias("admin1"), F.lit("P").alias("fclass"))
    soft = w.select(F.concat(cyrillic("w"), F.lit("е")).alias("name"), country.alias("country"), F.lit(5).cast("long").alias("pop"), F.lit("2").alias("admin1"), F.lit("P").alias("fclass"))
    return rows.unionByName(latin).unionByName(again).unionByName(town).unionByName(soft)


def _lexicon(spark, sf):
    w, size, code = _base(spark, sf), F.length("w"), F.ascii("w")
    pos = F.element_at(F.array(*map(F.lit, ("NOUN", "ADJF", "PREP", "NOUN"))), (size % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    marks = F.when(code % 5 == 0, F.array(F.lit("Geox"))).when(code % 5 == 1, F.array(F.lit("Surn"), F.lit("anim"))).when(code % 5 == 2, F.array(F.lit("inan"))).when(code % 5 == 3, F.array(F.lit("Qual"))).otherwise(none)
    first = w.select(cyrillic("w").alias("word"), F.lit(0).alias("rank"), cyrillic("w").alias("lemma"), pos.alias("pos"), (size / 10.0).alias("score"), (code % 3 != 0).alias("known"), marks.alias("grammemes"))
    second = w.where(code % 2 == 0).select(cyrillic("w").alias("word"), F.lit(1).alias("rank"), cyrillic("w").alias("lemma"), F.lit("NOUN").alias("pos"), F.lit(0.1).alias("score"), F.lit(True).alias("known"), F.array(F.lit("Geox")).alias("grammemes"))
    return first.unionByName(second)


def _listed(spark, sf):
    return _base(spark, sf).where(F.ascii("w") % 7 == 0).select(cyrillic("w").alias("name"), F.lit("xx").alias("country"))


def lookup(spark, sf):
    return place_words.place_lookup(_words(spark, sf), _places(spark, sf), TARGET, _lexicon(spark, sf), _listed(spark, sf))


def features(spark, sf):
    words = written(_words(spark, sf))
    found = place_words.place_lookup(words, _places(spark, sf), TARGET).select("word", "pop")
    df = place_words.word_features(words, _lexicon(spark, sf), _base(spark, sf).where(F.ascii("w") % 2 == 0).select(cyrillic("w").alias("word")))
    wide = df.join(found, "word", "left")
    return wide.select(*df.columns, place_words.real_city().alias("real_city"), place_words.brand_like(ignored=("бош",)).alias("brand_like"))


def adjectives(spark, sf):
    cities = _places(spark, sf).where("fclass <> 'C'").select("name")
    return place_words.region_adjectives(_words(spark, sf), cities)


def _keywords(spark, sf):
    """(seed_id, kw_id, keyword, city), one row for each line item: a seed's city, and a keyword about a region."""
    part = S.table(spark, sf, "part").select("p_partkey", F.get(X.words("p_name"), F.lit(0)).alias("n1"), F.get(X.words("p_name"), F.lit(1)).alias("n2"))
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("n2").alias("o2"))
    wide = S.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(other, "l_suppkey")
    c, o, k = cyrillic("n2"), cyrillic("o2"), (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    shapes = [(o, F.lit("область")), (F.concat(o, F.lit("ская")), F.lit("обл")), (F.concat(o, F.lit("ская")), F.lit("дом")), (c, F.concat(o, F.lit("кий")), F.lit("области")), (cyrillic("n1"), F.concat(o, F.lit("ы")), F.lit("область"))]
    text = F.coalesce(*(F.when(k == i, F.concat_ws(" ", *s)) for i, s in enumerate(shapes)))
    seed = (F.ascii("n2") * 10 + F.length("n2")).cast("long")
    return wide.select(seed.alias("seed_id"), F.xxhash64(seed, text).alias("kw_id"), text.alias("keyword"), F.when(F.ascii("n2") % 3 != 0, c).alias("city")).distinct()


def regions(spark, sf):
    kw = written(_keywords(spark, sf))
    # A city's own name in the table of places stands for what looking up all names and candidates gives.
    places = _places(spark, sf).where("fclass in ('P', 'T')").groupBy("name").agg(F.max(F.struct("pop", "country", "admin1")).alias("_p"))
    known = places.select(F.col("name").alias("word"), F.lit("city").alias("kind"), "_p.country", "_p.admin1")
    seeds = kw.where("city is not null").select("seed_id", "city").distinct().join(known.withColumnRenamed("word", "city"), "city", "left").select("seed_id", "city", "country", "admin1")
    out = place_words.other_regions(kw, seeds, known).join(kw.select("seed_id", "kw_id", "keyword"), ["seed_id", "kw_id"])
    return out.select("seed_id", "keyword", F.array_join("cities", ",").alias("cities"))


def _travel(spark, sf):
    """(seed_id, seed, city, keyword), distinct: a seed's city, and a keyword with another part's words."""
    part = S.table(spark, sf, "part").select("p_partkey", F.get(X.words("p_name"), F.lit(0)).alias("n1"), F.get(X.words("p_name"), F.lit(1)).alias("n2"))
    other = part.select(F.col("p_partkey").alias("l_suppkey"), cyrillic("n1").alias("q"), cyrillic("n2").alias("o"))
    wide = S.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(other, "l_suppkey")
    c, o, q, k = cyrillic("n2"), F.col("o"), F.col("q"), (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    shapes = [(c, o), (F.lit("в"), o), (F.concat(o, F.lit("ы")), q), (F.lit("жк"), o), (F.concat(o, F.lit("ский")), F.lit("район")), (q, o), (o, F.lit("дом")), (o, F.concat(q, F.lit("а")))]
    text = F.coalesce(*(F.when(k == i, F.concat_ws(" ", *x)) for i, x in enumerate(shapes)))
    seed = (F.ascii("n2") * 10 + F.length("n2")).cast("long")
    return wide.select(seed.alias("seed_id"), F.concat(c, F.lit(" дом")).alias("seed"), F.when(F.ascii("n2") % 5 != 0, c).alias("city"), text.alias("keyword")).distinct()


def other(spark, sf):
    kw = written(_travel(spark, sf).withColumn("kw_id", F.xxhash64("seed_id", "keyword")))
    part = S.table(spark, sf, "part").select("p_name", F.get(X.words("p_name"), F.lit(0)).alias("n1"))
    pairs = part.select(cyrillic("p_name").alias("name"), F.lit("asia").alias("country"), (F.length("n1") * 12000).cast("long").alias("pop"), F.lit("1").alias("admin1"), F.lit("P").alias("fclass")).distinct()
    named = _places(spark, sf).where("fclass <> 'C'").unionByName(pairs).groupBy("name").agg(F.max(F.struct("pop", "country", "admin1", "fclass")).alias("_p"))
    places = written(named.select(F.col("name").alias("word"), F.lit("city").alias("kind"), "_p.country", "_p.pop", "_p.admin1", "_p.fclass"))
    seeds = kw.where("city is not null").select("seed_id", "city").distinct().join(places.select(F.col("word").alias("city"), "country", "admin1"), "city", "left").select("seed_id", "city", "country", "admin1")
    base = _base(spark, sf)
    districts = base.where(F.ascii("w") % 4 == 1).select(cyrillic("w").alias("name"), cyrillic(F.lit("anvil")).alias("city"))
    brands = base.where("length(w) = 3").select(cyrillic("w").alias("name"))
    case = F.when(F.length("word") % 2 == 0, "gent").otherwise("nomn")
    lexicon = _lexicon(spark, sf).withColumn("case", case)
    out = place_words.other_cities(kw, kw.select("seed_id", "seed").distinct(), seeds, places, districts, brands, lexicon)
    return out.join(kw.select("seed_id", "kw_id", "keyword"), ["seed_id", "kw_id"]).select("seed_id", "keyword", F.array_join("cities", ",").alias("cities"))


def foreign(spark, sf):
    kw = written(_keywords(spark, sf))
    base = _base(spark, sf)
    size = F.length("w")
    dim = base.where(size == 4).select(F.concat(cyrillic("w"), F.lit(" область")).alias("name"), F.lit("europe").alias("country")).unionByName(base.where(size == 5).select(cyrillic("w").alias("name"), F.when(F.ascii("w") % 2 == 0, "africa").otherwise(TARGET).alias("country")))
    districts = base.where(size == 4).where(F.ascii("w") % 2 == 0).select(cyrillic("w").alias("name"))
    out = place_words.foreign_regions(kw, dim, districts, TARGET).join(kw.select("seed_id", "kw_id", "keyword"), ["seed_id", "kw_id"])
    return out.select("seed_id", "keyword", "reason")


_BASE = f"""with bw as (select distinct unnest(string_split(lower(p_name || ' ' || p_type), ' ')) as w from part),
b as (select w, {_cy('w')} as c, ascii(w) as code, length(w) as size from bw),
wd as (select distinct unnest([w, upper(w[1]) || w[2:], c, c || 'ская', c || 'кий', c || 'ё', 'бош', 'bosch', c[1:2]]) as word from b),
pl as (select c as name, ['asia', 'europe', 'africa'][code % 3 + 1] as country, code * 1000 as pop, (code % 5)::varchar as admin1, ['P', 'T', 'A', 'C'][size % 4 + 1] as fclass from b
  union all select w, ['asia', 'europe', 'africa'][code % 3 + 1], code * 400, '1', 'P' from b union all select c, 'europe', 109000, '7', 'P' from b
  union all select c || case when code % 2 = 0 then 'ск' else 'а' end, ['asia', 'europe', 'africa'][code % 3 + 1], 60000, (code % 5)::varchar, 'P' from b union all select c || 'е', ['asia', 'europe', 'africa'][code % 3 + 1], 5, '2', 'P' from b),
lx as (select c as word, 0 as rank, ['NOUN', 'ADJF', 'PREP', 'NOUN'][size % 4 + 1] as pos, size / 10.0 as score, code % 3 <> 0 as known, case code % 5 when 0 then ['Geox'] when 1 then ['Surn', 'anim'] when 2 then ['inan'] when 3 then ['Qual'] else []::varchar[] end as marks from b
  union all select c, 1, 'NOUN', 0.1, true, ['Geox'] from b where code % 2 = 0),
lw as (select word, arg_min(pos, rank) as pos, arg_min(score, rank) as score, arg_min(marks, rank) as marks, bool_or(known) as known, bool_or(list_contains(marks, 'Geox')) as geox, bool_or(list_has_any(marks, ['Geox', 'Surn'])) as geo_parse from lx group by 1),
li as (select c as name from b where code % 7 = 0)"""

_RANKED = """select name, fclass = 'C' as land, country, pop, admin1, fclass, row_number() over (partition by name, fclass = 'C' order by pop desc, country, admin1, fclass) as r from pl where fclass <> 'A' or country = 'asia'"""

_LOOKUP = _BASE + f""",
be as (select * from ({_RANKED}) where r = 1),
hi as (select wd.word, be.*, li.name is not null as listed, coalesce(geo_parse, false) as gp from wd join be on be.name = replace(word, 'ё', 'е') and length(word) >= 3 left join li on li.name = be.name left join lw on lw.word = be.name),
rk as (select *, case when land and (listed or not regexp_matches(name, '[а-яёіїєґ]') or gp) then 0 when not land and listed then 1 when not land then 2 end as k from hi)
select word, case when k = 2 then 'city' else 'country' end as kind, case when k = 1 then 'xx' else country end as country, pop, case when k = 2 then admin1 end as admin1, case when k = 2 then fclass end as fclass
from (select *, row_number() over (partition by word order by k) as best from rk where k is not null) where best = 1"""

_BRANDS = "'" + "', '".join(place_words.KNOWN_BRANDS) + "'"
_FEATURES = _BASE + f""",
be as (select * from ({_RANKED}) where r = 1),
po as (select word, coalesce(max(pop) filter (land and not regexp_matches(name, '[а-яёіїєґ]')), max(pop) filter (not land)) as pop from wd join be on be.name = replace(word, 'ё', 'е') and length(word) >= 3 group by 1),
f as (select wd.word, pos, coalesce(geox, false) as geox, coalesce(geo_parse, false) as geo_parse, coalesce(known, false) as known, score, coalesce(marks, []) as marks, lw.word is not null as parsed, pop from wd left join lw on lw.word = wd.word left join po on po.word = wd.word),
g as (select *, parsed and (coalesce(pos = 'PREP', false) or (known and not geox)) as skip_geo, parsed and known and not geox as homonym from f)
select word, pos, geox, geo_parse, skip_geo, homonym, coalesce(parsed and not skip_geo and known and not list_has_any(marks, ['Geox', 'Name', 'Surn', 'Patr', 'Orgn']) and case pos when 'ADJF' then (list_contains(marks, 'Qual') and score >= 0.4) or score >= 0.6 when 'NOUN' then list_contains(marks, 'inan') and score >= 0.5 else false end, false) as common_noun,
  homonym and pos = 'NOUN' and word not in (select c from b where code % 2 = 0) as everyday,
  lower(word) not in ({_BRANDS}) and not (regexp_full_match(word, '[A-Za-z]+') and (length(word) <= 4 or coalesce(pop, 0) < 50000)) and length(word) >= case when regexp_full_match(word, '[A-Za-z]*') then 5 else 3 end as real_city,
  lower(word) in ({_BRANDS}) or regexp_full_match(word, '[A-Za-z]+') or length(word) <= 4 as brand_like
from g"""

_ENDS = ", ".join(f"({len(e)}, {i}, '{e}')" for i, e in enumerate(place_words.REGION_ENDINGS))
_CITY = ", ".join(f"({i}, '{e}')" for i, e in enumerate(place_words.CITY_ENDINGS))
_ADJ = f""",
en(n, i, e) as (values {_ENDS}), ci(j, ce) as (values {_CITY}),
ca as (select word, word[:length(word) - n] || ce as name, n, i, j from aw join en on ends_with(word, e) and length(word) - n >= 3, ci),
ad as (select word, arg_max(name, length(name) * 1000000 + n * 10000 - i * 100 - j) as city from ca where name in (select name from an) group by 1)"""

_ADJECTIVES = _BASE + ", aw as (select word from wd), an as (select name from pl where fclass <> 'C')" + _ADJ + " select * from ad"

_KW = _BASE + f""",
p as (select p_partkey, string_split(lower(p_name), ' ')[1] as n1, string_split(lower(p_name), ' ')[2] as n2 from part),
kw as (select distinct (ascii(n2) * 10 + length(n2))::bigint as seed_id, case when ascii(n2) % 3 <> 0 then {_cy('n2')} end as city, case k when 0 then o || ' область' when 1 then o || 'ская обл' when 2 then o || 'ская дом' when 3 then {_cy('n2')} || ' ' || o || 'кий области' else {_cy('n1')} || ' ' || o || 'ы область' end as keyword
  from (select p.n1, p.n2, {_cy('q.n2')} as o, (l_orderkey + l_linenumber) % 5 as k from lineitem join p on l_partkey = p.p_partkey join p q on l_suppkey = q.p_partkey))"""

_STEM = "regexp_replace({0}, '^(.{{3,}}?)(?:ская|ский|ской|ском|скими|ских|скую|ское|кая|кий|кой|ком|кими|ких|кую|кое|ой|ый|ий|ом|ем|ам|ях|ах|ою|ее|ие|ые|е|и|у|ю|а|я|ы)$', '\\1')"

_REGIONS = _KW + f""",
kn as (select name, arg_max(country, (pop, country, admin1)) as country, arg_max(admin1, (pop, country, admin1)) as admin1 from pl where fclass in ('P', 'T') group by 1),
se as (select distinct seed_id, kw.city, kn.country, kn.admin1 from kw left join kn on kn.name = kw.city where kw.city is not null),
tk as (select seed_id, keyword, unnest(string_split(keyword, ' ')) as word from kw where contains(keyword, 'обл') and city is not null),
aw as (select distinct word from tk), an as (select name from kn)""" + _ADJ + f""",
fo as (select seed_id, keyword, {_STEM.format('word')} as name from tk where {_STEM.format('word')} in (select name from kn)
  union select tk.seed_id, keyword, ad.city from tk join ad on ad.word = tk.word join kn on kn.name = ad.city where not exists (select 1 from se where se.seed_id = tk.seed_id and upper(se.country) = upper(kn.country) and coalesce(se.admin1, '') = coalesce(kn.admin1, '')))
select seed_id, keyword, string_agg(distinct name, ',' order by name) as cities from fo where not exists (select 1 from se where se.seed_id = fo.seed_id and {_STEM.format('se.city')} = {_STEM.format('fo.name')}) group by 1, 2"""

_OTHER = _BASE + f""",
p as (select p_partkey, lower(p_name) as nm, string_split(lower(p_name), ' ')[1] as n1, string_split(lower(p_name), ' ')[2] as n2 from part),
kw as (select distinct (ascii(n2) * 10 + length(n2))::bigint as seed_id, c || ' дом' as seed, case when ascii(n2) % 5 <> 0 then c end as city, case k when 0 then c || ' ' || o when 1 then 'в ' || o when 2 then o || 'ы ' || q when 3 then 'жк ' || o when 4 then o || 'ский район' when 5 then q || ' ' || o when 6 then o || ' дом' else o || ' ' || q || 'а' end as keyword
  from (select p.n2, {_cy('p.n2')} as c, {_cy('x.n2')} as o, {_cy('x.n1')} as q, (l_orderkey + l_linenumber) % 8 as k from lineitem join p on l_partkey = p.p_partkey join p x on l_suppkey = x.p_partkey)),
pw as (select name, arg_max(country, (pop, country, admin1, fclass)) as country, max(pop) as pop, arg_max(admin1, (pop, country, admin1, fclass)) as admin1, arg_max(fclass, (pop, country, admin1, fclass)) as fclass from (select * from pl where fclass <> 'C' union all select distinct {_cy('nm')}, 'asia', length(n1) * 12000, '1', 'P' from p) group by 1),
se as (select distinct seed_id, kw.city, pw.country, pw.admin1 from kw left join pw on pw.name = kw.city where kw.city is not null),
di as (select c as name from b where code % 4 = 1), br as (select c as name from b where size = 3),
lc as (select word, arg_min(pos, rank) as pos, case when length(word) % 2 = 0 then 'gent' else 'nomn' end as cas, bool_or(list_has_any(marks, ['Geox', 'Surn'])) as named from lx group by word),
tk as (select seed_id, keyword, i, w[i] as raw, {_STEM.format('w[i]')} as norm, w[i - 1] as prev, w[i + 1] as nxt from (select *, unnest(range(1, len(w) + 1)) as i from (select kw.seed_id, keyword, string_split(keyword, ' ') as w from kw where city is not null))),
sw as (select distinct seed_id, unnest(list_distinct([x, {_STEM.format('x')}])) as word from (select seed_id, unnest(string_split(seed, ' ')) as x from kw)),
ow as (select seed_id, {_STEM.format('city')} as stem from se),
fm as (select tk.*, unnest(list_distinct([raw, norm])) as word from tk),
fl as (select fm.*, pw.pop, pw.fclass, coalesce(fm.word in (select name from br), false) as brand, exists (select 1 from sw where sw.seed_id = fm.seed_id and sw.word = fm.word) as anchor, exists (select 1 from se where se.seed_id = fm.seed_id and se.city = {_cy("'anvil'")}) and fm.word in (select name from di) as allowed, fm.word in (select name from di) as district,
    exists (select 1 from ow where ow.seed_id = fm.seed_id and ow.stem = {_STEM.format('fm.word')}) as own_city, exists (select 1 from se where se.seed_id = fm.seed_id and upper(se.country) = upper(pw.country) and coalesce(se.admin1, '') = coalesce(pw.admin1, '')) as own_region from fm left join pw on pw.name = fm.word),
ag as (select seed_id, keyword, i, any_value(raw) as raw, any_value(norm) as norm, any_value(prev) as prev, any_value(nxt) as nxt, bool_or(allowed or anchor) as skip, bool_or(district) as district, bool_or(coalesce(fclass in ('P', 'T') and pop > 50000 and not own_city, false)) as large, bool_or(word = raw and brand) as rbrand from fl group by 1, 2, 3),
ok as (select ag.*, lc.pos, lc.cas, lc.named, pc.pos as ppos, pc.cas as pcas from ag left join lc on lc.word = raw left join lc pc on pc.word = prev where not skip and (not district or large)
  and not (raw <> norm and regexp_matches(raw, '(ский|ская|ское|ской|ским|ского|ских)$') and coalesce(nxt = 'район', false)) and not coalesce(prev = 'жк', false)),
si as (select o.seed_id, o.keyword, arg_min(fl.word, case when fl.word = fl.raw then 0 else 1 end) as name, arg_min(fl.own_city, case when fl.word = fl.raw then 0 else 1 end) as own from ok o join fl on fl.seed_id = o.seed_id and fl.keyword = o.keyword and fl.i = o.i
  where not coalesce(o.pos = 'NOUN' and not o.named, false) and not coalesce(o.cas = 'gent' and pcas = 'gent' and ppos = 'NOUN', false) and fl.pop is not null and length(fl.word) > 3 and not fl.brand and not o.rbrand
    and not (fl.fclass = 'A' and fl.own_region and coalesce(o.pos = 'ADJF', false)) and (coalesce(o.prev = 'в', false) or fl.pop > 50000) group by o.seed_id, o.keyword, o.i),
bi as (select tk.seed_id, keyword, raw || ' ' || nxt as name from tk join pw on pw.name = raw || ' ' || nxt and pw.pop > 50000 where not exists (select 1 from ow where ow.seed_id = tk.seed_id and ow.stem = {_STEM.format("raw || ' ' || nxt")}))
select seed_id, keyword, string_agg(distinct name, ',' order by name) as cities from (select seed_id, keyword, name from si where not own union all select * from bi) group by 1, 2"""

_FOREIGN = _KW + """,
rg as (select c || ' область' as name, 'europe' as country from b where size = 4 union all select c, case when code % 2 = 0 then 'africa' else 'asia' end from b where size = 5),
di as (select c as name from b where size = 4 and code % 2 = 0),
gr as (select seed_id, keyword, 1 as n, unnest(range(1, len(w) + 1)) as i, unnest(w) as term from (select *, string_split(keyword, ' ') as w from kw)
  union all select seed_id, keyword, 2, unnest(range(1, len(w))), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from (select *, string_split(keyword, ' ') as w from kw)),
hi as (select gr.*, rg.country <> 'asia' as away from gr left join rg on rg.name = term left join di on di.name = term where rg.name is not null or di.name is not null)
select seed_id, keyword, 'region:' || arg_min(term, n * 100 + i) filter (away) as reason from hi group by 1, 2 having bool_or(away) and (bool_or(away and n = 1) or bool_or(n = 1))"""

QUERIES = {
    "place_lookup": (lookup, _LOOKUP),
    "word_features": (features, _FEATURES),
    "region_adjectives": (adjectives, _ADJECTIVES),
    "other_regions": (regions, _REGIONS),
    "foreign_regions": (foreign, _FOREIGN),
    "other_cities": (other, _OTHER),
}
