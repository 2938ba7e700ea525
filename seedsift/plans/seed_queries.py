"""Queries of what keywords show of their seed, with SQL that gives the same rows.

Seeds have words in Cyrillic letters, a Latin line, a model or a number, by their part's key. Line items give keywords with all,
some or none of the seed. The Cyrillic spelling is a plain substitution of letters, so names often sound alike in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import seed_match, statistics, tails
from seedsift.plans.place_queries import _cy, cyrillic
from seedsift.sources import tables as S
from seedsift.sources.shared import written


def _parts(spark, sf):
    part = S.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_size") % 4).cast("string").alias("size"), F.lower("p_name").alias("nm"), F.lower("p_type").alias("ty"))
    words = X.words("nm")
    df = part.select("*", F.get(words, F.lit(0)).alias("n1"), F.get(words, F.lit(1)).alias("n2"))
    c1, c2, ct, k = cyrillic("n1"), cyrillic("n2"), cyrillic("ty"), F.col("p_partkey") % 5
    kinds = [(c1, c2), (c1, c2, ct), (c1, F.col("n2"), F.concat(F.lit("s"), "size")), (c2, F.col("n1"), F.col("size")), (c1, F.col("n2"), F.col("ty"))]
    return df.withColumn("seed", F.coalesce(*(F.when(k == i, F.concat_ws(" ", *x)) for i, x in enumerate(kinds))))


def _seeds(spark, sf):
    return _parts(spark, sf).groupBy("seed").agg(F.min("p_partkey").alias("seed_id")).select("seed_id", "seed")


def _lexicon(spark, sf):
    part, w, size = _parts(spark, sf), F.col("w"), F.length("w")
    words = part.select(F.explode(F.array("n1", "n2", "ty")).alias("w")).distinct()
    pos = F.when(size == 3, "ADJF").when(size == 7, "PREP").otherwise("NOUN")
    case = F.when(F.ascii(w) % 2 == 0, "nomn").otherwise("gent")
    base = words.select(cyrillic(w).alias("word"), F.lit(0).alias("rank"), cyrillic(w).alias("lemma"), pos.alias("pos"), case.alias("case"))
    return base.unionByName(base.withColumn("word", F.concat("word", F.lit("ом"))))


def _brands(spark, sf):
    part = _parts(spark, sf)
    latin = part.where("length(n2) = 5").select(F.col("n2").alias("name"))
    return latin.unionByName(part.where("length(n2) = 4").select(cyrillic("n2").alias("name"))).distinct()


def _keywords(spark, sf):
    """(seed_id, seed, keyword), distinct.

    Line items pass the joins with keys and one word of their other part. Their texts are made of words that stand ready in the part's row, so
    that equal ones go before they are shuffled, and only distinct ones look up their seed. The parts are shuffled: by the size of their
    files Spark would send millions of them through the driver.
    """
    part, item = _parts(spark, sf), S.table(spark, sf, "lineitem")
    shape, se = (F.col("l_orderkey") + F.col("l_linenumber")) % 12, F.concat(cyrillic(F.lit("s")), "size")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), "n2", cyrillic("n1").alias("c1"), cyrillic("n2").alias("c2")).hint("shuffle_hash")
    word = F.when(shape == 0, F.col("c2")).when(shape == 9, F.col("n2")).when(shape.isin(2, 6, 10), F.col("c1"))
    item = item.join(other, "l_suppkey").select("l_partkey", shape.alias("pick"), word.alias("o"))
    ready = {"c1": cyrillic("n1"), "c2": cyrillic("n2"), "ct": cyrillic("ty"), "om": F.concat(cyrillic("n2"), F.lit("ом")), "se": se, "fe": F.concat(se, F.lit("fe")), "s1": F.concat(F.lit("s"), "size", F.lit("1"))}
    wide = item.join(part.withColumns(ready).withColumnRenamed("p_partkey", "l_partkey").hint("shuffle_hash"), "l_partkey")
    shapes = [
        ("seed", "o"), ("c1", "c2"), ("o", "c2", "ct"), ("c1", "n2", "fe"), ("c1", "c2", "se"), ("n1", "c2", F.lit("2")), (F.lit("огляд"), "o", "n2"), ("c1", F.lit("їх")),
        ("om", "c1"), ("o", "s1"), ("c1", "om", "o"), (F.lit("5"), "c1"),
    ]
    text = F.coalesce(*(F.when(F.col("pick") == i, F.concat_ws(" ", *s)) for i, s in enumerate(shapes)))
    return wide.select("seed", text.alias("keyword")).distinct().join(_seeds(spark, sf), "seed").select("seed_id", "seed", "keyword")


def _profiles(spark, sf, lexicon):
    return seed_match.seed_profiles(_seeds(spark, sf), lexicon, _brands(spark, sf))


def profiles(spark, sf):
    joined = {c: F.array_join(c, ",") for c in ("numbers", "line", "models", "latin_brands", "latin_models")}
    out = _profiles(spark, sf, _lexicon(spark, sf)).withColumns(joined)
    return out.withColumn("content", F.array_join(F.transform("content", lambda x: F.array_join(x, "+")), ","))


def rules(spark, sf):
    """All keywords as if their seed had not been found, but for those that hold it whole."""
    lexicon = written(_lexicon(spark, sf))
    kw = _keywords(spark, sf).withColumn("tail", F.when(F.contains("keyword", F.col("seed")), F.trim(F.replace("keyword", F.col("seed"), F.lit("")))))
    return seed_match.no_seed_rules(kw, _profiles(spark, sf, lexicon)).drop("seed", "tail")


def demotions(spark, sf):
    lexicon = written(_lexicon(spark, sf))
    kw = written(_keywords(spark, sf).select("seed_id", "keyword"))
    return seed_match.sanity_demotions(kw, written(_profiles(spark, sf, lexicon)), lexicon, _brands(spark, sf))


def short(spark, sf):
    """Keywords of seeds that may lose their last word and are found without it only, beside the tail."""
    lexicon = written(_lexicon(spark, sf))
    kw = _keywords(spark, sf).where(~F.contains("keyword", F.col("seed"))).select("seed_id", "keyword", F.lit(None).cast("string").alias("tail"))
    return seed_match.short_seed_tails(written(kw), written(_profiles(spark, sf, lexicon)), lexicon).where("tail is not null")


def demoted_l2(spark, sf):
    """What the statistics make of grey keywords, those that were demoted among them. A keyword is grey unless it holds its seed and lacks nothing.

    Every grey tail is decided, and every keyword with a tail counts in its frequencies. Of a tail's grey keywords the least one says whether it was demoted.
    """
    lexicon = written(_lexicon(spark, sf))
    kw, seeds, brands = written(_keywords(spark, sf)), written(_seeds(spark, sf)), written(_brands(spark, sf))
    profiled = written(seed_match.seed_profiles(seeds, lexicon, brands))
    judged = written(seed_match.sanity_demotions(kw, profiled, lexicon, _brands(spark, sf)))
    tail = F.array_join(F.filter(X.words("keyword"), lambda w: ~F.array_contains(X.words("seed"), w)), " ")
    label = F.when(F.contains("keyword", F.col("seed")) & F.col("demoted_reason").isNull(), "VALID").otherwise("GREY")
    none = F.array().cast("array<string>")
    kw = judged.select("seed_id", F.col("keyword").alias("pos"), tail.alias("tail"), label.alias("label"), none.alias("positive"), none.alias("negative"), F.col("demoted_reason").isNotNull().alias("demoted"))
    decided = statistics.l2_decisions(kw, 2.0)
    return decided.select("seed_id", "tail", "rule", F.round("pmi", 6).alias("pmi"), "l2_label")


_BASE = f"""with p0 as (select p_partkey::bigint as p_partkey, (p_size % 4)::varchar as size, string_split(lower(p_name), ' ')[1] as n1, string_split(lower(p_name), ' ')[2] as n2, lower(p_type) as ty from part),
p1 as (select *, {_cy('n1')} as c1, {_cy('n2')} as c2, {_cy('ty')} as ct from p0),
pt as (select *, case p_partkey % 5 when 0 then c1 || ' ' || c2 when 1 then c1 || ' ' || c2 || ' ' || ct when 2 then c1 || ' ' || n2 || ' s' || size when 3 then c2 || ' ' || n1 || ' ' || size else c1 || ' ' || n2 || ' ' || ty end as seed from p1),
sd as (select min(p_partkey) as seed_id, seed from pt group by seed),
lb as (select {_cy('w')} as word, {_cy('w')} as lemma, case length(w) when 3 then 'ADJF' when 7 then 'PREP' else 'NOUN' end as pos, case when ascii(w) % 2 = 0 then 'nomn' else 'gent' end as cas from (select distinct unnest([n1, n2, ty]) as w from p0)),
lx as (select * from lb union all select word || 'ом', lemma, pos, cas from lb),
br as (select distinct n2 as name from p0 where length(n2) = 5 union select c2 from p1 where length(n2) = 4),
kw as (select distinct sd.seed_id, sd.seed, case (l_orderkey + l_linenumber) % 12 when 0 then sd.seed || ' ' || o.c2 when 1 then p.c1 || ' ' || p.c2 when 2 then o.c1 || ' ' || p.c2 || ' ' || p.ct when 3 then p.c1 || ' ' || p.n2 || ' ' || {_cy("'s'")} || p.size || 'fe'
    when 4 then p.c1 || ' ' || p.c2 || ' ' || {_cy("'s'")} || p.size when 5 then p.n1 || ' ' || p.c2 || ' 2' when 6 then 'огляд ' || o.c1 || ' ' || p.n2 when 7 then p.c1 || ' їх' when 8 then p.c2 || 'ом ' || p.c1 when 9 then o.n2 || ' s' || p.size || '1'
    when 10 then p.c1 || ' ' || p.c2 || 'ом ' || o.c1 else '5 ' || p.c1 end as keyword
  from lineitem join pt p on l_partkey = p.p_partkey join pt o on l_suppkey = o.p_partkey join sd on sd.seed = p.seed),
st as (select seed_id, i, t.word, coalesce(lemma, t.word) as lemma, pos, cas, t.word in (select name from br) or coalesce(lemma, t.word) in (select name from br) as brand, regexp_full_match(t.word, '[0-9]+') as num
  from (select seed_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select seed_id, string_split(seed, ' ') as w from sd)) t left join lx on lx.word = t.word),
pr as (select seed_id, count(*) as n_words, coalesce(list(word order by i) filter (num), []) as numbers, coalesce(list(word order by i) filter (regexp_full_match(word, '[a-z]+')), []) as line,
    coalesce(list(word order by i) filter (num or (regexp_full_match(word, '[a-z0-9]+') and regexp_matches(word, '[a-z]') and regexp_matches(word, '[0-9]'))), []) as models, coalesce(list(lemma order by i) filter (not num and pos in ('NOUN', 'ADJF')), []) as content,
    coalesce(list(word order by i) filter (not num and pos is null and regexp_matches(word, '[a-z]') and brand), []) as latin_brands, coalesce(list(word order by i) filter (not num and pos is null and regexp_matches(word, '[a-z]') and not brand), []) as latin_models,
    case when count(*) >= 3 and arg_max(pos, i) = 'NOUN' and max(case when i = 2 then pos end) = 'NOUN' and arg_max(cas, i) in ('nomn', 'accs') then string_agg(word, ' ' order by i) filter (i < 3) end as short_seed
  from st group by 1),
pf as (select *, case when len(models) > 0 then 'A' when len(line) > 0 then 'B' else 'none' end as seed_class from pr)"""

_PROFILES = _BASE + """ select seed_id, n_words::int as n_words, seed_class, short_seed, array_to_string(numbers, ',') as numbers, array_to_string(line, ',') as line, array_to_string(models, ',') as models, array_to_string(content, ',') as content,
  array_to_string(latin_brands, ',') as latin_brands, array_to_string(latin_models, ',') as latin_models from pf"""

_CODES = {**tails.LATIN_LETTERS}
_SOUND = "translate({0}, '" + "".join(k for k, v in _CODES.items() if len(v) == 1) + "', '" + "".join(v for v in _CODES.values() if len(v) == 1) + "')"
for _k, _v in (*((k, v) for k, v in _CODES.items() if len(v) != 1), *tails.ONE_SOUND):
    _SOUND = f"replace({_SOUND}, '{_k}', '{_v}')"
_SOUND = f"regexp_replace({_SOUND}, '[^a-z]', '', 'g')"
_MODEL = "translate({0}, '" + "".join(k for k, v in seed_match.MODEL_LETTERS.items() if v) + "ъь', '" + "".join(v for v in seed_match.MODEL_LETTERS.values() if v) + "')"

_RULES = _BASE + f""",
wd as (select distinct unnest(string_split(keyword, ' ')) as word from kw),
ln as (select distinct unnest(line) as b from pf),
ax as (select word, b, {_SOUND.format('word')} as x, {_SOUND.format('b')} as y from wd, ln where regexp_matches(word, '[Ѐ-ӿ]')),
al as (select word, b from ax where length(x) > 0 and length(y) > 0 and 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.5
  and len(list_intersect(list_transform(range(1, length(x)), lambda i: x[i:i + 1]), list_transform(range(1, length(y)), lambda i: y[i:i + 1])))
    >= 0.2 * len(list_distinct(list_transform(range(1, length(x)), lambda i: x[i:i + 1]) || list_transform(range(1, length(y)), lambda i: y[i:i + 1]))) and greatest(length(x), length(y)) > 1),
mo as (select distinct unnest(models) as m from pf),
mm as (select word, m from (select word, m, {_MODEL.format('word')} as a, {_MODEL.format('m')} as b from wd, mo) where a = b or (length(a) > length(b) and starts_with(a, b) and not regexp_matches(substr(a, length(b) + 1, 1), '[0-9]'))),
kd as (select kw.seed_id, keyword, contains(keyword, seed) as whole, string_split(keyword, ' ') as w, regexp_extract_all(' ' || replace(keyword, ' ', '  ') || ' ', ' ([0-9]+) ', 1) as nums, pf.* exclude (seed_id) from kw join pf on pf.seed_id = kw.seed_id)
select seed_id, keyword, case when regexp_matches(keyword, '[іїєґІЇЄҐ]') then 'wrong_language:letter' when whole then null when list_contains(w, 'огляд') then 'wrong_language:огляд'
    when len(numbers) > 0 and len(nums) > 0 and not list_has_any(nums, numbers) then 'wrong_number:' || array_to_string(list_sort(list_distinct(nums)), ',')
    when seed_class = 'B' and not list_has_any(w, line) and not exists (select 1 from al where list_contains(w, al.word) and list_contains(line, b)) then 'wrong_brand'
    when seed_class = 'A' and not exists (select 1 from mm where list_contains(w, mm.word) and list_contains(models, m)) then 'wrong_model' end as no_seed_reason from kd"""

_JUDGED = _BASE + f""",
wl as (select w.word, coalesce(lemma, w.word) as lemma, w.word in (select name from br) or coalesce(lemma, w.word) in (select name from br) as brand from (select distinct unnest(string_split(keyword, ' ')) as word from kw) w left join lx on lx.word = w.word),
wm as (select map(list(word), list(lemma)) as m, map(list(word), list(brand)) as b from wl),
k1 as (select kw.seed_id, kw.seed, keyword, string_split(keyword, ' ') as w, pf.* exclude (seed_id) from kw join pf on pf.seed_id = kw.seed_id),
k2 as (select *, list_transform(w, lambda x: m[x]) as l, list_bool_or(list_transform(w, lambda x: b[x] and regexp_matches(x, '[Ѐ-ӿ]'))) as cyr, list_transform(list_filter(w, lambda x: regexp_matches(x, '[Ѐ-ӿ]')), lambda x: {_MODEL.format('x')}) as tr from k1, wm),
k3 as (select *, list_sort(list_filter(latin_models, lambda x: not list_contains(w || l, x) and not list_contains(tr, x)))[1] as lost, list_filter(content, lambda x: not list_contains(w, x) and not list_contains(l, x)) as missing, len(latin_brands) + len(latin_models) > 0 as latin from k2),
jd as (select seed_id, seed, keyword, w, case when lost is not null then 'missing_model:' || lost when len(latin_brands) > 0 and not list_has_any(latin_brands, w || l) and not coalesce(cyr, false) then 'missing_brand' when latin and len(missing) > 0 then 'missing_intent:' || missing[1]
  when not latin and len(missing) > case when n_words <= 2 then 0 else 1 end then 'missing_content:' || array_to_string(missing[1:3], ',') end as demoted_reason from k3)"""

_SHORT = _BASE + r""",
wl as (select w.word, coalesce(lemma, w.word) as lemma from (select distinct unnest(string_split(keyword, ' ')) as word from kw) w left join lx on lx.word = w.word),
wm as (select map(list(word), list(lemma)) as m from wl),
k1 as (select kw.seed_id, keyword, string_split(keyword, ' ') as w, string_split(short_seed, ' ') as s, short_seed from kw join pf on pf.seed_id = kw.seed_id where short_seed is not null and not contains(keyword, kw.seed)),
k2 as (select *, list_transform(w, lambda x: m[x]) as l from k1, wm where list_has_all(list_transform(w, lambda x: m[x]), s)),
k3 as (select *, contains(' ' || keyword || ' ', ' ' || short_seed || ' ') as whole, list_position(l, s[1]) as a, list_position(l, s[2]) as b from k2)
select seed_id, keyword, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i <> a and i <> b), lambda i: w[i]), ' ') as tail from k3"""

_L2 = _JUDGED + r""",
kt as (select seed_id, keyword, array_to_string(list_filter(w, lambda x: not list_contains(string_split(seed, ' '), x)), ' ') as tail, contains(keyword, seed) and demoted_reason is null as ok, demoted_reason is not null as demoted from jd),
k as (select * from kt where tail <> ''),
tw as (select seed_id, keyword, tail, unnest(list_distinct(string_split(tail, ' '))) as word from k),
df as (select seed_id, word, count(*) as n from tw group by 1, 2),
pm as (select tw.seed_id, tail, min(log2(n + 1)) as lo, min(log2(n + 1)) filter (length(tw.word) > 2 or regexp_full_match(tw.word, '[0-9]+')) as co from tw join df on df.seed_id = tw.seed_id and df.word = tw.word group by 1, 2),
gt as (select k.seed_id, k.tail, arg_min(demoted, keyword) as demoted, any_value(coalesce(co, lo)) as pmi from k join pm on pm.seed_id = k.seed_id and pm.tail = k.tail where not ok group by 1, 2),
ru as (select *, case when demoted then 'r0_demoted' when pmi >= 2 then 'r1_pmi' when len(list_filter(string_split(tail, ' '), lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[a-zа-яё]'))) > 0 then 'r28_spec' else 'r6_grey' end as rule from gt)
select seed_id, tail, rule, round(pmi, 6) as pmi, case when rule in ('r1_pmi', 'r28_spec') then 'VALID' else 'GREY' end as l2_label from ru"""

QUERIES = {
    "seed_profiles": (profiles, _PROFILES),
    "no_seed_rules": (rules, _RULES),
    "sanity_demotions": (demotions, _JUDGED + " select seed_id, keyword, demoted_reason from jd"),
    "short_seed_tails": (short, _SHORT),
    "demoted_l2": (demoted_l2, _L2),
}
