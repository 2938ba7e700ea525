"""Queries of word forms, probes from other spellings, and small readers, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import clusters, expand, fold, morph_probes, morphology, near_forms, statistics
from seedsift.plans.place_queries import _cy, cyrillic
from seedsift.sources import tables as S
from seedsift.sources.shared import written


def _part(spark, sf):
    part = S.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.lower("p_name").alias("nm"), F.lower("p_type").alias("ty"))
    return part.select("*", F.get(X.words("nm"), F.lit(0)).alias("n1"), F.get(X.words("nm"), F.lit(1)).alias("n2"))


def _cyr_seeds(spark, sf):
    """(seed_id, seed): distinct part names in Cyrillic letters."""
    return _part(spark, sf).groupBy(cyrillic("nm").alias("seed")).agg(F.min("p_partkey").alias("seed_id")).select("seed_id", "seed")


def _base(spark, sf):
    return _part(spark, sf).select(F.explode(F.array("n1", "n2", "ty")).alias("w")).distinct()


def _lexicon(spark, sf):
    """Nouns and adjectives with two numbers, two cases and, for adjectives, two genders; verbs of nouns that end in ка or have five letters or more."""
    w, size, code = F.col("w"), F.length("w"), F.ascii("w")
    c = cyrillic("w")
    adjective = size == 5
    forms = [("", "nomn", "sing", "masc"), ("ом", "ablt", "sing", "masc"), ("ы", "nomn", "plur", None), ("ам", "datv", "plur", None), ("ая", "nomn", "sing", "femn"), ("ой", "gent", "sing", "femn")]
    made = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(k).alias("case"), F.lit(n).alias("number"), F.lit(g).cast("string").alias("gender")) for e, k, n, g in forms))
    rows = _base(spark, sf).withColumn("f", F.explode(made)).where(adjective | (F.length("f.e") < 2) | F.col("f.case").isin("ablt", "datv"))
    none = F.array().cast("array<string>")
    rows = rows.select(F.concat(c, "f.e").alias("word"), F.lit(0).alias("rank"), c.alias("lemma"), F.when(adjective, "ADJF").otherwise("NOUN").alias("pos"), "f.case", "f.number", "f.gender", (size / 10.0).alias("score"), none.alias("grammemes"))
    tran = F.when(code % 3 != 0, F.array(F.lit("tran"))).otherwise(none)
    verbs = _base(spark, sf).where("length(w) > 3").select(F.concat(c, F.lit("ировать")).alias("word"), F.lit(0).alias("rank"), F.concat(c, F.lit("ировать")).alias("lemma"), F.lit("INFN").alias("pos"), F.lit(None).cast("string").alias("case"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("gender"), F.when(code % 2 == 1, 0.95).otherwise(0.5).alias("score"), tran.alias("grammemes"))
    return rows.unionByName(verbs)


def _pairs(spark, sf):
    base = _base(spark, sf)
    forms = base.select(F.explode(F.array(F.col("w"), F.concat("w", F.lit("s")), F.reverse("w"), F.expr("concat(substring(w, 1, 2), substring(w, 4, 9))"))).alias("a")).distinct()
    # A word of names against the changed forms of words with the same first letter.
    left = base.withColumn("k", F.substring("w", 1, 1))
    return left.join(forms.withColumn("k", F.substring("a", 1, 1)), "k").select("a", F.initcap("w").alias("b"))


def ratios(spark, sf):
    pairs = _pairs(spark, sf)
    scored = near_forms.alike(pairs.select("a", F.lower("b").alias("b")), 0.5).select("a", F.col("b").alias("_l"), F.round("ratio", 6).alias("ratio"))
    return near_forms.nearly_same(pairs).withColumn("_l", F.lower("b")).join(scored, ["a", "_l"]).select("a", "b", "same", "ratio")


def _kw(spark, sf):
    """(seed_id, seed, keyword, language), distinct: forms of the seed's words and of other words."""
    part, item = _part(spark, sf), S.table(spark, sf, "lineitem")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("n1").alias("o1"), F.col("n2").alias("o2"), F.col("ty").alias("ot"))
    seeds = _cyr_seeds(spark, sf).withColumnRenamed("seed", "_c")
    wide = item.join(part, item["l_partkey"] == part["p_partkey"]).join(other, "l_suppkey").join(seeds, cyrillic("nm") == F.col("_c"))
    k, latin = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("seed_id") % 2 == 0
    n1, n2, o1, o2, ot = (F.col(c) for c in ("n1", "n2", "o1", "o2", "ot"))
    shapes = [(F.concat(n1, F.lit("s")), n2), (n1, F.concat(n2, F.lit("x1")), o2), (F.upper(o1), F.concat(o2, F.lit("s"))), (F.concat(n2, F.lit("es")), ot), (o1, F.lit("16-pro"), n2), (F.concat(ot, F.lit("s")), o2)]
    cyr = [(F.concat(cyrillic("n1"), F.lit("ом")), cyrillic("n2")), (F.concat(cyrillic("n1"), F.lit("ы")), F.concat(cyrillic("n2"), F.lit("ам")), cyrillic("o2")), (F.upper(cyrillic("o1")), F.concat(cyrillic("o2"), F.lit("ом"))),
           (F.concat(cyrillic("n2"), F.lit("ой")), cyrillic("ot")), (F.concat(cyrillic("o1"), F.lit("ой")), F.lit("s21"), cyrillic("n2")), (F.concat(cyrillic("ot"), F.lit("ая")), cyrillic("o2"))]
    text = F.coalesce(*(F.when(latin & (k == i), F.concat_ws(" ", *s)) for i, s in enumerate(shapes)), *(F.when(k == i, F.concat_ws(" ", *s)) for i, s in enumerate(cyr)))
    return wide.select("seed_id", F.when(latin, F.col("nm")).otherwise(F.col("_c")).alias("seed"), text.alias("keyword"), F.when(F.col("seed_id") % 4 == 0, "en-US").when(F.col("seed_id") % 4 == 2, "xx").otherwise("auto").alias("language")).distinct()


def aligned(spark, sf):
    return near_forms.align_to_seed(written(_kw(spark, sf))).select("seed_id", "keyword", "aligned")


def normalized(spark, sf):
    kw = written(_kw(spark, sf))
    stems = _base(spark, sf).select(F.explode(F.array(F.concat("w", F.lit("s")), F.concat("w", F.lit("es")))).alias("word"), F.lit("en").alias("language"), F.col("w").alias("stem"))
    return near_forms.normalize_phrases(kw, _lexicon(spark, sf), stems).select("seed_id", "keyword", "normalized")


def variants(spark, sf):
    return morph_probes.seed_variants_exp(_cyr_seeds(spark, sf), _lexicon(spark, sf))


def triggers(spark, sf):
    return morph_probes.trigger_probes(_cyr_seeds(spark, sf), spark)


def morph(spark, sf):
    """The experiments' probes behind suffixes, and those with other endings."""
    seeds = _cyr_seeds(spark, sf)
    return morph_probes.expand_morph(seeds, morph_probes.seed_variants_exp(seeds, _lexicon(spark, sf)), spark, ("exp", "sep"), letters=False)


def services(spark, sf):
    raw = _cyr_seeds(spark, sf)
    return expand.analyze_seeds(raw.withColumn("seed", F.concat("seed", F.when(F.col("seed_id") % 3 == 0, " купить").otherwise(""))), _lexicon(spark, sf)).select("seed_id", "seed", F.array_join("markers", ",").alias("markers"), "level", "has_digit")


def priorities(spark, sf):
    seeds = expand.analyze_seeds(_cyr_seeds(spark, sf), _lexicon(spark, sf))
    return expand.probe_priority(expand.expand_suffix(seeds, spark)).select("seed_id", "grp", "struct", "priority")


def forms(spark, sf):
    words = _base(spark, sf).select(cyrillic("w").alias("word"))
    return morphology.word_forms(words, _lexicon(spark, sf))


def cases(spark, sf):
    return morphology.seed_variants_case(_cyr_seeds(spark, sf), _lexicon(spark, sf))


def questions(spark, sf):
    kw = S.keywords(spark, sf).select("seed_id", "keyword")
    return statistics.question_anchors(kw, ("brand#12", "nation_3", "brand#23", "large"))


def ordered(spark, sf):
    """Folded keywords with their place in the order of their seed's reply."""
    folded = fold.fold_keywords(S.fetch_log(spark, sf).where("n_results > 0"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("weight"), "keyword"))
    return fold.by_weight(folded).select("seed_id", "keyword", "weight", place.alias("place"))


def inputs(spark, sf):
    part = _part(spark, sf)
    rows = part.groupBy("nm").agg(F.array_sort(F.collect_set("ty")).alias("keywords"), F.min("p_partkey").alias("k"))
    rows = rows.select(F.col("nm").alias("seed"), "keywords", F.when(F.col("k") % 2 == 0, "Asia").alias("region"), F.when(F.col("k") % 3 == 0, "en").alias("language"))
    return clusters.cluster_inputs(rows)


_P = f"""with pt as (select p_partkey::bigint as p_partkey, lower(p_name) as nm, lower(p_type) as ty, string_split(lower(p_name), ' ')[1] as n1, string_split(lower(p_name), ' ')[2] as n2 from part),
cs as (select min(p_partkey) as seed_id, {_cy('nm')} as seed from pt group by seed),
bw as (select distinct unnest([n1, n2, ty]) as w from pt),
lx as (select {_cy('w')} || e as word, {_cy('w')} as lemma, case when length(w) = 5 then 'ADJF' else 'NOUN' end as pos, cas, num, gen, length(w) / 10.0 as score, false as tran from bw, (values ('', 'nomn', 'sing', 'masc'), ('ом', 'ablt', 'sing', 'masc'), ('ы', 'nomn', 'plur', null), ('ам', 'datv', 'plur', null), ('ая', 'nomn', 'sing', 'femn'), ('ой', 'gent', 'sing', 'femn')) f(e, cas, num, gen)
    where length(w) = 5 or length(e) < 2 or cas in ('ablt', 'datv')
  union all select {_cy('w')} || 'ировать', {_cy('w')} || 'ировать', 'INFN', null, null, null, case when ascii(w) % 2 = 1 then 0.95 else 0.5 end, ascii(w) % 3 <> 0 from bw where length(w) > 3)"""

#: Matching blocks by recursion: each open pair of pieces gives its longest common run, the first in both, and the pieces on either side.
_BLOCKS = """,
mb(a, b, x, y, n) as (select a, b, a, b, 0 from (select distinct a, b from dp) union all
  select a, b, unnest([x[:i - 1], x[i + k:]]), unnest([y[:j - 1], y[j + k:]]), unnest([k, 0]) from (
    select mb.a, mb.b, x, y, (select arg_max({'i': i, 'j': j, 'k': k}, k * 10000 - i * 100 - j) from (select i, j, k from range(1, length(x) + 1) r(i), range(1, length(y) + 1) s(j), range(1, least(length(x), length(y)) + 1) t(k) where x[i:i + k - 1] = y[j:j + k - 1] and i + k - 1 <= length(x) and j + k - 1 <= length(y))) as m from mb where x <> '' and y <> '') q, lateral (select m.i as i, m.j as j, m.k as k) where m is not null),
ra as (select a, b, 2.0 * sum(n) / (length(a) + length(b)) as ratio from mb group by a, b)"""

_RATIOS = _P.replace("with pt", "with recursive pt", 1) + """,
fo as (select distinct unnest([w, w || 's', reverse(w), w[:2] || w[4:]]) as a from bw),
pa as (select a, upper(w[1]) || w[2:] as b from bw join fo on a[1] = w[1]),
dp as (select a, lower(b) as b from pa)""" + _BLOCKS + " select pa.a, pa.b, ratio > 0.8 as same, round(ratio, 6) as ratio from pa join ra on ra.a = pa.a and ra.b = lower(pa.b) where ratio >= 0.5"

_KW = f""",
kw as (select distinct seed_id, case when seed_id % 2 = 0 then nm else c end as seed, case seed_id % 4 when 0 then 'en' when 2 then case when false then '' end end as lang0, case when seed_id % 2 = 0 then
    case k when 0 then n1 || 's ' || n2 when 1 then n1 || ' ' || n2 || 'x1 ' || o2 when 2 then upper(o1) || ' ' || o2 || 's' when 3 then n2 || 'es ' || ot when 4 then o1 || ' 16-pro ' || n2 else ot || 's ' || o2 end
    else case k when 0 then {_cy('n1')} || 'ом ' || {_cy('n2')} when 1 then {_cy('n1')} || 'ы ' || {_cy('n2')} || 'ам ' || {_cy('o2')} when 2 then upper({_cy('o1')}) || ' ' || {_cy('o2')} || 'ом' when 3 then {_cy('n2')} || 'ой ' || {_cy('ot')} when 4 then {_cy('o1')} || 'ой s21 ' || {_cy('n2')} else {_cy('ot')} || 'ая ' || {_cy('o2')} end end as keyword
  from (select cs.seed_id, p.nm, cs.seed as c, p.n1, p.n2, o.n1 as o1, o.n2 as o2, o.ty as ot, (l_orderkey + l_linenumber) % 6 as k from lineitem join pt p on l_partkey = p.p_partkey join pt o on l_suppkey = o.p_partkey join cs on cs.seed = {_cy('p.nm')}))"""

_ALIGNED = _P.replace("with pt", "with recursive pt", 1) + _KW + """,
kt as (select seed_id, keyword, seed, unnest(range(1, len(w) + 1)) as i, unnest(w) as tok from (select *, string_split(keyword, ' ') as w from kw)),
st as (select distinct seed, unnest(range(1, len(w) + 1)) as pl, unnest(w) as s from (select distinct seed, string_split(seed, ' ') as w from kw)),
pr as (select distinct kt.seed, lower(tok) as a, s as b, pl from kt join st on st.seed = kt.seed),
dp as (select distinct a, b from pr)""" + _BLOCKS + """,
ok as (select pr.seed, pr.a, arg_max(pr.b, pl) as s from pr join ra on ra.a = pr.a and ra.b = pr.b where pr.a = pr.b or (length(pr.a) >= 5 and length(pr.b) >= 5 and pr.a[:5] = pr.b[:5]) or ratio >= 0.7 group by 1, 2)
select seed_id, keyword, string_agg(coalesce(ok.s, tok), ' ' order by i) as aligned from kt left join ok on ok.seed = kt.seed and ok.a = lower(tok) group by 1, 2"""

_NORMALIZED = _P.replace("with pt", "with recursive pt", 1) + _KW + """,
lg as (select seed_id, case when seed_id % 4 = 0 then 'en' when bool_or(regexp_matches(seed || ' ' || keyword, '[іїєґІЇЄҐ]')) then 'uk' when bool_or(regexp_matches(seed || ' ' || keyword, '[а-яА-ЯёЁ]')) then 'ru' else 'en' end as lang from kw group by 1),
kt as (select kw.seed_id, keyword, seed, lang, unnest(range(1, len(w) + 1)) as i, unnest(w) as tok from (select *, regexp_extract_all(lower(keyword), '[a-zа-яёіїєґ0-9-]+') as w from kw) kw join lg on lg.seed_id = kw.seed_id),
no as (select word, arg_min(form, (other, form)) as form from (select l.word, n.word as form, not coalesce(n.gen = l.gen, false) as other from lx l join lx n on n.lemma = l.lemma and n.pos = l.pos and n.num = l.num and n.cas = 'nomn' where l.pos <> 'INFN') group by 1),
em as (select unnest([w || 's', w || 'es']) as word, min(w) as stem from bw group by w, word),
b as (select kt.*, case when regexp_matches(tok, '[0-9]') or (regexp_matches(tok, '[a-z]') and regexp_matches(tok, '[а-яё]')) or (contains(tok, '-') and regexp_matches(tok, '[a-z]')) then tok when lang = 'en' then coalesce(stem, tok) else coalesce(no.form, lx1.lemma, tok) end as form
  from kt left join no on no.word = tok left join (select word, min(lemma) as lemma from lx group by 1) lx1 on lx1.word = tok left join (select word, min(stem) as stem from em group by 1) em1 on em1.word = tok),
st as (select distinct seed, unnest(range(1, len(w) + 1)) as pl, unnest(w) as s from (select distinct seed, string_split(seed, ' ') as w from kw)),
dp as (select distinct form as a, s as b from b join st on st.seed = b.seed where lang = 'en')""" + _BLOCKS + """,
ow as (select b.seed, b.form, arg_min(s, pl) as s from (select distinct seed, form from b where lang = 'en') b join st on st.seed = b.seed join ra on ra.a = form and ra.b = s where ratio >= 0.97 group by 1, 2)
select seed_id, keyword, string_agg(case when lang = 'en' then coalesce(ow.s, b.form) else b.form end, ' ' order by i) as normalized from b left join ow on ow.seed = b.seed and ow.form = b.form group by 1, 2"""

_LOOK, _INTO = "".join(morph_probes.LOOK_ALIKE), "".join(morph_probes.LOOK_ALIKE.values())
_VARIANTS = _P + f""",
v0 as (select seed_id, seed, string_split(seed, ' ') as w from cs),
nn as (select *, case when exists (select 1 from lx where lx.word = w[1] and pos = 'NOUN') then 1 when exists (select 1 from lx where lx.word = w[2] and pos = 'NOUN') then 2 end as at_ from v0),
n2 as (select *, w[at_] as nw, case at_ when 1 then 2 else 1 end as ot from nn where at_ is not null),
fm as (select seed_id, seed, w, 'typo_w1' as label, at_ as k, nw[1] || nw as x from n2
  union all select seed_id, seed, w, 'cyr2lat_w1', at_, case when regexp_matches(nw, '[{_LOOK}]') then regexp_extract(nw, '^[^{_LOOK}]*') || translate(regexp_extract(nw, '[{_LOOK}]'), '{_LOOK}', '{_INTO}') || regexp_extract(nw, '^[^{_LOOK}]*[{_LOOK}](.*)$', 1) end from n2
  union all select seed_id, seed, w, 'cyr2lat_w2', ot, case when regexp_full_match(w[ot], '[а-яё]{{3,}}') and regexp_matches(w[ot], '[{_LOOK}]') then regexp_extract(w[ot], '^[^{_LOOK}]*') || translate(regexp_extract(w[ot], '[{_LOOK}]'), '{_LOOK}', '{_INTO}') || regexp_extract(w[ot], '^[^{_LOOK}]*[{_LOOK}](.*)$', 1) end from n2
  union all select seed_id, seed, w, 'brute_' || e, at_, nw[:-2] || e from n2, (select unnest([{", ".join(repr(e) for e in morph_probes.BRUTE_ENDINGS)}]) as e)
  union all select seed_id, seed, w, 'sep_' || e, at_, coalesce(nullif(regexp_replace(nw, '[{morph_probes.VOWELS}]+$', ''), ''), nw) || e from n2, (select unnest([{", ".join(repr(e) for e in morph_probes.SEP_ENDINGS)}]) as e)),
va as (select seed_id, label, array_to_string(list_transform(range(1, len(w) + 1), lambda i: case when i = k then x else w[i] end), ' ') as variant from fm where x is not null and x <> w[k]
  union all select seed_id, unnest({list(morph_probes.EXPERIMENTS)}), seed from n2)"""

_L = f"string_split('{morph_probes.LETTERS}', '')"
_hex = "case when regexp_matches(sy, '[0-9]') then sy else lower(to_hex(ascii(sy))) end"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TRIGGERS = _P + f""",
s0 as (select seed_id, seed as s, string_split(seed, ' ')[1] as a, array_to_string(string_split(seed, ' ')[2:], ' ') as r, string_split(seed, ' ') as w from cs),
le as (select unnest({_L}) as x), l10 as (select unnest({_L}[:10]) as x), sy as (select unnest({_list(morph_probes.SYMBOLS)}) as sy),
pa as (select unnest({_list(p[0] for p in morph_probes.PAIRS)}) as sy, unnest({_list(p[1] for p in morph_probes.PAIRS)}) as pp, unnest({_list(p[2] for p in morph_probes.PAIRS)}) as nm),
wi as (select unnest({_list(morph_probes.WIDE_SYMBOLS)}) as sy, unnest({_list(morph_probes.WIDE_PREPOSITIONS)}) as pp),
de as (select unnest({_list(morph_probes.DENSE_SYMBOLS)}) as sy), dp as (select unnest({_list(morph_probes.DENSE_PREPOSITIONS)}) as pp),
gp as (select *, unnest(range(1, len(w))) as i from s0),
t as (select seed_id, {_hex} || '_lo_' || x as label, 'cp_sym' as variant, sy as symbol, s || '  ' || sy || ' ' || x as query, length(s) + 2 as cp from s0, sy, le
  union all select seed_id, {_hex} || '_lo_' || x || '_dm1', 'cp_sym_m1', sy, s || '  ' || sy || ' ' || x, length(s) + 1 from s0, sy, le union all select seed_id, {_hex} || '_up_' || upper(x), 'cp_sym_upper', sy, s || '  ' || sy || ' ' || upper(x), length(s) + 2 from s0, sy, le
  union all select seed_id, 'dig_' || d || '_' || x, 'digit_trigger', d, s || '  ' || d || ' ' || x, length(s) + 2 from s0, (select unnest(range(10))::varchar as d), le union all select seed_id, 'dot_nospace_' || x, 'dot_prefix', '.', s || '.  ' || x, length(s) from s0, le
  union all select seed_id, 'alt_' || {_hex} || '_' || x, 'alt_space', sy, s || chr(160) || ' ' || sy || ' ' || x, length(s) + 2 from s0, (select unnest({_list(morph_probes.ALT_SYMBOLS)}) as sy), l10
  union all select seed_id, 'sp_' || nm || '_sym_only', 'sym_only', sy, s || '  ' || sy, length(s) + 2 from s0, pa union all select seed_id, 'sp_' || nm || '_prep_only', 'prep_only', sy, s || '  ' || sy || ' ' || pp, length(s) + 3 + length(pp) from s0, pa
  union all select seed_id, 'sp_' || nm || '_' || x, 'prep_letter', sy, s || '  ' || sy || ' ' || pp || ' ' || x, length(s) + 3 + length(pp) from s0, pa, le
  union all select seed_id, 'infix_p' || i || '_' || {_hex} || coalesce('_' || x, '_only'), case when x is null then 'infix_only' else 'infix_letter' end, sy, array_to_string(w[:i], ' ') || ' ' || sy || ' ' || array_to_string(w[i + 1:], ' ') || coalesce(' ' || x, ''), length(array_to_string(w[:i], ' ')) + 1
    from gp, (select unnest({_list(morph_probes.INFIX_SYMBOLS)}) as sy), (select x from le union all select null)
  union all select seed_id, 'iv2_t1_' || {_hex} || '_' || x, 'iv2_sym', sy, a || '  ' || sy || '  ' || r || ' ' || x, length(a) + 2 from s0, wi, le union all select seed_id, 'iv2_t2_' || {_hex} || '_' || pp || '_' || x, 'iv2_prep', sy, a || '  ' || sy || ' ' || pp || '  ' || r || ' ' || x, length(a) + 3 + length(pp) from s0, wi, le
  union all select seed_id, 'iv2_t3_' || {_hex} || '_' || upper(x), 'iv2_upper', sy, a || '  ' || sy || '  ' || r || ' ' || upper(x), length(a) + 2 from s0, wi, l10 where sy in ('(', ':', '№')
  union all select seed_id, 'dense_t1_' || {_hex} || '_' || x, 'dense_sym', sy, a || sy || '  ' || r || ' ' || x, length(a) from s0, de, le union all select seed_id, 'dense_t2_' || {_hex} || '_' || pp || '_' || x, 'dense_prep', sy, a || ' ' || sy || pp || '  ' || r || ' ' || x, length(a) + 1 + length(pp) from s0, de, dp, le)
select seed_id, 'trg_' || label as label, variant, symbol, query, cp::int as cp from t"""

_X = "(values " + ", ".join(f"('{k}', '{v}')" for k, vs in expand.SUFFIXES.items() if k != "num" for v in vs) + ") as x(grp, v)"
_MORPH = _VARIANTS + f""",
sx as (select left(grp, 1) as kind, v, cp from {_X}, (values (-1), (1), (0)) as y(cp) where grp[1] <> 'A' or cp <> 0),
ep as (select seed_id, label, variant, v, variant || ' ' || v as q, case when cp = -1 then length(variant || ' ' || v) else length(variant) + cp end as cp from va, sx where not starts_with(label, 'brute_') and not starts_with(label, 'sep_') and len(list_filter(string_split(replace(v, ' *', ''), ' '), lambda z: list_contains(string_split(variant, ' '), z))) = 0),
sp as (select unnest(['', {", ".join(f"'{v.removesuffix(' *')}'" for k in "BCD" for v in expand.SUFFIXES[k])}]) as v)
select seed_id, label, variant, case when label = 'double_space' then regexp_replace(q, '^([^*]*\\*) ', '\\1  ') else q end as query, (case label when 'double_space' then 3 when 'ds_it' then 2 when 'client_yt' then 2 when 'cp_one' then 1 else cp end)::int as cp from ep
union all select seed_id, label, variant, variant || '  ' || x || case when v = '' then '' else ' ' || v end, length(variant)::int from va, sp, (select unnest({_L}) as x) where starts_with(label, 'sep_')"""

_SERVICE = _P + """,
sv as (select distinct word from (select word, min(lemma) as lemma from lx where pos = 'NOUN' and score >= 0.3 and length(lemma) >= 4 group by 1) n where (length(lemma) >= 5 and not ends_with(lemma, 'ка') and exists (select 1 from lx v where v.word = n.lemma || 'ировать' and v.tran and v.score >= 0.9)))"""
_MARKED = _SERVICE + """,
mk as (select seed_id, seed || case when seed_id % 3 = 0 then ' купить' else '' end as seed, seed_id % 3 = 0 as t, list_has_any(string_split(seed, ' '), (select coalesce(list(word), []) from sv)) as sx from cs)"""

QUERIES = {
    "word_ratios": (ratios, _RATIOS),
    "align_to_seed": (aligned, _ALIGNED),
    "normalize_phrases": (normalized, _NORMALIZED),
    "seed_variants_exp": (variants, _VARIANTS + " select * from va"),
    "trigger_probes": (triggers, _TRIGGERS),
    "expand_morph": (morph, _MORPH),
    "service_seeds": (services, _MARKED + " select seed_id, seed, array_to_string(list_filter([case when t then 'T' end, case when sx then 'S' end], lambda x: x is not null), ',') as markers, 'L' || len(string_split(seed, ' ')) as level, false as has_digit from mk"),
    "service_priorities": (priorities, _SERVICE + f""", sx as (select grp, left(grp, 1) as kind, v || '_' || variant as struct from {_X}, (values ('v1'), ('v2'), ('v3')) as y(variant) where grp[1] <> 'A' or variant <> 'v3')
 select seed_id, grp, struct, 1 as priority from cs, sx"""),
    "word_forms": (forms, _P + f" select distinct n.word, l.word as form from (select word, min(lemma) as lemma from lx where word in (select {_cy('w')} from bw) group by 1) n join lx l on l.lemma = n.lemma"),
    "seed_variants_case": (cases, _P + """, nn as (select seed_id, string_split(seed, ' ') as w from cs), k as (select *, case when exists (select 1 from lx where lx.word = w[1] and pos = 'NOUN') then 1 when exists (select 1 from lx where lx.word = w[2] and pos = 'NOUN') then 2 end as i from nn),
 f as (select seed_id, cas, num, array_to_string(list_transform(range(1, len(w) + 1), lambda j: case when j = i then lx.word else w[j] end), ' ') as variant from k join lx on lx.lemma = w[i] and lx.pos = 'NOUN' and lx.cas is not null where lx.word <> w[i])
 select seed_id, arg_min(cas, (list_position(['nomn', 'gent', 'datv', 'accs', 'ablt', 'loct'], cas), cas, num)) as case, arg_min(num, (list_position(['nomn', 'gent', 'datv', 'accs', 'ablt', 'loct'], cas), cas, num)) as number, variant from f group by seed_id, variant"""),
    "question_anchors": (questions, f"with {S.PROJECTION} select seed_id, string_split(lower(keyword), ' ')[1] as word, count(*) as n from keywords where string_split(lower(keyword), ' ')[1] in ('brand#12', 'nation_3', 'brand#23', 'large') group by 1, 2 having count(*) >= 2"),
    "fold_order": (ordered, """with lg as (select user_id % 20 as seed_id, event_type as struct, json_extract(props, '$.k')::bigint as k from events), f as (select seed_id, 'word' || (k % 40) || case when k % 3 = 0 then ' Alpha' else ' beta' end as keyword, count(*) as weight from lg where k % 13 > 0 group by 1, 2)
 select *, row_number() over (partition by seed_id order by weight desc, keyword)::int as place from f"""),
    "cluster_inputs": (inputs, _P + " select nm as seed, ty as keyword, case when k % 2 = 0 then 'Asia' else 'Украина' end as region, case when k % 3 = 0 then 'en' else 'русский' end as language from (select distinct nm, ty from pt) join (select nm as n0, min(p_partkey) as k from pt group by 1) on n0 = nm"),
}
