"""Queries of the expansion operators over distinct part names, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.operators import expand as E
from seedsift.sources import tables as S
from seedsift.sources.tables import PROJECTION


def _seeds(spark, sf):
    """Part names with a word of trade behind some, so that markers and self-matches occur."""
    raw = S.seeds(spark, sf)
    extra = F.when(F.col("seed_id") % 3 == 0, " купить").when(F.col("seed_id") % 3 == 1, " для дома").otherwise("")
    return E.analyze_seeds(raw.withColumn("seed", F.concat("seed", extra)))


_SEEDS = f"""with {PROJECTION}, sd as (select seed_id, seed || case seed_id % 3 when 0 then ' купить' when 1 then ' для дома' else '' end as seed from seeds),
an as (select *, string_split(seed, ' ') as words, 'L' || len(string_split(seed, ' ')) as level, seed_id % 3 = 0 as t from sd)"""
_VALUES = "(values " + ", ".join(f"('{k}', '{v}')" for k, vs in E.SUFFIXES.items() if k != "num" for v in vs) + ") as x(grp, v)"
_PROBES = f""", sx as (select grp, left(grp, 1) as kind, v, variant, cp from {_VALUES}, (values ('v1', -1), ('v2', 1), ('v3', 0)) as y(variant, cp) where grp[1] <> 'A' or variant <> 'v3'),
pr as (select seed_id, seed, words, level, t, grp, kind, v || '_' || variant as struct, seed || ' ' || v as query, case when cp = -1 then length(seed || ' ' || v) else length(seed) + cp end as cp,
  string_split(regexp_replace(v, ' ?\\*', '', 'g'), ' ') as added,
  least(case when t then case kind when 'C' then 2 else 1 end else 9 end, case level when 'L3' then case kind when 'C' then 2 else 1 end when 'L4' then case when kind in ('B', 'C', 'D') then 2 else 1 end else 1 end) as base from an, sx),
bl as (select *, list_filter(added, lambda w: list_contains(words, w))[1] as hit from pr),
done as (select *, case when hit is not null then case when hit in ('для') then 'prep_self_match:' else 'word_self_match:' end || hit end as blocked_by, case when hit is not null then 0 else base end as priority from bl)"""


def _suffix(spark, sf):
    return E.block_self_match(E.probe_priority(E.expand_suffix(_seeds(spark, sf), spark)))


def seed_analysis(spark, sf):
    return _seeds(spark, sf).select("seed_id", "seed", F.array_join("markers", ",").alias("markers"), "level", "has_digit", F.size("words").alias("n_words"))


def expand_suffix(spark, sf):
    return _suffix(spark, sf).select("seed_id", "grp", "struct", "query", "cp", "priority", "blocked_by")


def expand_letters(spark, sf):
    return E.expand_letters(_seeds(spark, sf), spark).select("seed_id", "struct", "query", "cp")


def expand_addon(spark, sf):
    return E.expand_addon(_seeds(spark, sf), spark).select("seed_id", "query", "cp")


def expand_prefix(spark, sf):
    seeds = _seeds(spark, sf)
    return E.expand_prefix(seeds, spark).unionByName(E.expand_prefix_addon(seeds, spark)).select("seed_id", "grp", "query", "cp")


def echelon(spark, sf):
    return E.select_probes(_suffix(spark, sf), 1).groupBy("seed_id").agg(F.count("*").alias("n"))


def probe_summary(spark, sf):
    return E.probe_summary(_suffix(spark, sf))


def modifiers(spark, sf):
    return E.modifiers(_seeds(spark, sf), spark, True).groupBy("seed_id").agg(F.count("*").alias("n"), F.count_distinct("modifier").alias("n_distinct"))


def brute(spark, sf):
    return E.seed_variants_brute(_seeds(spark, sf))


def infix(spark, sf):
    core = E.infix_core(_seeds(spark, sf), S.gazetteer(spark, sf))
    return E.expand_infix(E.infix_gaps(core), spark)


_LETTERS = "(values " + ", ".join(f"('{n}', '{p}', '{c}')" for n, p, c in E.LETTER_STRUCTS) + ") as st(name, pattern, rule)"
_PREFIX = "(values " + ", ".join(f"('{n}', '{p}')" for n, p, _ in E.PREFIX_STRUCTS) + ") as st(name, pattern)"
_QUEST = "(values " + ", ".join(f"('{q}')" for q in E.QUESTIONS) + ") as qu(x)"
_INFIX = "(values " + ", ".join(f"('{g}', '{i}')" for g, i in E.INFIX) + ") as ix(grp, ins)"

QUERIES = {
    "seed_analysis": (seed_analysis, _SEEDS + " select seed_id, seed, case seed_id % 3 when 0 then 'T' when 1 then 'P' else '' end as markers, level, false as has_digit, len(words)::int as n_words from an"),
    "expand_suffix": (expand_suffix, _SEEDS + _PROBES + " select seed_id, grp, struct, query, cp::int as cp, priority, blocked_by from done"),
    "expand_letters": (expand_letters, _SEEDS + f""" select seed_id, x || '_' || name as struct, replace(replace(pattern, '{{s}}', seed), '{{x}}', x) as query,
 (case when rule = 'end' then length(replace(replace(pattern, '{{s}}', seed), '{{x}}', x)) when rule = 'none' then -1 else length(seed) + substr(rule, 6)::int end)::int as cp from an, {_LETTERS}, (select unnest(string_split('{E.SWEPT_LETTERS}', '')) as x)"""),
    "expand_addon": (expand_addon, _SEEDS + f""" select seed_id, seed || ' ' || x as query, length(seed || ' ' || x)::int as cp from an,
 (select i::varchar as x from range(7) r(i) union all select i || ' ' || l from range(5) r(i), (select unnest(string_split('{E.CYRILLIC_LETTERS}', '')) as l))"""),
    "expand_prefix": (expand_prefix, _SEEDS + f""", ps as (select 'PA' as grp, l as x, pattern from {_PREFIX}, (select unnest(string_split('{E.CYRILLIC_LETTERS}', '')) as l)
 union all select 'PC', x, '{{x}} {{s}}' from {_QUEST} union all select 'digits', i::varchar, pattern from {_PREFIX}, range(10) r(i))
 select seed_id, grp, replace(replace(pattern, '{{x}}', x), '{{s}}', seed) as query, 0::int as cp from an, ps"""),
    "echelon": (echelon, _SEEDS + _PROBES + " select seed_id, count(*) as n from done where priority = 1 group by 1"),
    "probe_summary": (probe_summary, _SEEDS + _PROBES + " select 'suffix' as family, kind, priority, count(*) as n, count(blocked_by) as n_blocked from done group by rollup(kind, priority) union all select null, null, null, count(*), count(blocked_by) from done"),
    "modifiers": (modifiers, _SEEDS + f" select seed_id, (case when seed_id % 3 < 2 then {len(E.CYRILLIC_LETTERS)} else 0 end + 36)::bigint as n, (case when seed_id % 3 < 2 then {len(E.CYRILLIC_LETTERS)} else 0 end + 36)::bigint as n_distinct from an"),
    "seed_variants_brute": (brute, _SEEDS + f""", v as (select *, list_filter(words, lambda w: regexp_matches(w, '^[а-яё]{{4,}}$'))[1] as w from an), e as (select unnest([{", ".join(f"'{e}'" for e in E.ENDINGS)}]) as ending)
 select seed_id, replace(seed, w, left(w, -1) || ending) as variant, ending from v, e where w is not null and replace(seed, w, left(w, -1) || ending) <> seed"""),
    "expand_infix": (infix, _SEEDS + f""", t as (select *, case when seed_id % 3 = 1 then list_concat(words[1:len(words) - 2], [words[len(words) - 1] || ' ' || words[len(words)]]) else words end as tk from an),
 g as (select seed_id, tk, unnest(range(1, len(tk)))::int as gap from t),
 h as (select *, array_to_string(tk[1:gap], ' ') as l, array_to_string(tk[gap + 1:len(tk)], ' ') as r, (len(tk) = 4 and gap = 2) or tk[gap + 1] = 'купить' as wc from g)
 select seed_id, gap, grp, l || ' ' || ins || ' ' || r as query, (length(l) + length(ins) + 1)::int as cp from h, {_INFIX} where not wc or grp = 'WC'"""),
}
