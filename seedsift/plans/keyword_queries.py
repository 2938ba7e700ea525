"""Queries of the keyword operators over the star schema's projection, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import arbitration, clean, tails
from seedsift.plans import cascade
from seedsift.sources import tables as S
from seedsift.sources.tables import PROJECTION

TARGET = "ASIA"
_FIRST = "first as (select distinct on (seed_id, trim(lower(keyword))) * from keywords where trim(keyword) <> '' order by seed_id, trim(lower(keyword)), pos, keyword)"
_PRE = _FIRST + r""",
p1 as (select *, regexp_replace(trim(lower(keyword)), '\s+', ' ', 'g') as q, regexp_replace(trim(lower(seed)), '\s+', ' ', 'g') as s from first),
p2 as (select *, string_split(q, ' ') as qw, string_split(s, ' ') as sw, case when regexp_matches(q || ' ', regexp_escape(s) || '[^a-z0-9]')
  then trim(concat_ws(' ', trim(substr(q, 1, strpos(q, s) - 1)), trim(substr(q, strpos(q, s) + length(s))))) end as t from p1),
p3 as (select *, case when t <> '' then string_split(t, ' ') else [] end as tw from p2),
pre as (select *, case when (length(q) - length(replace(q, s, ''))) / length(s) >= 2 then 'dup_seed'
  when len(list_filter(range(1, len(qw) + 1), lambda i: qw[i] in ('a', 'b') and not coalesce(regexp_matches(qw[i - 1], '[0-9]'), false) and not coalesce(regexp_matches(qw[i + 1], '[0-9]'), false))) > 0
    and len(list_filter(sw, lambda x: not (list_contains(qw, x) or (length(x) >= 4 and len(list_filter(qw, lambda w: starts_with(w, x) and length(w) <= length(x) + 3)) > 0)))) = 0 then 'noise_letter'
  when len(tw) = 1 and list_contains(sw, tw[1]) then 'echo'
  when len(tw) > 0 and len(list_filter(tw, lambda w: not list_contains(sw, w))) = 0 then 'all_seed'
  when len(list_filter(range(2, len(tw) + 1), lambda i: tw[i] = tw[i - 1])) > 0 then 'repeat'
  when length(t) = 1 and not regexp_matches(t, '^[0-9]$') then 'single_char'
  when len(list_filter(tw, lambda w: not regexp_matches(w, '[a-z]') and regexp_matches(w, '[^a-z0-9]'))) > 0 then 'symbol' end as reason from p3)"""
def _l0(before: str, source: str) -> str:
    """The detectors' labels of the rows of source, a table of before."""
    return before + r""",
tails as (select * replace (case when reason is null then case when q = s then '' else t end end as t) from """ + source + r"""),
d1 as (select *, case when t <> '' then string_split(t, ' ') else [] end as w, (select list(name) from gazetteer where country = '""" + TARGET + r"""') as g_own,
  (select list(name) from gazetteer) as g_all, (select list(name) from brands) as b_all from tails),
d2 as (select *, list_has_any(w, g_own) as own, list_has_any(w, g_all) as place, len(list_intersect(list_distinct(w), b_all)) as nb from d1),
d3 as (select *, list_filter([case when own then 'geo' end, case when nb > 0 then 'brand' end,
    case when (len(w) = 1 and regexp_matches(w[1], '^[0-9]+[a-z]{1,3}$')) or (len(w) = 2 and regexp_matches(w[1], '^[0-9]+$') and regexp_matches(w[2], '^[a-z]{1,3}$')) then 'product_spec' end,
    case when regexp_matches(w[1], '^[a-z0-9]{2,5}$') and regexp_matches(w[1], '[a-z]') then 'model_variant' end], lambda x: x is not null) as positive,
  list_filter([case when len(w) > 1 and len(list_distinct(w)) < len(w) then 'duplicate' end, case when len(w) > 1 and nb >= 2 then 'brand_collision' end,
    case when len(w) = 1 and list_contains(sw, w[1]) then 'seed_echo' end, case when regexp_matches(t, '^[0-9]{5,}$') then 'tech_garbage' end,
    case when regexp_matches(t, '^[0-9]+$') and not (length(t) = 4 and t between '2000' and '2030') then 'standalone_num' end,
    case when place and not own then 'foreign_geo' end], lambda x: x is not null) as negative from d2),
d4 as (select *, list_sum(list_transform(positive, lambda x: map {'geo': 1.0, 'brand': 1.0, 'product_spec': 0.85, 'model_variant': 0.75}[x]))::double as p0,
  list_sum(list_transform(negative, lambda x: map {'duplicate': 0.9, 'brand_collision': 0.5, 'seed_echo': 0.9, 'tech_garbage': 0.95, 'standalone_num': 0.7, 'foreign_geo': 0.95}[x]))::double as n0 from d3),
d5 as (select *, coalesce(p0, 0) as p, coalesce(n0, 0) as n, len(positive) > 0 as hp, len(negative) > 0 as hn, list_has_any(negative, ['duplicate', 'tech_garbage', 'foreign_geo']) as hard from d4),
d6 as (select *, case when reason is not null then 'TRASH' when t = '' then 'VALID' when hp and not hn then 'VALID'
    when hn and not hp then case when len(list_filter(negative, lambda x: x not in ('brand_collision', 'standalone_num'))) = 0 or n < 0.6 then 'GREY' else 'TRASH' end
    when hp and hn then case when list_contains(negative, 'foreign_geo') then 'TRASH' when list_has_any(positive, ['geo', 'brand']) and not hard then 'VALID'
      when hard then case when p > n * 1.5 then 'GREY' else 'TRASH' end when p > n * 1.2 then 'VALID' when n > p * 1.2 then 'TRASH' else 'GREY' end
    else 'GREY' end as label from d5),
l0 as (select *, case when label = 'VALID' then coalesce(case when list_contains(positive, 'geo') then 'geo' when list_contains(positive, 'brand') then 'brand' end, case when q = s then 'exact_seed' else 'other' end) end as "group",
    case when reason is not null then 'pre' else 'l0' end as stage from d6)"""


_L0 = _l0(_PRE, "pre")


def _with(ctes: str, select: str) -> str:
    return f"with {PROJECTION}, {ctes} {select}" if ctes else f"with {PROJECTION} {select}"


def _cascade(spark, sf):
    return cascade.run_cascade(S.keywords(spark, sf), S.gazetteer(spark, sf), S.brands(spark, sf), TARGET)


def cascade_labels(spark, sf):
    out = _cascade(spark, sf)
    joined = lambda c: F.array_join(c, ",")
    return out.select("seed_id", "pos", "keyword", "stage", "reason", "tail", joined("positive").alias("positive"), joined("negative").alias("negative"), "label", F.col("group").alias("kw_group"))


def cascade_groups(spark, sf):
    valid = _cascade(spark, sf).where("label = 'VALID'")
    return arbitration.group_summary(valid).select("seed_id", F.col("group").alias("kw_group"), "n_keywords")


def _dedupe(fn):
    return lambda spark, sf: fn(S.keywords(spark, sf)).select("seed_id", "pos", "keyword")


def blocked(spark, sf):
    before = clean.dedupe_first(S.keywords(spark, sf))
    after = clean.pre_filter(before).where("reason is null")
    return clean.blocked(before, after).select("seed_id", "pos", "keyword")


def pre_filter(spark, sf):
    return clean.pre_filter(clean.dedupe_first(S.keywords(spark, sf))).select("seed_id", "pos", "keyword", "reason")


def relevant(spark, sf):
    return clean.relevant(S.keywords(spark, sf)).groupBy("seed_id").agg(F.count("*").alias("n"))


def infix_clean(spark, sf):
    return clean.infix_clean(S.keywords(spark, sf), "ru").groupBy("seed_id").agg(F.count("*").alias("n"))


def tail_extraction(spark, sf):
    return tails.extract_tail(clean.dedupe_first(S.keywords(spark, sf))).select("seed_id", "pos", "keyword", "tail")


def payloads(spark, sf):
    return tails.extract_payload(clean.dedupe_first(S.keywords(spark, sf))).select("seed_id", "pos", "keyword", "payload")


def payload_map(spark, sf):
    kw = tails.extract_payload(clean.dedupe_first(S.keywords(spark, sf)))
    return kw.groupBy("seed_id", "payload").agg(F.count("*").alias("n_keywords"), F.min("pos").alias("first_pos"))


def text_functions(spark, sf):
    part = S.table(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return part.select(
        "p_partkey", X.fingerprint(name).alias("fp"), X.stem_fingerprint(name).alias("stem_fp"), X.estimate_tokens(name).cast("int").alias("tokens"),
        X.detect_language(name).alias("language"), X.uule(name).alias("code"), X.squeeze(name).alias("squeezed"), X.latin_share(name).alias("latin"),
    )


QUERIES = {
    "cascade_labels": (cascade_labels, _with(_L0, "select seed_id, pos, keyword, stage, reason, t as tail, array_to_string(positive, ',') as positive, array_to_string(negative, ',') as negative, label, \"group\" as kw_group from l0")),
    "cascade_groups": (cascade_groups, _with(_L0, "select seed_id, \"group\" as kw_group, count(*) as n_keywords from l0 where label = 'VALID' group by all")),
    "dedupe_first": (_dedupe(clean.dedupe_first), _with(_FIRST, "select seed_id, pos, keyword from first")),
    "dedupe_ws": (_dedupe(clean.dedupe_ws), _with("", r"select distinct on (seed_id, regexp_replace(lower(trim(keyword)), '\s+', ' ', 'g')) seed_id, pos, keyword from keywords order by seed_id, regexp_replace(lower(trim(keyword)), '\s+', ' ', 'g'), pos, keyword")),
    "dedupe_exact": (_dedupe(clean.dedupe_exact), _with("", "select seed_id, min(pos) as pos, keyword from keywords group by seed_id, keyword")),
    "blocked": (blocked, _with(_PRE, "select seed_id, pos, keyword from pre where reason is not null")),
    "pre_filter": (pre_filter, _with(_PRE, "select seed_id, pos, keyword, reason from pre")),
    "relevant": (relevant, _with("", "select seed_id, count(*) as n from keywords where len(list_filter(list_filter(string_split(seed, ' '), lambda w: length(w) > 3), lambda w: contains(lower(keyword), substr(w, 1, least(4, length(w) - 1))))) > 0 group by seed_id")),
    "infix_clean": (infix_clean, _with("", r"select seed_id, count(*) as n from keywords where not regexp_matches(lower(keyword), '\s[^\s](\s|$)') group by seed_id")),
    "tail_extraction": (tail_extraction, _with(_PRE, """select seed_id, pos, keyword, case when q = s then '' else case when regexp_matches(q || ' ', regexp_escape(s) || '[^a-z0-9]') then t else null end end as tail from pre""")),
    "payloads": (payloads, _with(_FIRST, r"select seed_id, pos, keyword, array_to_string(list_filter(regexp_extract_all(lower(keyword), '\w+'), lambda w: not list_contains(string_split(seed, ' '), w)), ' ') as payload from first")),
    "payload_map": (payload_map, _with(_FIRST, r"select seed_id, array_to_string(list_filter(regexp_extract_all(lower(keyword), '\w+'), lambda w: not list_contains(string_split(seed, ' '), w)), ' ') as payload, count(*) as n_keywords, min(pos) as first_pos from first group by all")),
    "text_functions": (text_functions, r"""with x as (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand as t from part),
y as (select *, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9\s]', '', 'g'), ' '), lambda w: w <> '') as w from x)
select p_partkey, array_to_string(list_sort(list_distinct(w)), '|') as fp,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda z: length(z) > 2), lambda z: case when length(z) > 6 then left(z, -3) when length(z) > 4 then left(z, -2) else z end))), '|') as stem_fp,
 floor(0.27 * length(t) + 0.55 * 0)::int + 1 as tokens, 'en' as language,
 'w+' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', least(length(t), 63) + 1, 1) || base64(encode(t)) as code, lower(t) as squeezed, 1.0::double as latin from y"""),
}
