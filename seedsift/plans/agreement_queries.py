"""Queries of agreement, shared words and stripped anchors, with SQL that gives the same rows.

The lexicon is derived from the parts: odd lengths are adjectives, even ones nouns; first letters give gender and number.
Every third keyword counts as valid. Places are nations, with a dash for the underscore.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import agreement
from seedsift.plans.decision_queries import _TAILS, _tails
from seedsift.plans.keyword_queries import TARGET, _with
from seedsift.sources import tables as S


def _lexicon(spark, sf):
    words = S.table(spark, sf, "part").select(F.explode(X.words(F.concat_ws(" ", "p_name", "p_type"))).alias("word")).distinct()
    odd, code = F.length("word") % 2 == 1, F.ascii("word")
    number = F.when(code % 2 == 0, "plur").otherwise("sing")
    gender = F.when(~odd | (code % 2 == 1), F.element_at(F.array(*map(F.lit, ("masc", "femn", "neut"))), (code % 3 + 1).cast("int")))
    return words.select("word", F.lit(0).alias("rank"), F.col("word").alias("lemma"), F.when(odd, "ADJF").otherwise("NOUN").alias("pos"), gender.alias("gender"), number.alias("number"))


def _heads(spark, sf):
    return agreement.seed_heads(S.seeds(spark, sf), _lexicon(spark, sf))


def scores(spark, sf):
    return agreement.morph_scores(_tails(spark, sf), _heads(spark, sf), _lexicon(spark, sf))


def _sides(spark, sf):
    tails = _tails(spark, sf)
    return tails.where("pos % 3 = 0"), tails.where("pos % 3 <> 0")


def reference(spark, sf):
    return agreement.reference_words(_sides(spark, sf)[0], _heads(spark, sf))


def overlap(spark, sf):
    out = agreement.reference_overlap(_sides(spark, sf)[1], reference(spark, sf))
    return out.select("seed_id", "tail", F.array_join("shared", ",").alias("shared"))


def _dashed(spark, sf):
    dash = [F.regexp_replace(c, "_", "-").alias(c) for c in ("seed", "keyword")]
    places = S.gazetteer(spark, sf).select(F.regexp_replace("name", "_", "-").alias("name"), "country")
    return S.keywords(spark, sf).select("seed_id", *dash), places


def anchor(spark, sf):
    kw, places = _dashed(spark, sf)
    return agreement.strip_to_anchor(kw, places, TARGET, _lexicon(spark, sf))


def allowed(spark, sf):
    kw, places = _dashed(spark, sf)
    words = kw.select(F.explode(X.words("keyword")).alias("word")).distinct()
    return agreement.city_allowed(words, places, TARGET, _lexicon(spark, sf))


def mismatch(spark, sf):
    """Seeds and tails have the vectors whose ids are seven times a seed's length and a tail's length."""
    pairs = _tails(spark, sf).join(S.seeds(spark, sf), "seed_id")
    vectors = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    seeds = S.seeds(spark, sf).select(F.col("seed").alias("text"), (F.length("seed") * 7).cast("long").alias("vec_id"))
    tails = _tails(spark, sf).select(F.col("tail").alias("text"), F.length("tail").cast("long").alias("vec_id"))
    texts = seeds.join(tails, "text", "left_anti").union(tails.distinct())
    return agreement.category_mismatch(pairs, texts.join(vectors, "vec_id").select("text", "embedding"))


_HEADS = _TAILS + r""",
lx as (select word, length(word) % 2 = 1 as adj, case when ascii(word) % 2 = 0 then 'plur' else 'sing' end as number, case when length(word) % 2 = 0 or ascii(word) % 2 = 1 then ['masc', 'femn', 'neut'][ascii(word) % 3 + 1] end as gender
  from (select distinct unnest(string_split(lower(p_name || ' ' || p_type), ' ')) as word from part)),
hw as (select seed_id, i, w[i] as word from (select *, unnest(range(1, len(w) + 1)) as i from (select seed_id, string_split(lower(seed), ' ') as w from seeds))),
hd as (select seeds.seed_id, h.head, lx.gender, lx.number from seeds left join (select seed_id, arg_min(hw.word, i) as head from hw join lx on lx.word = hw.word where not adj group by 1) h on h.seed_id = seeds.seed_id left join lx on lx.word = h.head)"""

_SCORES = _HEADS + r""",
mw as (select seed_id, tail, unnest(string_split(tail, ' ')[:2]) as word from (select distinct seed_id, tail from tl)),
mg as (select mw.seed_id, tail, mw.word, adj, hd.gender as hg, coalesce(lx.number = hd.number, false) as n, coalesce(lx.gender = hd.gender, false) or coalesce(lx.number = hd.number and lx.number = 'plur', false) as g
  from mw left join lx on lx.word = mw.word left join hd on hd.seed_id = mw.seed_id)
select seed_id, tail, max(case when hg is null or length(word) < 2 then 0 when regexp_matches(word, '^[0-9]') then 0.8 when adj then case when g and n then 1 when g or n then 0.5 else 0.3 end else 0 end)::double as morph from mg group by 1, 2"""

_REFERENCE = _HEADS + r""",
bw as (select distinct seed_id, tail, pos % 3 = 0 as ok, unnest(list_transform(string_split(tail, ' '), lambda x: regexp_replace(x, '^[^a-z0-9#*_]+|[^a-z0-9#*_]+$', '', 'g'))) as word from tl),
rf as (select distinct bw.seed_id, word from bw join hd on hd.seed_id = bw.seed_id where ok and length(word) >= 2 and not regexp_matches(word, '^[0-9]+$') and word is distinct from head
  and word not in (""" + ", ".join(f"'{w}'" for w in agreement.STOP_WORDS) + "))"  # fmt: skip

_MISMATCH = _TAILS + r""",
mp as (select distinct seed_id, seed, tail from tl join seeds using (seed_id)),
mt as (select *, list_distinct(list_transform(range(1, greatest(length(seed) - 2, 1) + 1), lambda i: substr(replace(seed, ' ', '_'), i, 3))) as a, list_distinct(list_transform(range(1, greatest(length(tail) - 2, 1) + 1), lambda i: substr(replace(tail, ' ', '_'), i, 3))) as b from mp),
mo as (select *, len(list_intersect(a, b)) / least(len(a), len(b)) as overlap from mt)
select seed_id, tail, overlap, overlap <= 0.05 or (overlap < 0.2 and coalesce(list_cosine_similarity(s.embedding::double[], t.embedding::double[]) < 0.35, false)) as mismatch
  from mo left join embeddings s on s.vec_id = case when seed in (select tail from tl) then length(seed) else length(seed) * 7 end left join embeddings t on t.vec_id = length(tail)"""

_ANCHOR = r""",
dk as (select distinct seed_id, replace(seed, '_', '-') as seed, replace(keyword, '_', '-') as keyword from keywords), pl as (select replace(name, '_', '-') as name, country from gazetteer),
aw as (select seed_id, keyword, i, w[i] as word, list_contains(sw, w[i]) as own from (select *, unnest(range(1, len(w) + 1)) as i from (select *, regexp_extract_all(lower(keyword), '[a-z0-9-]+') as w, list_filter(regexp_extract_all(lower(seed), '[a-z0-9-]+'), lambda x: length(x) >= 2) as sw from dk))),
ag as (select seed_id, keyword, bool_or(length(word) >= 3 and coalesce(country = 'ASIA', false)) as here, string_agg(word, ' ' order by i) filter (length(word) < 2 or (not own and coalesce(country = 'ASIA', true))) as anchor from aw left join pl on pl.name = word group by 1, 2)"""

QUERIES = {
    "seed_heads": (_heads, _with(_HEADS, "select seed_id, head, gender as head_gender, number as head_number from hd")),
    "morph_scores": (scores, _with(_SCORES, "")),
    "reference_words": (reference, _with(_REFERENCE, "select seed_id, word from rf")),
    "reference_overlap": (overlap, _with(_REFERENCE, "select bw.seed_id, tail, coalesce(string_agg(distinct rf.word, ',' order by rf.word), '') as shared from bw left join rf on rf.seed_id = bw.seed_id and rf.word = bw.word where not ok group by 1, 2")),
    "category_mismatch": (mismatch, _with(_MISMATCH, "")),
    "city_allowed": (allowed, _with(_ANCHOR.lstrip(",\n"), "select word, coalesce(country = 'ASIA', true) as allowed from (select distinct unnest(string_split_regex(trim(lower(keyword)), '\\s+')) as word from dk) x left join pl on pl.name = word")),
    "strip_to_anchor": (anchor, _with(_ANCHOR.lstrip(",\n"), "select seed_id, keyword, case when here then '' else coalesce(anchor, '') end as anchor from ag")),
}
