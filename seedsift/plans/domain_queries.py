"""Queries of the domain anchors, with SQL that gives the same rows.

Seeds and keywords are those of the anchors' queries, with labels of three kinds. Parts of speech and cases follow from a
word's letters, words also stand with an s at their end, and the vectors are no word vectors, so the thresholds of their
cosines are lower here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.operators import domain_anchors as D
from seedsift.operators.statistics import cosine
from seedsift.plans import anchor_queries as A
from seedsift.sources import tables as S
from seedsift.sources.shared import written

PROFILE = {"floor": 0.05, "few_threshold": 0.15, "top": 3, "too_close": 0.1}
LEAST_SCORE, LEAST_COSINE, MOST_VERBS = 0.3, 0.1, 1


def _keywords(spark, sf):
    """(seed_id, keyword, label, positive), one row for each line item."""
    part, item = A._parts(spark, sf), S.table(spark, sf, "lineitem")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("n1").alias("o1"), F.col("n2").alias("o2"), F.col("ty").alias("ot"))
    wide = item.join(part, item["l_partkey"] == part["p_partkey"]).join(other, "l_suppkey").join(A._seeds(spark, sf), "seed")
    n1, n2, ty, o1, o2, ot, size = *(F.col(c) for c in ("n1", "n2", "ty", "o1", "o2", "ot")), F.col("p_size").cast("string")
    shapes = [(n1, n2, ty, size), (o1, n2, ty, size), (n1, o2, ot), (n2, ot, size), (o1, o2, n1), (F.concat(n1, F.lit("s")), o2, F.concat(size, F.lit("mm"))), (F.lit("***"),), (o2, F.lit("ab"), n2, size), (F.lit("rod"), ot, n2)]
    pick = (F.col("l_orderkey") + F.col("l_linenumber")) % len(shapes)
    text = F.coalesce(*(F.when(pick == i, F.concat_ws(" ", *s)) for i, s in enumerate(shapes)))
    label = F.when(F.col("l_suppkey") % 3 == 0, "VALID").when((F.col("l_suppkey") % 3 == 1) & (F.col("l_orderkey") % 2 == 0), "TRASH").otherwise("GREY")
    return wide.select("seed_id", text.alias("keyword"), label.alias("label"), (F.col("l_orderkey") % 5 == 0).alias("positive"))


def _lexicon(spark, sf):
    known, w, size = A._dictionary(spark, sf), F.col("word"), F.length("word")
    pos = F.when(F.col("second"), "NOUN").when((size == 3) & (F.ascii(w) % 2 == 0), "PREP").when(size == 4, "INFN").when(size == 8, "ADJF").otherwise("NOUN")
    sort = (F.ascii(w) + size) % 4
    rows = known.select("word", F.lit(0).alias("rank"), w.alias("lemma"), pos.alias("pos"), F.when(sort == 0, "gent").when(sort == 1, "accs").alias("case"))
    return rows.unionByName(rows.withColumn("word", F.concat("word", F.lit("s"))))


def _tables(spark, sf):
    kw, lexicon = written(_keywords(spark, sf)), written(_lexicon(spark, sf))
    axes = written(D.object_axes(A._seeds(spark, sf), lexicon))
    valid, grey, trash = (kw.where(f"label = '{x}'") for x in ("VALID", "GREY", "TRASH"))
    return valid, grey, trash, axes, lexicon, written(A._vectors(spark, sf))


def axes(spark, sf):
    out = D.object_axes(A._seeds(spark, sf), _lexicon(spark, sf))
    return out.select("seed_id", "object", "qualifier", "action", "root", F.array_join("content", ",").alias("content"))


def profiles(spark, sf):
    valid, _, trash, ax, lexicon, vectors = _tables(spark, sf)
    profile = D.domain_profile(valid, trash, ax, lexicon, vectors, **PROFILE)
    wide = profile.join(ax.select("seed_id", "object"), "seed_id").join(vectors.withColumnsRenamed({"lemma": "object", "embedding": "_object"}), "object")
    rounded = [F.round(c, 6).alias(n) for n, c in (("threshold", F.col("threshold")), ("centroid_cos", cosine("centroid", "_object")), ("trash_cos", F.col("trash_cos")))]
    return wide.select("seed_id", "object", "n_lemmas", *rounded, F.col("trash_centroid").isNotNull().alias("contrasted"))


def actions(spark, sf):
    valid, grey, _, ax, lexicon, vectors = _tables(spark, sf)
    return D.action_set(valid, grey, ax, lexicon, vectors, LEAST_COSINE, MOST_VERBS)


def decisions(spark, sf):
    valid, grey, _, ax, lexicon, vectors = _tables(spark, sf)
    out = D.judge_domain(grey, valid, ax, lexicon, A._relations(spark, sf), vectors, least_score=LEAST_SCORE, least_cosine=LEAST_COSINE, most_verbs=MOST_VERBS)
    return out.withColumn("near_score", F.round("near_score", 6))


_BASE = r"""with pt as (select *, string_split(nm, ' ')[1] as n1, string_split(nm, ' ')[2] as n2, nm || ' ' || ty || case when p_size % 4 = 0 then ' ' || p_size::varchar else '' end as seed
  from (select p_partkey, p_size, lower(p_name) as nm, lower(p_type) as ty from part)),
sd as (select min(p_partkey)::bigint as seed_id, seed from pt group by seed),
dw as (select distinct word as w, word in (select n2 from pt) as second from (select unnest([n1, n2, ty]) as word from pt)),
ps as (select w, case when second then 'NOUN' when length(w) = 3 and ascii(w) % 2 = 0 then 'PREP' when length(w) = 4 then 'INFN' when length(w) = 8 then 'ADJF' else 'NOUN' end as pos,
  case (ascii(w) + length(w)) % 4 when 0 then 'gent' when 1 then 'accs' end as cas from dw),
lx as (select w as word, w as lemma, pos, cas from ps union all select w || 's', w, pos, cas from ps),
st as (select seed_id, i, s.word, lemma, pos, cas, lag(pos) over (partition by seed_id order by i) as before from (select seed_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select seed_id, string_split(seed, ' ') as w from sd)) s left join lx on lx.word = s.word),
ob as (select seed_id, arg_min(lemma, case when way < 3 then way * 100 + i else 400 - i end) as obj from (select *, case when cas = 'gent' then 0 when before = 'PREP' then 1 when cas = 'accs' then 2 else 3 end as way from st where pos = 'NOUN') group by 1),
ac as (select seed_id, arg_min(lemma, i) as act from st where pos in ('NOUN', 'INFN', 'VERB') group by 1),
nu as (select seed_id, arg_max(word, i) as num from st where regexp_full_match(word, '[0-9]+') group by 1),
co as (select seed_id, list(lemma order by i) as content from (select seed_id, lemma, min(i) as i from st where pos in ('NOUN', 'INFN', 'VERB', 'ADJF') and length(word) > 2 group by 1, 2) group by 1),
ax as (select sd.seed_id, obj, num, act, act[:least(5, greatest(4, length(act) - 2))] as root, coalesce(content, []) as content, string_split(seed, ' ') as sw from sd left join ob on ob.seed_id = sd.seed_id left join ac on ac.seed_id = sd.seed_id left join nu on nu.seed_id = sd.seed_id left join co on co.seed_id = sd.seed_id)"""

_SAID = _BASE + r""",
kr as (select sd.seed_id, case when l_suppkey % 3 = 0 then 'VALID' when l_suppkey % 3 = 1 and l_orderkey % 2 = 0 then 'TRASH' else 'GREY' end as label, l_orderkey % 5 = 0 as positive,
    case (l_orderkey + l_linenumber) % 9 when 0 then concat_ws(' ', p.n1, p.n2, p.ty, p.p_size) when 1 then concat_ws(' ', o.n1, p.n2, p.ty, p.p_size) when 2 then concat_ws(' ', p.n1, o.n2, o.ty) when 3 then concat_ws(' ', p.n2, o.ty, p.p_size)
    when 4 then concat_ws(' ', o.n1, o.n2, p.n1) when 5 then concat_ws(' ', p.n1 || 's', o.n2, p.p_size || 'mm') when 6 then '***' when 7 then concat_ws(' ', o.n2, 'ab', p.n2, p.p_size) else concat_ws(' ', 'rod', o.ty, p.n2) end as keyword
  from lineitem join pt p on l_partkey = p.p_partkey join pt o on l_suppkey = o.p_partkey join sd on sd.seed = p.seed),
kw as (select seed_id, label, keyword, bool_or(positive) as positive from kr group by 1, 2, 3),
kt as (select k.*, coalesce(lx.lemma, k.word) as lemma, pos, obj, act, root, sw, coalesce(pos = 'NOUN', false) and length(k.word) > 2 and not list_contains(sw, k.word) as own
  from (select seed_id, label, keyword, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from (select *, regexp_extract_all(lower(keyword), '[а-яёa-z]+') as w from kw)) k left join lx on lx.word = k.word join ax on ax.seed_id = k.seed_id),
vc as (select w as lemma, embedding::double[] as e from dw join embeddings on vec_id = ascii(w) + length(w))"""

_PROFILES = _SAID + r""",
un as (select lemma, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from vc),
ow as (select distinct seed_id, lemma from kt where own and label = 'VALID'),
si as (select ow.seed_id, ow.lemma, list_cosine_similarity(v.e, o.e) as c from ow join ax on ax.seed_id = ow.seed_id join un v on v.lemma = ow.lemma join un o on o.lemma = obj),
rk as (select *, row_number() over (partition by seed_id order by c, lemma) as up, row_number() over (partition by seed_id order by c desc, lemma) as down, count(*) over (partition by seed_id) as n from si),
lo as (select seed_id, any_value(n) as n, max(case when up = floor(n * 0.1) + 1 and n >= 5 then greatest(0.05, c) end) as low from rk group by 1),
ce as (select seed_id, list(m order by i) as cen from (select seed_id, i, avg(u[i]) as m from rk join un on un.lemma = rk.lemma, range(1, 65) t(i) where down <= 3 group by 1, 2) group by 1),
re as (select distinct kt.seed_id, u, un.lemma from kt join un on un.lemma = kt.lemma where own and label = 'TRASH' and not exists (select 1 from ow where ow.seed_id = kt.seed_id and ow.lemma = kt.lemma)),
aw as (select seed_id, list(m order by i) as away from (select seed_id, i, avg(u[i]) as m from re, range(1, 65) t(i) where seed_id in (select seed_id from re group by 1 having count(*) >= 3) group by 1, 2) group by 1)
select ax.seed_id, obj as object, coalesce(lo.n, 0) as n_lemmas, round(coalesce(low, 0.15), 6) as threshold, round(list_cosine_similarity(cen, o.e), 6) as centroid_cos, round(list_cosine_similarity(away, o.e), 6) as trash_cos,
  coalesce(list_cosine_similarity(away, o.e) <= 0.1, false) as contrasted
from ax join un o on o.lemma = obj left join lo on lo.seed_id = ax.seed_id left join ce on ce.seed_id = ax.seed_id left join aw on aw.seed_id = ax.seed_id"""

_ACTS = _SAID + r""",
oth as (select * from kt where act is not null and not coalesce(contains(lemma, obj), false) and not starts_with(lemma, root)),
vb as (select seed_id, lemma from (select seed_id, lemma, row_number() over (partition by seed_id order by count(*) desc, lemma) as r from oth where label = 'VALID' and pos in ('INFN', 'VERB') and length(word) > 3 group by 1, 2 having count(*) >= 3) where r <= 1),
a0 as (select seed_id, act as lemma, 'action' as source from ax where act is not null union all select seed_id, lemma, 'verb' from vb),
an as (select distinct oth.seed_id, oth.lemma from oth join vc v on v.lemma = oth.lemma join vc a on a.lemma = act left join vc o on o.lemma = obj where label in ('VALID', 'GREY') and pos = 'NOUN' and length(word) > 2
  and not exists (select 1 from a0 where a0.seed_id = oth.seed_id and a0.lemma = oth.lemma) and list_cosine_similarity(v.e, a.e) >= 0.1 and (o.e is null or list_cosine_similarity(v.e, o.e) <= list_cosine_similarity(v.e, a.e))),
acs as (select * from a0 union all select seed_id, lemma, 'noun' from an)"""

_DECISIONS = _ACTS + r""",
nb as (select b.seed_id, b.lemma from kt a join kt b on a.seed_id = b.seed_id and a.keyword = b.keyword and a.label = 'VALID' and b.label = 'VALID' where length(a.word) > 2 and starts_with(a.lemma, a.obj) and a.i <> b.i and abs(a.i - b.i) <= 2 and b.own group by 1, 2 having count(distinct b.keyword) >= 2),
kn as (select ax.seed_id, list(distinct related) as kin from ax join (select lemma, related, abs(length(lemma) - length(related)) as apart from (select distinct n2 as lemma, ty as related from pt union select n1, n2 from pt)) r on r.lemma = obj and apart <= 1 and related <> obj group by 1),
gk as (select kw.*, count(*) over (partition by seed_id) >= 10 as many from kw where label = 'GREY'),
gt as (select kt.*, nb.lemma is not null as near, list_cosine_similarity(v.e, o.e) as c, exists (select 1 from acs where acs.seed_id = kt.seed_id and acs.lemma = kt.lemma) as acts, sum(own::int) over (partition by kt.seed_id, kt.keyword order by i) as nth
  from kt left join nb on nb.seed_id = kt.seed_id and nb.lemma = kt.lemma left join vc v on v.lemma = kt.lemma left join vc o on o.lemma = kt.obj where label = 'GREY'),
be as (select seed_id, keyword, arg_max(lemma, (sc, -i)) as near_lemma, max(sc) as near_score from (select gt.*, c + case when positive then 0.1 else 0 end + case when near then 0.05 else 0 end as sc from gt join gk using (seed_id, keyword) where own and nth <= 5) where sc > 0 group by 1, 2),
le as (select seed_id, keyword, list(distinct lemma) as lemmas, min(lemma) filter (i = 1 and length(word) between 2 and 4 and pos = 'NOUN' and not contains(lemma, obj)) as opens, arg_min(lemma, i) filter (starts_with(lemma, root) or acts) as first from gt group by 1, 2),
fx as (select gk.seed_id, gk.keyword, many, obj, num, act, root, content, coalesce(lemmas, []) as lemmas, opens, first, near_lemma, near_score, contains(lower(gk.keyword), obj) as inside,
    coalesce(regexp_matches(' ' || lower(gk.keyword) || ' ', '[^0-9]' || num || '[^0-9]'), false) as alone, list_min(list_filter(kin, lambda x: contains(lower(gk.keyword), x))) as kin_in, list_min(list_intersect(coalesce(lemmas, []), kin)) as kin_lemma
  from gk join ax on ax.seed_id = gk.seed_id left join le on le.seed_id = gk.seed_id and le.keyword = gk.keyword left join be on be.seed_id = gk.seed_id and be.keyword = gk.keyword left join kn on kn.seed_id = gk.seed_id),
an1 as (select *, case when not many or obj is null then null when num is not null and not alone then '-no_qualifier:' || num when len(content) > 0 and not list_has_any(lemmas, content) and not inside then '-no_seed_lemma' when inside then 'substring'
    when alone then 'qualifier_digit' when list_contains(lemmas, obj) then 'lemma' when kin_in is not null then 'synonym_substring:' || kin_in when kin_lemma is not null then 'synonym_lemma:' || kin_lemma
    when near_score is null then '-no_anchor' when near_score >= 0.3 then 'score' else '-score_low' end as anchor_signal from fx),
an2 as (select *, case when anchor_signal is null or starts_with(anchor_signal, '-') then null when act is null then 'no_action_extracted' when starts_with(first, root) then 'action_root:' || first when first is not null then 'action_lemma:' || first
    when inside and opens is not null then 'action_abbrev:' || opens else '-no_action' end as action_signal from an1)
select seed_id, keyword, case when anchor_signal is not null and (starts_with(anchor_signal, '-') or coalesce(action_signal = '-no_action', false)) then 'TRASH' else 'GREY' end as domain_label,
  case when not many then 'too_few' when obj is null then 'no_object' when starts_with(anchor_signal, '-') then 'no_domain_anchor' when action_signal = '-no_action' then 'no_action' else 'shown' end as domain_reason, anchor_signal, action_signal,
  case when anchor_signal in ('score', '-score_low') then near_lemma end as near_lemma, case when anchor_signal in ('score', '-score_low') then round(near_score, 6) end as near_score from an2"""

QUERIES = {
    "domain_axes": (axes, _BASE + " select seed_id, obj as object, num as qualifier, act as action, root, array_to_string(content, ',') as content from ax"),
    "domain_profiles": (profiles, _PROFILES),
    "domain_actions": (actions, _ACTS + " select * from acs"),
    "domain_decisions": (decisions, _DECISIONS),
}
