"""Queries of the anchors of grey keywords, with SQL that gives the same rows.

Each part gives a seed of its name, type and, for some sizes, the size. Each line item gives a keyword of its part's
seed, mixed with words of the part whose number is the supplier's. Words are parts of speech by their place and length;
a synonym has the same length, a cohyponym one letter more or less. The vectors are no word vectors, so the thresholds
of their cosines are lower here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import anchors
from seedsift.sources import tables as S
from seedsift.sources.shared import written

COS = {"cos_object": 0.1, "cos_action": 0.15, "cos_gap": 0.0, "cos_number": 0.1}


def _parts(spark, sf):
    part = S.table(spark, sf, "part").select("p_partkey", "p_size", F.lower("p_name").alias("nm"), F.lower("p_type").alias("ty"))
    words, size = X.words("nm"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")
    return part.select("*", F.get(words, F.lit(0)).alias("n1"), F.get(words, F.lit(1)).alias("n2"), F.concat("nm", F.lit(" "), "ty", size).alias("seed"))


def _seeds(spark, sf):
    return _parts(spark, sf).groupBy("seed").agg(F.min("p_partkey").cast("long").alias("seed_id")).select("seed_id", "seed")


def _keywords(spark, sf):
    """(seed_id, keyword, label), one row for each line item."""
    part, item = _parts(spark, sf), S.table(spark, sf, "lineitem")
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("n1").alias("o1"), F.col("n2").alias("o2"), F.col("ty").alias("ot"))
    wide = item.join(part, item["l_partkey"] == part["p_partkey"]).join(other, "l_suppkey").join(_seeds(spark, sf), "seed")
    n1, n2, ty, o1, o2, ot, size = *(F.col(c) for c in ("n1", "n2", "ty", "o1", "o2", "ot")), F.col("p_size").cast("string")
    shapes = [(n1, n2, ty, size), (o1, n2, ty, size), (n1, o2, ot), (n2, ot, size), (o1, o2, n1), (F.concat(n1, F.lit("s")), o2, F.concat(size, F.lit("mm"))), (F.lit("***"),)]
    pick = (F.col("l_orderkey") + F.col("l_linenumber")) % len(shapes)
    text = F.coalesce(*(F.when(pick == i, F.concat_ws(" ", *s)) for i, s in enumerate(shapes)))
    return wide.select("seed_id", text.alias("keyword"), F.when(F.col("l_suppkey") % 3 == 0, "VALID").otherwise("GREY").alias("label"))


def _dictionary(spark, sf):
    """(word, second): the words of names and types, and whether one is a name's second word."""
    part = _parts(spark, sf)
    words = part.select(F.explode(F.array("n1", "n2", "ty")).alias("word")).distinct()
    second = part.select(F.col("n2").alias("word")).distinct().withColumn("second", F.lit(True))
    return words.join(second, "word", "left").withColumn("second", F.coalesce("second", F.lit(False)))


def _lexicon(spark, sf):
    long = F.length("word")
    pos = F.when(F.col("second"), "NOUN").when(long == 3, "ADVB").when(long == 4, "INFN").when(long == 8, "ADJF").otherwise("NOUN")
    return _dictionary(spark, sf).select("word", F.lit(0).alias("rank"), F.col("word").alias("lemma"), pos.alias("pos"), F.lit(True).alias("known"))


def _facts(spark, sf):
    return _dictionary(spark, sf).select(F.col("word").alias("lemma"), F.length("word").alias("hyponyms"), (~F.col("second") & (F.length("word") == 5)).alias("deverbal"))


def _relations(spark, sf):
    part = _parts(spark, sf)
    pairs = part.select(F.col("n2").alias("lemma"), F.col("ty").alias("other")).union(part.select("n1", "n2")).distinct()
    apart = F.abs(F.length("lemma") - F.length("other"))
    return pairs.withColumn("rel", F.when(apart == 0, "synonym").when(apart == 1, "cohyponym")).where("rel is not null")


def _vectors(spark, sf):
    vectors = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    words = _dictionary(spark, sf).select(F.col("word").alias("lemma"), (F.ascii("word") + F.length("word")).cast("long").alias("vec_id"))
    return words.join(vectors, "vec_id").select("lemma", "embedding")


def _axes(spark, sf):
    return anchors.seed_axes(_seeds(spark, sf), _lexicon(spark, sf), _facts(spark, sf))


def axes(spark, sf):
    return _axes(spark, sf).select("seed_id", "action", "object", F.array_join("others", ",").alias("others"), "qualifier")


def words(spark, sf):
    valid = _keywords(spark, sf).where("label = 'VALID'")
    return anchors.seed_words(valid, _axes(spark, sf), _lexicon(spark, sf))


def decisions(spark, sf):
    kw = written(_keywords(spark, sf))
    grey, valid = kw.where("label = 'GREY'"), kw.where("label = 'VALID'")
    out = anchors.judge_grey(grey, valid, written(_axes(spark, sf)), _lexicon(spark, sf), _relations(spark, sf), _vectors(spark, sf), **COS)
    return out.drop("missing")


_AXES = r"""with pt as (select *, string_split(nm, ' ')[1] as n1, string_split(nm, ' ')[2] as n2, nm || ' ' || ty || case when p_size % 4 = 0 then ' ' || p_size::varchar else '' end as seed
  from (select p_partkey, p_size, lower(p_name) as nm, lower(p_type) as ty from part)),
sd as (select min(p_partkey)::bigint as seed_id, seed from pt group by seed),
dw as (select distinct word, word in (select n2 from pt) as second from (select unnest([n1, n2, ty]) as word from pt)),
lx as (select word, case when second then 'NOUN' when length(word) = 3 then 'ADVB' when length(word) = 4 then 'INFN' when length(word) = 8 then 'ADJF' else 'NOUN' end as pos, not second and length(word) = 5 as dev from dw),
sw as (select seed_id, i, w[i] as word from (select *, unnest(range(1, len(w) + 1)) as i from (select seed_id, string_split(seed, ' ') as w from sd))),
sc as (select sw.*, pos, dev from sw join lx on lx.word = sw.word where pos <> 'ADVB'),
a1 as (select seed_id, count(*) as n, min(word) as only_one, list(distinct word) as content, coalesce(arg_min(word, i) filter (pos = 'INFN'), arg_min(word, i) filter (pos = 'NOUN' and dev), arg_min(word, i) filter (pos = 'NOUN')) as act from sc group by 1),
a2 as (select sc.seed_id, coalesce(arg_min(word, i) filter (pos = 'NOUN' and word <> act and not dev), arg_max(word, i) filter (pos = 'NOUN' and word <> act)) as obj from sc join a1 on a1.seed_id = sc.seed_id group by 1),
a3 as (select sd.seed_id, content, case when obj is null and n = 1 then null else act end as act, case when obj is null and n = 1 then only_one else obj end as obj from sd left join a1 on a1.seed_id = sd.seed_id left join a2 on a2.seed_id = sd.seed_id),
ot as (select sc.seed_id, word, min(i) as i from sc join a3 on a3.seed_id = sc.seed_id where word is distinct from act and word is distinct from obj group by 1, 2),
ax as (select a3.seed_id, a3.content, a3.act, a3.obj, o.others, q.num from a3 left join (select seed_id, list(word order by i) as others from ot group by 1) o on o.seed_id = a3.seed_id
  left join (select seed_id, arg_min(word, i) as num from sw where regexp_full_match(word, '[0-9]+') group by 1) q on q.seed_id = a3.seed_id)"""

_WORDS = _AXES + r""",
kw as (select distinct seed_id, label, case k when 0 then concat_ws(' ', n1, n2, ty, s) when 1 then concat_ws(' ', o1, n2, ty, s) when 2 then concat_ws(' ', n1, o2, ot) when 3 then concat_ws(' ', n2, ot, s)
    when 4 then concat_ws(' ', o1, o2, n1) when 5 then concat_ws(' ', n1 || 's', o2, s || 'mm') else '***' end as keyword
  from (select sd.seed_id, case when l_suppkey % 3 = 0 then 'VALID' else 'GREY' end as label, (l_orderkey + l_linenumber) % 7 as k, p.n1, p.n2, p.ty, p.p_size::varchar as s, o.n1 as o1, o.n2 as o2, o.ty as ot
    from lineitem join pt p on l_partkey = p.p_partkey join pt o on l_suppkey = o.p_partkey join sd on sd.seed = p.seed)),
kt as (select seed_id, label, keyword, i, w[i] as word from (select *, unnest(range(1, len(w) + 1)) as i from (select *, regexp_extract_all(keyword, '[a-z0-9]+') as w from kw))),
vt as (select kt.seed_id, keyword, i, kt.word, pos, act, obj, others from kt join ax on ax.seed_id = kt.seed_id left join lx on lx.word = kt.word where label = 'VALID'),
nb as (select b.seed_id, b.word as lemma from vt a join vt b on a.seed_id = b.seed_id and a.keyword = b.keyword where a.word = a.obj and a.i <> b.i and abs(a.i - b.i) <= 2 and b.pos = 'NOUN' and b.word <> b.obj
  and b.word is distinct from b.act and not coalesce(list_contains(b.others, b.word), false) group by 1, 2 having count(distinct b.keyword) >= 2),
qa as (select a.seed_id, a.word as lemma from vt a where i = 1 and pos = 'ADVB' and exists (select 1 from vt b where b.seed_id = a.seed_id and b.keyword = a.keyword and b.word = b.act) group by 1, 2 having count(*) >= 2)"""

_DECISIONS = _WORDS + r""",
rl as (select * from (select lemma, related, abs(length(lemma) - length(related)) as apart from (select distinct n2 as lemma, ty as related from pt union select n1, n2 from pt)) where apart <= 1),
vc as (select word, embedding::double[] as e from dw join embeddings on vec_id = ascii(word) + length(word)),
gt as (select kt.*, pos, act, obj, others, num from kt join ax on ax.seed_id = kt.seed_id left join lx on lx.word = kt.word where label = 'GREY'),
gm as (select gt.*, nb.lemma is not null as near, qa.lemma is not null as asks, list_cosine_similarity(v.e, vo.e) as co, list_cosine_similarity(v.e, va.e) as ca,
    exists (select 1 from rl where rl.lemma = obj and rl.related = gt.word and apart = 0) as osyn, exists (select 1 from rl where rl.lemma = obj and rl.related = gt.word and apart = 1) as ocoh,
    exists (select 1 from rl where rl.lemma = act and rl.related = gt.word and apart = 0) as asyn
  from gt left join nb on nb.seed_id = gt.seed_id and nb.lemma = gt.word left join qa on qa.seed_id = gt.seed_id and qa.lemma = gt.word
  left join vc v on v.word = gt.word left join vc vo on vo.word = obj left join vc va on va.word = act),
pr as (select seed_id, keyword,
    coalesce(bool_or(starts_with(word, num) and not regexp_matches(substr(word, length(num) + 1, 1), '[0-9]')), false) as has_num,
    coalesce(bool_or(word = obj), false) as ol, bool_or(osyn) as os, bool_or(ocoh) as oc,
    coalesce(bool_or(near and pos = 'NOUN' and length(word) >= 3 and co >= 0.1 and co - coalesce(ca, 0) >= 0), false) as oh, coalesce(bool_or(near and pos = 'NOUN' and i = 1 and length(word) <= 4), false) as ob,
    coalesce(bool_or(word = act), false) as al, bool_or(asyn) as asy, coalesce(bool_or(pos = 'ADVB' and asks), false) as aq, coalesce(bool_or(pos in ('NOUN', 'INFN', 'ADVB') and word <> act and length(word) >= 3 and ca >= 0.15), false) as an
  from gm group by 1, 2),
ms as (select g.seed_id, g.keyword, string_agg('other:' || o.word, ',' order by o.i) as failed, string_agg(o.word, ',' order by o.i) as missing from (select distinct seed_id, keyword from kw where label = 'GREY') g join ot o on o.seed_id = g.seed_id
  where not contains(g.keyword, o.word) and not exists (select 1 from gt join rl on rl.related = gt.word and rl.lemma = o.word and apart = 0 where gt.seed_id = g.seed_id and gt.keyword = g.keyword) group by 1, 2),
fx as (select k.seed_id, k.keyword, num, coalesce(has_num, false) as has_num, missing, failed, pr.keyword is null as blank,
    case when obj is null then 'no_object_in_seed' when contains(k.keyword, obj) then 'substring' when ol then 'lemma' when os then 'synonym' when oc then 'cohyponym' when oh then 'hyponym' when ob then 'short_first_word' end as object_proof,
    case when act is null then 'no_action_in_seed' when contains(k.keyword, act) then 'substring' when al then 'lemma' when asy then 'synonym' when aq then 'question_word' when an then 'near_action' end as action_proof
  from (select distinct seed_id, keyword from kw where label = 'GREY') k join ax on ax.seed_id = k.seed_id left join pr on pr.seed_id = k.seed_id and pr.keyword = k.keyword left join ms on ms.seed_id = k.seed_id and ms.keyword = k.keyword)
select seed_id, keyword, case when blank or (num is not null and not has_num) or object_proof is null or action_proof is null then 'TRASH' when missing is not null then 'GREY_SOFT' else 'GREY' end as anchor_label,
  case when blank then 'empty' when num is not null and not has_num then 'qualifier_missing:' || num
    when object_proof is null or action_proof is null then 'axis_unproven:' || concat_ws(',', case when object_proof is null then 'obj' end, case when action_proof is null then 'act' end, failed)
    when missing is not null then 'others_missing:' || missing else 'all_axes_proven' end as anchor_reason, object_proof, action_proof from fx"""

QUERIES = {
    "seed_axes": (axes, _AXES + " select seed_id, act as action, obj as object, coalesce(array_to_string(others, ','), '') as others, num as qualifier from ax"),
    "anchor_words": (words, _WORDS + " select coalesce(nb.seed_id, qa.seed_id) as seed_id, coalesce(nb.lemma, qa.lemma) as lemma, nb.lemma is not null as neighbour, qa.lemma is not null as question from nb full join qa on nb.seed_id = qa.seed_id and nb.lemma = qa.lemma"),
    "anchor_decisions": (decisions, _DECISIONS),
}
