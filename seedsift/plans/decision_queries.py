"""Queries of statistics, verdicts, clusters, reports and streams, with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seedsift.operators import clean, clusters, report, statistics, tails, verdicts
from seedsift.plans import cascade
from seedsift.plans.keyword_queries import _FIRST, _L0, _PRE, TARGET, _l0, _with
from seedsift.sources import tables as S
from seedsift.sources.shared import shared_dir
from seedsift.streaming import log as stream


def _tails(spark, sf):
    kw = tails.extract_tail(clean.dedupe_first(S.keywords(spark, sf)))
    return kw.where("tail <> ''").select("seed_id", "pos", "keyword", "tail")


_TAILS = _FIRST + r""",
n1 as (select *, regexp_replace(trim(lower(keyword)), '\s+', ' ', 'g') as q, seed as s from first),
tl as (select seed_id, pos, keyword, trim(concat_ws(' ', trim(substr(q, 1, strpos(q, s) - 1)), trim(substr(q, strpos(q, s) + length(s))))) as tail from n1 where q <> s),
tw as (select seed_id, tail, unnest(list_distinct(string_split(tail, ' '))) as word from tl),
df as (select seed_id, word, count(*) as df from tw group by 1, 2),
pm as (select seed_id, tail, coalesce(min(log2(df + 1)) filter (length(word) > 2 or regexp_matches(word, '^[0-9]+$')), min(log2(df + 1))) as pmi from (select distinct * from tw) join df using (seed_id, word) group by 1, 2)"""


def word_df(spark, sf):
    return statistics.word_df(_tails(spark, sf))


def document_df(spark, sf):
    docs = S.table(spark, sf, "documents").select("lang", F.col("text").alias("tail"))
    return statistics.word_df(docs, ("lang",)).where("df > 1")


def pmi(spark, sf):
    t = _tails(spark, sf)
    return statistics.pmi(t, statistics.word_df(t)).select("seed_id", "tail", F.round("pmi", 6).alias("pmi"))


def _l2(spark, sf):
    kw = cascade.run_cascade(S.keywords(spark, sf), S.gazetteer(spark, sf), S.brands(spark, sf), TARGET)
    return statistics.apply_l2(kw.withColumn("demoted", F.lit(False)))


def l2(spark, sf):
    return _l2(spark, sf).select("seed_id", "pos", "keyword", F.round("pmi", 6).alias("pmi"), "rule", "l2_label")


_GREY = r""",
kn as (select * from l0 where label in ('VALID', 'GREY') and t <> ''),
kx as (select seed_id, t, unnest(list_distinct(w)) as word from kn), kd as (select seed_id, word, count(*) as df from kx group by 1, 2),
kp as (select seed_id, t, coalesce(min(log2(df + 1)) filter (length(word) > 2 or regexp_matches(word, '^[0-9]+$')), min(log2(df + 1))) as pmi from (select distinct * from kx) join kd using (seed_id, word) group by 1, 2),
gr as (select *, len(negative) > 0 and len(positive) = 0 as pure from kn where label = 'GREY'),
ft as (select seed_id, t, arg_min(pure, pos * 2 + pure::int) as pure from gr group by 1, 2),
dc as (select seed_id, t, pmi, case when pmi >= 2.5 and not pure then 'r1_pmi' when pmi >= 2.5 then 'r2_conflict'
  when len(list_filter(string_split(t, ' '), lambda z: regexp_matches(z, '[0-9]') and regexp_matches(z, '[a-z]'))) > 0 and not pure then 'r28_spec' else 'r6_grey' end as rule from ft join kp using (seed_id, t)),
l2 as (select seed_id, pos, keyword, round(pmi, 6) as pmi, rule, case when rule in ('r1_pmi', 'r28_spec') then 'VALID' else 'GREY' end as l2_label from gr join dc using (seed_id, t))"""
_L2 = _L0 + _GREY


def cascade_stages(spark, sf):
    """The cascade with all its stages but the anchors, which need a lexicon. Brands are districts; the return flag of a line item is its keyword's verdict."""
    kw = S.keywords(spark, sf)
    flag = S.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"))
    flag = flag.agg(F.min(F.expr("case l_returnflag when 'R' then 0 when 'A' then 1 end")).alias("verdict"))
    landed = kw.select("seed_id", "pos", "keyword").join(flag, "pos").select("seed_id", "keyword", "verdict")
    area = S.brands(spark, sf).select("name", F.lit("nation_1").alias("city"), F.when(F.length("name") % 2 == 0, "ASIA").otherwise("EUROPE").alias("country"))
    out = cascade.run_cascade(kw, S.gazetteer(spark, sf), S.brands(spark, sf), TARGET, stages=("pre", "geo", "l0", "l2", "verdict"), districts=area, verdicts=landed)
    return out.select("seed_id", "pos", "keyword", "stage", "reason", "tail", "label", F.col("group").alias("kw_group"))


_PLACES = _PRE + r""",
gh as (select seed_id, keyword, 2 as r, 'foreign_city:' || name as reason from (select *, unnest(qw) as name from pre where reason is null) join gazetteer using (name) where country <> '""" + TARGET + r"""'
  union all select seed_id, keyword, 3, 'foreign_district:' || name from (select *, unnest(qw) as name from pre where reason is null) join brands using (name) where length(name) % 2 = 1),
gf as (select seed_id, keyword, (list(reason order by r, reason))[1] as geo from gh group by 1, 2),
pg as (select pre.* replace (coalesce(reason, geo) as reason) from pre left join gf using (seed_id, keyword))"""
_STAGED = _l0(_PLACES, "pg") + _GREY + r""",
vf as (select l_orderkey * 10 + l_linenumber as pos, min(case l_returnflag when 'R' then 0 when 'A' then 1 end) as verdict from lineitem group by 1),
vk as (select seed_id, keyword, min(verdict) as verdict from keywords join vf using (pos) group by 1, 2),
s1 as (select l0.*, rule, verdict from l0 left join dc on dc.seed_id = l0.seed_id and dc.t = l0.t and label = 'GREY' left join vk on vk.seed_id = l0.seed_id and vk.keyword = l0.keyword),
s2 as (select * replace (case when rule in ('r1_pmi', 'r28_spec') then 'VALID' else label end as label, case when rule is not null then 'l2' when contains(reason, ':') then 'geo' else stage end as stage) from s1),
s3 as (select * replace (case when label = 'TRASH' or verdict is null then label when verdict = 1 then 'VALID' else 'TRASH' end as label, case when label = 'TRASH' or verdict is null then stage else 'verdict' end as stage) from s2),
staged as (select * replace (case when label = 'VALID' then case when list_contains(positive, 'geo') then 'geo' when list_contains(positive, 'brand') then 'brand' when q = s then 'exact_seed' else 'other' end end as "group") from s3)"""


def knn(spark, sf):
    v = S.table(spark, sf, "embeddings")
    out = statistics.knn_score(v.where("vec_id % 50 = 0"), v, "label")
    return out.select("vec_id", F.round("score", 5).alias("score"))


def poles(spark, sf):
    v = S.table(spark, sf, "embeddings")
    out = statistics.pole_contrast(v, statistics.centroids(v, "label"), "label")
    return out.select("vec_id", *(F.round(c, 5).alias(c) for c in ("own", "other", "margin")))


def neighbours(spark, sf):
    kw = clean.dedupe_first(S.keywords(spark, sf)).withColumn("object", F.element_at(F.split("seed", " "), -1))
    return statistics.neighbours(kw, "object")


def routed(spark, sf):
    docs, labels = S.table(spark, sf, "documents"), S.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("verdict"))
    grey = verdicts.apply_verdict_grey(docs.select("doc_id").where("doc_id % 2 = 0"), labels, ["doc_id"])
    valid = verdicts.apply_verdict_valid(docs.select("doc_id").where("doc_id % 2 = 1"), labels, ["doc_id"])
    return verdicts.merge_fork(valid, grey).select("doc_id", "verdict", "label", "branch")


def parsed(spark, sf):
    """Replies made of twenty labels each; some are short, some have a word of their own."""
    labels = S.table(spark, sf, "labels").groupBy((F.col("doc_id") / 20).cast("long").alias("batch_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda x: F.when(x["doc_id"] % 7 == 0, "7").otherwise(x["quality"].cast("string"))), ", ")
    replies = labels.agg(F.concat(joined, F.lit("\nok 1,1")).alias("reply"), (F.count("*") + 1).cast("int").alias("n"))
    return verdicts.labels_table(replies)


def batches(spark, sf):
    kw = clean.dedupe_first(S.keywords(spark, sf)).select("seed_id", F.lower("keyword").alias("keyword"))
    return verdicts.make_batches(kw).select("seed_id", "bucket", "batch", "size", "prompt")


def cost(spark, sf):
    log = S.table(spark, sf, "documents").select(F.col("source").alias("stage"), F.col("n_chars").alias("tokens_in"), (F.col("doc_id") % 50).alias("tokens_out"))
    return verdicts.verdict_cost(log, "0.15", "0.6")


def _assigned(spark, sf):
    code = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.length("p_type") % 6 + 1).cast("int"))
    part = S.table(spark, sf, "part").where("p_partkey % 11 <> 3")
    pair = F.concat((F.col("p_partkey") % clusters.CHUNK + 1).cast("string"), F.lit(":"), code, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), "p_type", F.lit(", x)"))).otherwise(""))
    by = part.groupBy(F.floor(F.col("p_partkey") / clusters.CHUNK).alias("chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", pair.alias("t")))), lambda x: x["t"]), ",")
    return clusters.parse_assignments(by.agg(F.concat(text, F.lit(",bad")).alias("reply")))


def assignments(spark, sf):
    return _assigned(spark, sf).select(F.col("chunk").cast("long").alias("chunk"), "local_id", "code", "name", "problem")


def _clusters(spark, sf):
    part = S.table(spark, sf, "part")
    names = part.select(F.concat(F.lit("c0_"), "p_type", F.lit(", x")).alias("name"), F.lower("p_type").alias("merged")).distinct()
    ids = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"))
    return clusters.expand_clusters(clusters.remap_clusters(_assigned(spark, sf), names), ids)


_ASSIGN = """pa as (select *, p_partkey // 185 as chunk, (p_partkey % 185 + 1)::int as local_id, 'ABCDEF'[(length(p_type) % 6 + 1)::int] as code from part where p_partkey % 11 <> 3),
lg as (select chunk, code, arg_min(p_type || ', x', p_partkey) as name from pa where p_partkey % 2 = 0 group by 1, 2),
asg as (select chunk, local_id, code, name from pa left join lg using (chunk, code)),
cl as (select p_partkey as id, p_name as payload, coalesce(case when name is not null then case when chunk = 0 then lower(split_part(name, ',', 1)) else 'c' || chunk || '_' || name end end, 'UNASSIGNED') as cluster from part left join asg on p_partkey = chunk * 185 + local_id - 1)"""


def _payloads(spark, sf):
    kw = tails.extract_payload(clean.dedupe_first(S.keywords(spark, sf)))
    return kw.groupBy("seed_id", "seed", "payload").agg(F.count("*").alias("n_keywords"))


_PAY = _FIRST + r""", pl as (select seed_id, seed, array_to_string(list_filter(regexp_extract_all(lower(keyword), '\w+'), lambda w: not list_contains(string_split(seed, ' '), w)), ' ') as payload, count(*) as n_keywords from first group by all)"""


def _events(spark, sf):
    """Line items as stages of an order: the flag is the label."""
    flag = F.when(F.col("l_returnflag") == "A", "VALID").when(F.col("l_returnflag") == "N", "GREY").otherwise("TRASH")
    rows = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("kw_id"), F.col("l_linenumber").cast("long").alias("stage_no")).agg(F.min(flag).alias("label"), F.min("l_linestatus").alias("reason"))
    return rows.withColumn("seed_id", F.col("kw_id") % 10).withColumn("stage", F.concat(F.lit("s"), F.col("stage_no").cast("string")))


_EVENTS = """ev as (select l_orderkey as kw_id, l_linenumber::bigint as stage_no, min(case l_returnflag when 'A' then 'VALID' when 'N' then 'GREY' else 'TRASH' end) as label, min(l_linestatus) as reason,
  l_orderkey % 10 as seed_id, 's' || l_linenumber as stage from lineitem group by all)"""
_REPORT = _EVENTS + ", rp as (select stage_no, stage, count(*) as n_in, count(*) filter (label = 'TRASH') as n_blocked, count(*) filter (label = 'GREY') as n_grey, count(*) filter (label = 'VALID') as n_valid, count(*) filter (label <> 'TRASH') as n_out from ev group by 1, 2)"


def _streamed(build, keys):
    def run(spark, sf):
        where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        return stream.run_available(build(stream.read_log(spark, f"{sf}/events.parquet")), f"{where}/out", f"{where}/state", keys)

    return run


_STREAM = """with ev as (select event_id, user_id % 20 as seed_id, event_type as struct, json_extract(props, '$.k')::bigint as k, value, ts from events),
lg as (select *, k % 13 as n_results, 'word' || (k % 40) || case when k % 3 = 0 then ' Alpha' else ' beta' end as keyword from ev)"""

QUERIES = {
    "word_df": (word_df, _with(_TAILS, "select * from df")),
    "document_df": (document_df, r"with w as (select lang, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))) as word from documents) select lang, word, count(*) as df from w group by 1, 2 having count(*) > 1"),
    "pmi": (pmi, _with(_TAILS, "select seed_id, tail, round(pmi, 6) as pmi from pm")),
    "cascade_stages": (cascade_stages, _with(_STAGED, "select seed_id, pos, keyword, stage, reason, t as tail, label, \"group\" as kw_group from staged")),
    "apply_l2": (l2, _with(_L2, "select * from l2")),
    "l2_stats": (lambda s, d: statistics.l2_stats(_l2(s, d)), _with(_L2, "select rule, count(*) as n, min(pmi) as lo, max(pmi) as hi, round(avg(pmi), 6) as mean from l2 group by 1")),
    "knn_score": (knn, """with c as (select a.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])) as cos
 from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by vec_id order by cos desc) as r from c)
 select vec_id, round(avg(cos), 5) as score from r where r <= 3 group by 1"""),
    "pole_contrast": (poles, """with u as (select label, unnest(range(1, len(embedding) + 1)) as p, unnest(embedding)::double as x from embeddings), m as (select label, p, avg(x) as m from u group by 1, 2),
 ct as (select label, list(m order by p) as c from m group by 1),
 w as (select vec_id, e.label, ct.label as pole, list_dot_product(embedding::double[], c) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(c, c)) as cos from embeddings e, ct),
 o as (select vec_id, max(cos) filter (pole = label) as own, max(cos) filter (pole <> label) as other from w group by 1)
 select vec_id, round(own, 5) as own, round(other, 5) as other, round(own - other, 5) as margin from o"""),
    "neighbours": (neighbours, _with(_FIRST, r""", w as (select seed_id, keyword, string_split(seed, ' ')[-1] as o, list_filter(string_split_regex(lower(keyword), '\s+'), lambda x: x <> '') as ws from first),
 n as (select seed_id, keyword, o, unnest(ws[greatest(1, list_position(ws, o) - 2):list_position(ws, o) + 2]) as word from w where list_position(ws, o) > 0)
 select seed_id, word, count(distinct keyword) as n from n where word <> o group by 1, 2 having count(distinct keyword) >= 2""")),
    "verdict_routing": (routed, "select d.doc_id, quality as verdict, case quality when 1 then 'VALID' when 0 then 'TRASH' else case when d.doc_id % 2 = 0 then 'GREY' else 'VALID' end end as label, case when d.doc_id % 2 = 0 then 'grey' else 'valid' end as branch from documents d left join labels l on l.doc_id = d.doc_id"),
    "parse_labels": (parsed, """with g as (select doc_id // 20 as batch_id, list(case when doc_id % 7 = 0 then null else quality end order by doc_id) as q from labels group by 1)
 select batch_id, unnest(range(len(q) + 1))::int as i, unnest(list_append(q, null))::int as verdict from g"""),
    "make_batches": (batches, _with(_FIRST, ", r as (select seed_id, lower(keyword) as k, row_number() over (partition by seed_id order by lower(keyword)) - 1 as n from first) select seed_id, 0::bigint as bucket, (n // 20)::int as batch, count(*)::int as size, string_agg((n % 20 + 1) || '. ' || k, chr(10) order by n) as prompt from r group by seed_id, n // 20")),
    "verdict_cost": (cost, "select source as stage, count(*) as calls, sum(n_chars)::bigint as tokens_in, sum(doc_id % 50)::bigint as tokens_out, round((sum(n_chars) * 0.15 + sum(doc_id % 50) * 0.6) / 1000000, 6)::double as cost from documents group by 1"),
    "parse_assignments": (assignments, f"with {_ASSIGN} select chunk, local_id, code, name, case when name is null then 'unknown_code' end as problem from asg union all select distinct p_partkey // 185, null, null, null, 'bad_pair' from part where p_partkey % 11 <> 3"),
    "expand_clusters": (lambda s, d: _clusters(s, d).select("id", "payload", "cluster"), f"with {_ASSIGN} select * from cl"),
    "cluster_metrics": (lambda s, d: clusters.cluster_metrics(_clusters(s, d)), f"with {_ASSIGN}, z as (select cluster, count(*) as n from cl group by 1) select count(*) filter (cluster <> 'UNASSIGNED') as n_clusters, sum(n)::bigint as n_payloads, round(max(n) / sum(n), 6) as largest_share, coalesce(sum(n) filter (cluster = 'UNASSIGNED'), 0)::bigint as n_unassigned from z"),
    "validate_payloads": (lambda s, d: clusters.validate_payloads(_payloads(s, d)), _with(_PAY, "select seed_id, count(*) as n, count(*) filter (payload = '') as n_empty, count(*) filter (length(payload) = 1) as n_one, count(*) filter (length(payload) between 1 and 2) as n_short, count(*) filter (list_has_any(string_split(payload, ' '), string_split(seed, ' '))) as n_leaked from pl group by 1")),
    "payload_lengths": (lambda s, d: clusters.length_histogram(_payloads(s, d)), _with(_PAY, "select seed_id, case when payload = '' then 0 else len(string_split(payload, ' ')) end::int as n_words, count(*) as n from pl group by 1, 2")),
    "top_payloads": (lambda s, d: clusters.top_payloads(_payloads(s, d)), _with(_PAY, ", r as (select seed_id, payload, n_keywords, row_number() over (partition by seed_id order by n_keywords desc, payload desc) as r from pl) select seed_id, (r - 1)::int as rank, payload, n_keywords from r where r <= 15")),
    "stage_report": (lambda s, d: report.stage_report(_events(s, d)), f"with {_REPORT} select * from rp"),
    "report_text": (lambda s, d: report.report_text(report.stage_report(_events(s, d))), f"with {_REPORT} select stage_no, lpad(stage_no::varchar, 2, '0') || ' ' || stage || ' in=' || n_in || ' blocked=' || n_blocked || ' grey=' || n_grey || ' valid=' || n_valid || ' out=' || n_out as line from rp"),
    "first_blocker": (lambda s, d: report.first_blocker(_events(s, d)), f"with {_EVENTS} select seed_id, kw_id, arg_min(stage, stage_no) as stage, arg_min(reason, stage_no) as reason from ev where label = 'TRASH' group by 1, 2"),
    "keyword_trace": (lambda s, d: report.keyword_trace(_events(s, d)), f"with {_EVENTS}, b as (select kw_id, min(stage_no) as b from ev where label = 'TRASH' group by 1), k as (select ev.* from ev left join b using (kw_id) where b is null or stage_no <= b) select seed_id, kw_id, string_agg(stage || ':' || label, '>' order by stage_no) as path, case arg_max(label, stage_no) when 'TRASH' then 'blocked' when 'GREY' then 'grey' else 'passed' end as status from k group by 1, 2"),
    "trace_details": (lambda s, d: report.trace_details(_events(s, d), tuple(f"s{i}" for i in range(1, 8))), f"with {_EVENTS} select seed_id, kw_id, " + ", ".join(f"max(label) filter (stage = 's{i}') as s{i}" for i in range(1, 8)) + " from ev group by 1, 2"),
    "query_trace": (lambda s, d: report.query_trace(_events(s, d), "GREY", "O").select("kw_id", "stage", "reason"), f"with {_EVENTS} select kw_id, stage, reason from ev where label = 'GREY' and contains(reason, 'O')"),
    "stream_fold": (_streamed(stream.stream_fold, ["hour", "seed_id", "keyword"]), _STREAM + " select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as hour, seed_id, keyword, count(*) as weight from lg where n_results > 0 group by all"),
    "stream_yield": (_streamed(stream.stream_yield, ["hour", "struct"]), _STREAM + " select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as hour, struct, count(*) as requests, sum(n_results)::bigint as suggestions, round(sum(value), 2) as sum_ms from lg group by all"),
}
