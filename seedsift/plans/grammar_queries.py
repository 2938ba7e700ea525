"""Queries of the grammar detectors, with SQL that gives the same rows.

The star schema has no lexicon, so one is derived from the parts: the words of names and types, with a part of speech
by their length and a case by their first letter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import clean, detectors, tails
from seedsift.plans.keyword_queries import _PRE, TARGET, _with
from seedsift.sources import tables as S

NAMES = ["conjunctive", "dangling", "orphan_genitive", "single_infinitive"]
POS = ("NOUN", "ADJF", "INFN", "CONJ", "PREP")


def lexicon(spark, sf):
    part = S.table(spark, sf, "part").select(F.explode(X.words(F.concat_ws(" ", "p_name", "p_type"))).alias("word")).distinct()
    pos = F.element_at(F.array(*map(F.lit, POS)), (F.length("word") % 5 + 1).cast("int"))
    case = F.when(F.ascii("word") % 2 == 0, "gent").otherwise("nomn")
    return part.select("word", F.lit(0).alias("rank"), F.col("word").alias("lemma"), pos.alias("pos"), case.alias("case"), F.lit("sing").alias("number"), F.lit("masc").alias("gender"), F.lit(1.0).alias("score"), F.lit(True).alias("known"))


def grammar_signals(spark, sf):
    kw = tails.extract_tail(clean.dedupe_first(S.keywords(spark, sf)))
    pairs = kw.select("seed_id", "seed", "tail").where("tail <> ''").distinct()
    hits = detectors.dictionary_hits(pairs, S.gazetteer(spark, sf), S.brands(spark, sf), TARGET)
    fired = detectors.signals(hits, lexicon(spark, sf), NAMES)
    return fired.select("seed_id", "tail", F.array_join("positive", ",").alias("positive"), F.array_join("negative", ",").alias("negative"))


_GRAMMAR = _PRE + r""",
lx as (select word, ['NOUN', 'ADJF', 'INFN', 'CONJ', 'PREP'][length(word) % 5 + 1] as pos, case when ascii(word) % 2 = 0 then 'gent' else 'nomn' end as gc
  from (select distinct unnest(string_split(lower(p_name || ' ' || p_type), ' ')) as word from part)),
pr as (select distinct seed_id, s, t from (select seed_id, s, case when q = s then '' else t end as t from pre) where t <> ''),
tk as (select seed_id, t, i, x.w[i] as word from (select *, unnest(range(1, len(w) + 1)) as i from (select seed_id, t, string_split(t, ' ') as w from pr)) x),
ta as (select seed_id, t, count(*) as n, list(pos order by i) as p, list(gc order by i) as c, list(tk.word order by i) as w from tk left join lx on lx.word = tk.word group by seed_id, t),
sk as (select s, i, x.w[i] as word from (select *, unnest(range(1, len(w) + 1)) as i from (select distinct s, string_split(s, ' ') as w from pr)) x),
sa as (select s, list(pos order by i) as p, list(gc order by i) as c, list_filter(list(case when pos = 'NOUN' then gc end order by i desc), lambda x: x is not null)[1] as noun,
    coalesce(max(case when pos = 'NOUN' and gc = 'gent' then i end), 0) as g from sk left join lx on lx.word = sk.word group by s),
j as (select pr.seed_id, pr.t, ta.n, ta.p, ta.c, ta.w, sa.p as sp, sa.c as sc, sa.noun, sa.g,
    coalesce(len(sa.p) >= 2 and sa.p[1] = 'NOUN' and sa.c[1] = 'nomn' and coalesce(sa.p[2] <> 'PREP', true) and len(list_filter(range(2, len(sa.p) + 1), lambda i: coalesce(sa.p[i] = 'NOUN' and sa.c[i] = 'gent', false))) > 0, false) as service
  from pr join ta using (seed_id, t) join sa using (s)),
f as (select seed_id, t as tail, coalesce(n >= 2 and ((p[1] = 'CONJ' and list_has_any(p[2:], ['NOUN', 'ADJF', 'INFN'])) or (p[n] in ('CONJ', 'PREP') and list_has_any(p[:n - 1], ['NOUN', 'ADJF', 'INFN']))), false) as conj,
  coalesce(n <= 2 and list_contains(p, 'ADJF') and not list_contains(p, 'NOUN') and not list_has_any(w, (select list(name) from gazetteer)) and noun is not null
    and len(list_filter(range(1, n + 1), lambda i: coalesce(p[i] = 'ADJF' and c[i] = noun, false))) = 0, false) as dang,
  coalesce(n = 1 and p[1] = 'NOUN' and c[1] = 'gent' and noun = 'gent' and not coalesce(g > 1 and (sp[g - 1] = 'INFN' or (sp[g - 1] = 'NOUN' and sc[g - 1] = 'nomn')), false), false) as orphan,
  coalesce(n = 1 and p[1] = 'INFN' and not list_contains(sp, 'INFN') and not service, false) as inf from j)"""

#: Detectors by lists of words and phrases, and by the shape of a short tail. The tails below make each fire and keep each from firing.
TERMS = ["reputation", "location", "time", "contacts", "verb_modifier", "info_intent", "premod_adj", "postmod_adj", "meta", "number_hijack", "short_garbage", "noise_suffix", "prep_modifier", "fragment", "broken_grammar"]
SAID = (
    "отзыв", "отзывы", "рядом", "на дому", "срочно", "срочный", "без выходных", "телефон", "номер телефона", "топ", "топ мастер", "быстро", "вручную", "как", "где", "что это", "не работает", "не тут", "новый", "нового", "что означает", "зачем",
    "рублей", "рубля", "аб", "ок", "бу", "12", "различия", "значит", "после ремонта", "после ремонт", "для", "без", "есть", "можно", "это", "чтобы", "для ремонта", "для ремонтом", "от 12", "мастер",
)


def _terms_lexicon(spark):
    """word, lemma, pos, case, number, gender, known and grammemes of the words of SAID and of the seeds."""
    rows = [
        ("отзыв", "отзыв", "NOUN", "nomn", "sing", "masc", []), ("отзывы", "отзыв", "NOUN", "nomn", "plur", "masc", []), ("рядом", "рядом", "ADVB", None, None, None, []), ("на", "на", "PREP", None, None, None, []), ("дому", "дом", "NOUN", "loct", "sing", "masc", ["inan"]),
        ("срочно", "срочно", "ADVB", None, None, None, []), ("срочный", "срочный", "ADJF", "nomn", "sing", "masc", []), ("без", "без", "PREP", None, None, None, []), ("выходных", "выходной", "NOUN", "gent", "plur", "masc", ["inan"]), ("телефон", "телефон", "NOUN", "nomn", "sing", "masc", ["inan"]),
        ("номер", "номер", "NOUN", "nomn", "sing", "masc", ["inan"]), ("телефона", "телефон", "NOUN", "gent", "sing", "masc", ["inan"]), ("топ", "топ", "NOUN", "nomn", "sing", "masc", ["inan"]), ("мастер", "мастер", "NOUN", "nomn", "sing", "masc", ["anim"]),
        ("быстро", "быстро", "ADVB", None, None, None, []), ("как", "как", "ADVB", None, None, None, ["Ques"]), ("где", "где", "ADVB", None, None, None, ["Ques"]), ("что", "что", "NPRO", "nomn", "sing", None, []), ("это", "это", "PRCL", None, None, None, []),
        ("не", "не", "PRCL", None, None, None, []), ("работает", "работать", "VERB", None, "sing", None, ["3per"]), ("тут", "тут", "ADVB", None, None, None, []), ("новый", "новый", "ADJF", "nomn", "sing", "masc", []), ("нового", "новый", "ADJF", "gent", "sing", "masc", []),
        ("рублей", "рубль", "NOUN", "gent", "plur", "masc", ["inan"]), ("рубля", "рубль", "NOUN", "gent", "sing", "masc", ["inan"]), ("ремонта", "ремонт", "NOUN", "gent", "sing", "masc", ["inan"]), ("ремонт", "ремонт", "NOUN", "nomn", "sing", "masc", ["inan"]), ("ремонтом", "ремонт", "NOUN", "ablt", "sing", "masc", ["inan"]),
        ("после", "после", "PREP", None, None, None, []), ("для", "для", "PREP", None, None, None, []), ("от", "от", "PREP", None, None, None, []), ("есть", "быть", "VERB", None, None, None, ["3per"]), ("можно", "можно", "PRED", None, None, None, []), ("чтобы", "чтобы", "CONJ", None, None, None, []),
        ("зачем", "зачем", "ADVB", None, None, None, ["Ques"]), ("означает", "означать", "VERB", None, "sing", None, ["3per"]), ("купить", "купить", "INFN", None, None, None, []), ("окно", "окно", "NOUN", "accs", "sing", "neut", ["inan"]), ("дом", "дом", "NOUN", "nomn", "sing", "masc", ["inan"]),
        ("ок", "ок", "INTJ", None, None, None, []), ("различия", "различие", "NOUN", "nomn", "plur", "neut", ["inan"]), ("значит", "значить", "VERB", None, "sing", None, ["3per"]), ("вручную", "вручную", "ADVB", None, None, None, []),
    ]
    return spark.createDataFrame([(w, 0, lemma, pos, case, number, gender, 1.0, True, marks) for w, lemma, pos, case, number, gender, marks in rows], "word string, rank int, lemma string, pos string, case string, number string, gender string, score double, known boolean, grammemes array<string>")


def term_signals(spark, sf):
    """Each line item says one of the tails, on a side of one of three seeds."""
    item = S.table(spark, sf, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    tail = F.element_at(F.array(*map(F.lit, SAID)), (k % len(SAID) + 1).cast("int"))
    seed = F.element_at(F.array(F.lit("купить окно"), F.lit("ремонт дом"), F.lit("дом 5")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    side = F.element_at(F.array(F.lit("pre"), F.lit("post")), (F.col("l_partkey") % 2 + 1).cast("int"))
    rows = item.select((F.col("l_suppkey") % 3).cast("long").alias("seed_id"), seed.alias("seed"), tail.alias("tail"), side.alias("side")).distinct()
    hits = detectors.dictionary_hits(rows, S.gazetteer(spark, sf), S.brands(spark, sf), TARGET)
    fired = detectors.signals(hits, _terms_lexicon(spark), TERMS)
    return fired.select("seed_id", "tail", "side", F.array_join(F.array_sort("positive"), ",").alias("positive"), F.array_join(F.array_sort("negative"), ",").alias("negative"))


# What each tail says by itself; the SQL adds what it says beside a verb in the seed (adverbs in о or е), behind a number, and beside a noun that
# agrees with it.
_SAYS = {
    "отзыв": ("reputation", ""), "отзывы": ("reputation", ""), "рядом": ("location", ""), "на дому": ("location", ""), "срочно": ("time", ""), "срочный": ("", ""), "без выходных": ("prep_modifier,time", ""),
    "телефон": ("contacts", ""), "номер телефона": ("contacts", ""), "топ": ("", ""), "топ мастер": ("reputation", ""), "быстро": ("time", ""), "вручную": ("", ""), "как": ("info_intent", "meta"), "где": ("info_intent", ""),
    "что это": ("info_intent", "fragment,meta"), "не работает": ("info_intent", "fragment"), "не тут": ("", ""), "новый": ("", ""), "нового": ("", ""), "что означает": ("info_intent", "meta"), "зачем": ("info_intent", "meta"),
    "рублей": ("", ""), "рубля": ("", ""), "аб": ("", "short_garbage"), "ок": ("", "short_garbage"), "бу": ("", ""), "12": ("", ""), "различия": ("", "noise_suffix"), "значит": ("", "fragment,noise_suffix"), "после ремонта": ("prep_modifier", ""),
    "после ремонт": ("", ""), "для": ("", "fragment"), "без": ("", "fragment"), "есть": ("", "fragment"), "можно": ("", "fragment"), "это": ("info_intent", "fragment"), "чтобы": ("", "fragment"), "для ремонта": ("prep_modifier", ""),
    "для ремонтом": ("", "broken_grammar"), "от 12": ("", ""), "мастер": ("", ""),
}
_TERMS = (
    "with sy(tail, positive, negative) as (values " + ", ".join(f"('{t}', '{p}', '{n}')" for t, (p, n) in _SAYS.items()) + "), "
    + "ki(tail, i) as (select t, i - 1 from (select unnest([" + ", ".join(f"'{t}'" for t in SAID) + "]) as t, unnest(range(1, " + str(len(SAID) + 1) + ")) as i)), "
    + f"""ro as (select distinct (l_suppkey % 3)::bigint as seed_id, ki.tail, case when l_partkey % 2 = 0 then 'pre' else 'post' end as side from lineitem join ki on i = (l_orderkey + l_linenumber) % {len(SAID)})
select seed_id, ro.tail, side, array_to_string(list_sort(list_filter(string_split(sy.positive, ',') || [case when seed_id = 0 and ro.tail in ('быстро', 'срочно', 'можно', 'где') then 'verb_modifier' end,
    case when seed_id > 0 and ro.tail in ('срочный', 'новый') then case side when 'pre' then 'premod_adj' else 'postmod_adj' end end], lambda x: coalesce(x, '') <> '')), ',') as positive,
  array_to_string(list_sort(list_filter(string_split(sy.negative, ',') || [case when seed_id = 2 and ro.tail in ('рублей', 'выходных') then 'number_hijack' end], lambda x: coalesce(x, '') <> '')), ',') as negative
from ro join sy on sy.tail = ro.tail"""
)

QUERIES = {
    "term_signals": (term_signals, _TERMS),
    "grammar_signals": (
        grammar_signals,
        _with(_GRAMMAR, """select seed_id, tail, case when conj then 'conjunctive' else '' end as positive,
            array_to_string(list_filter([case when dang then 'dangling' end, case when orphan then 'orphan_genitive' end, case when inf then 'single_infinitive' end], lambda x: x is not null), ',') as negative from f"""),
    ),
}
