"""Probes from other spellings of a seed: doubled and look-alike letters, endings, and symbols with the cursor beside them.

Templates are tables of fixed size made by rule; seeds meet them once. A template's left part ends where the cursor counts from.
In patterns {s} is the seed, {w} its first word and {r} the rest, {p} and {q} the parts before and after a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import expand as E

#: Letters that look alike in Latin, vowels that an ending replaces, endings, and what the experiments change.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x"}
VOWELS = "аеёиоуыэюя"
BRUTE_ENDINGS = ("и", "а", "е", "у", "ы", "ом", "ей", "о", "ю")
SEP_ENDINGS = ("а", "у", "е", "ы", "и", "ов", "ом")
EXPERIMENTS = {"double_space": 3, "ds_it": 2, "client_yt": 2, "cp_one": 1}
#: Symbols, prepositions and pairs of both.
SYMBOLS = ('"', "(", "/", "+", "№", "?", "!", "-", ".", ":", "_", "[")
ALT_SYMBOLS = (":", "(", "№")
PAIRS = (
    ("(", "для", "скобка_для"), ("+", "от", "плюс_от"), (":", "при", "двоет_при"), ("(", "из", "скобка_из"), ("/", "без", "слеш_без"), ("[", "за", "скоб_за"),
    ("+", "со", "плюс_со"), ("(", "на", "скобка_на"), (":", "по", "двоет_по"), ("/", "во", "слеш_во"), ("(", "до", "скобка_до"), ("+", "к", "плюс_к"),
)
INFIX_SYMBOLS = ('"', "(", "/", "+", "№", ":", ",")
WIDE_SYMBOLS = ("(", ":", "+", "№", "/", ",", ".", "[", "!", "?")
WIDE_PREPOSITIONS = ("для", "от", "при", "из", "без", "за", "со", "на", "по", "до")
UPPER_SYMBOLS = ("(", ":", "№")
DENSE_SYMBOLS = ("(", ":", "+", "№")
DENSE_PREPOSITIONS = ("для", "от", "при", "к", "с")
METHODS = ("morph", "exp", "brute", "sep", "triggers")

TEMPLATE = "label string, variant string, symbol string, lead string, rest string, delta int, gap boolean"
LETTERS = E.SWEPT_LETTERS


def _code(symbol: str) -> str:
    return symbol if symbol.isalnum() else f"{ord(symbol):x}"


def trigger_templates(spark: SparkSession) -> DataFrame:
    """All symbol probes: behind the seed, with letters in both cases, digits, a dot, a no-break blank and prepositions; inside the seed; and glued to its first word."""
    rows = []

    def add(label, variant, symbol, lead, rest, delta, gap=False):
        rows.append((f"trg_{label}", variant, symbol, lead, rest, delta, gap))

    for s in SYMBOLS:
        for x in LETTERS:
            add(f"{_code(s)}_lo_{x}", "cp_sym", s, f"{{s}}  {s}", f" {x}", -1)
            add(f"{_code(s)}_lo_{x}_dm1", "cp_sym_m1", s, f"{{s}}  {s}", f" {x}", -2)
            add(f"{_code(s)}_up_{x.upper()}", "cp_sym_upper", s, f"{{s}}  {s}", f" {x.upper()}", -1)
    for x in LETTERS:
        for d in "0123456789":
            add(f"dig_{d}_{x}", "digit_trigger", d, f"{{s}}  {d}", f" {x}", -1)
        add(f"dot_nospace_{x}", "dot_prefix", ".", "{s}.", f"  {x}", -1)
    for s in ALT_SYMBOLS:
        for x in LETTERS[:10]:
            add(f"alt_{_code(s)}_{x}", "alt_space", s, f"{{s}}  {s}", f" {x}", -1)
    for s, prep, name in PAIRS:
        add(f"sp_{name}_sym_only", "sym_only", s, f"{{s}}  {s}", "", -1)
        add(f"sp_{name}_prep_only", "prep_only", s, f"{{s}}  {s} {prep}", "", -1)
        for x in LETTERS:
            add(f"sp_{name}_{x}", "prep_letter", s, f"{{s}}  {s} {prep}", f" {x}", -1)
    for s in INFIX_SYMBOLS:
        add(f"infix_p{{i}}_{_code(s)}_only", "infix_only", s, "{p} ", f"{s} {{q}}", 0, True)
        for x in LETTERS:
            add(f"infix_p{{i}}_{_code(s)}_{x}", "infix_letter", s, "{p} ", f"{s} {{q}} {x}", 0, True)
    for s, prep in zip(WIDE_SYMBOLS, WIDE_PREPOSITIONS):
        for x in LETTERS:
            add(f"iv2_t1_{_code(s)}_{x}", "iv2_sym", s, "{w}  ", f"{s}  {{r}} {x}", 0)
            add(f"iv2_t2_{_code(s)}_{prep}_{x}", "iv2_prep", s, f"{{w}}  {s} {prep}", f"  {{r}} {x}", -1)
        for x in LETTERS[:10].upper() if s in UPPER_SYMBOLS else "":
            add(f"iv2_t3_{_code(s)}_{x}", "iv2_upper", s, "{w}  ", f"{s}  {{r}} {x}", 0)
    for s in DENSE_SYMBOLS:
        for x in LETTERS:
            add(f"dense_t1_{_code(s)}_{x}", "dense_sym", s, "{w}", f"{s}  {{r}} {x}", 0)
            for prep in DENSE_PREPOSITIONS:
                add(f"dense_t2_{_code(s)}_{prep}_{x}", "dense_prep", s, f"{{w}} {s}{prep}", f"  {{r}} {x}", -1)
    return spark.createDataFrame(rows, TEMPLATE)


def trigger_probes(seeds: DataFrame, spark: SparkSession) -> DataFrame:
    """(seed_id, label, variant, symbol, query, cp) of rows (seed_id, seed). Probes inside a seed need two words."""
    df = seeds.select("seed_id", X.norm("seed").alias("s"), X.words("seed").alias("_w"))
    gaps = F.when(F.size("_w") > 1, F.sequence(F.lit(1), F.size("_w") - 1)).otherwise(F.array(F.lit(1)))
    join = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    df = df.withColumn("i", F.explode(gaps)).withColumns({"p": join(F.lit(1), F.col("i")), "q": join(F.col("i") + 1, F.size("_w")), "w": F.get("_w", F.lit(0)), "r": join(F.lit(2), F.size("_w"))})
    wide = df.crossJoin(F.broadcast(trigger_templates(spark)))
    inside = F.col("lead").rlike(r"\{[pw]\}")
    wide = wide.where((F.col("gap") | (F.col("i") == 1)) & ((F.size("_w") > 1) | (F.col("s").isNotNull() & ~inside)))

    def filled(column: str):
        out = F.col(column)
        for name in ("s", "p", "q", "w", "r"):
            out = F.replace(out, F.lit(f"{{{name}}}"), F.col(name))
        return out

    lead = filled("lead")
    label = F.replace("label", F.lit("{i}"), F.col("i").cast("string"))
    return wide.select("seed_id", label.alias("label"), "variant", "symbol", F.concat(lead, filled("rest")).alias("query"), (F.length(lead) + F.col("delta")).cast("int").alias("cp"))


def seed_variants_exp(seeds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seed_id, label, variant) of rows (seed_id, seed) with a noun: its first letter doubled, its first look-alike letter and that of the word
    beside it in Latin, other endings, and the seed itself for each experiment. Forms equal to the seed's are left out.

    The noun is the first word whose first parse is one, else the first that may be one.
    """
    kinds = lexicon.where("pos = 'NOUN'").groupBy("word").agg(F.min("rank").alias("_rank"))
    words = seeds.select("seed_id", F.posexplode(X.words("seed")).alias("p", "word")).join(kinds, "word")
    noun = words.groupBy("seed_id").agg(F.min(F.struct((F.col("_rank") > 0).alias("late"), "p")).alias("_n")).select("seed_id", F.col("_n.p").alias("_at"))
    df = seeds.select("seed_id", X.norm("seed").alias("_s"), X.words("seed").alias("_w")).join(noun, "seed_id")
    letters = "".join(LOOK_ALIKE)

    def latin(w: str) -> str:
        first = f"regexp_instr({w}, '[{letters}{letters.upper()}]')"
        swapped = f"translate(substring({w}, {first}, 1), '{letters}{letters.upper()}', '{''.join(LOOK_ALIKE.values())}{''.join(LOOK_ALIKE.values()).upper()}')"
        return f"if({first} > 0, concat(substring({w}, 1, {first} - 1), {swapped}, substring({w}, {first} + 1, length({w}))), null)"

    noun_word, other = "_w[_at]", "get(_w, if(_at = 0, 1, 0))"
    rows = [("typo_w1", "_at", f"concat(substring({noun_word}, 1, 1), {noun_word})"), ("cyr2lat_w1", "_at", latin(noun_word))]
    rows.append(("cyr2lat_w2", "if(_at = 0, 1, 0)", f"if({other} rlike '^[а-яёА-ЯЁ]{{3,}}$', {latin(other)}, null)"))
    rows += [(f"brute_{e}", "_at", f"concat(substring({noun_word}, 1, length({noun_word}) - 1), '{e}')") for e in BRUTE_ENDINGS]
    stem = f"coalesce(nullif(regexp_replace({noun_word}, '[{VOWELS}]+$', ''), ''), {noun_word})"
    rows += [(f"sep_{e}", "_at", f"concat({stem}, '{e}')") for e in SEP_ENDINGS]
    rows += [(name, "-1", "_s") for name in EXPERIMENTS]
    made = F.expr("array(" + ", ".join(f"named_struct('label', '{n}', 'at', {at}, 'word', {w})" for n, at, w in rows) + ")")
    each = df.select("seed_id", "_s", "_w", F.explode(made).alias("m")).where("m.word is not null")
    variant = F.expr("if(m.at < 0, _s, array_join(transform(_w, (x, i) -> if(i = m.at, m.word, x)), ' '))")
    out = each.select("seed_id", "m.label", variant.alias("variant"), (F.col("m.at") < 0).alias("_same"), "_s")
    return out.where("_same or variant <> _s").select("seed_id", "label", "variant")


def sep_probes(variants: DataFrame, spark: SparkSession) -> DataFrame:
    """(seed_id, label, variant, query, cp): each letter behind a variant with another ending, alone and before each suffix; the cursor right after the variant."""
    suffixes = ["", *(v.removesuffix(" *") for k in "BCD" for v in E.SUFFIXES[k])]
    table = F.broadcast(spark.createDataFrame([(f"  {x} {v}".rstrip(),) for x in LETTERS for v in suffixes], "tail string"))
    some = variants.where("label like 'sep!_%' escape '!'")
    return some.crossJoin(table).select("seed_id", "label", "variant", F.concat("variant", "tail").alias("query"), F.length("variant").alias("cp"))


def expand_morph(seeds: DataFrame, variants: DataFrame, spark: SparkSession, methods: tuple[str, ...] = METHODS, region: str = "all", letters: bool = True) -> DataFrame:
    """(seed_id, label, variant, query, cp) of the chosen methods. variants: (seed_id, label, variant) of seed_variants_exp, and case forms for morph.

    Suffixes and letters are put behind the variants as behind any seed, without those of priority 0. The experiments move the cursor; one
    doubles the blank behind the first star.
    """
    kind = F.when(F.col("label").isin(*EXPERIMENTS) | F.col("label").isin("typo_w1", "cyr2lat_w1", "cyr2lat_w2"), "exp").when(F.col("label").startswith("brute_"), "brute").when(F.col("label").startswith("sep_"), "sep").otherwise("morph")
    chosen = variants.withColumn("_kind", kind).where(F.col("_kind").isin(*methods) & (F.col("_kind") != "sep")).select("seed_id", "label", F.col("variant").alias("seed"))
    analyzed = E.analyze_seeds(chosen)
    probes = E.expand_suffix(analyzed, spark, region)
    probes = probes.unionByName(E.expand_letters(analyzed, spark)) if letters else probes
    probes = E.block_self_match(E.probe_priority(probes)).where("priority > 0")
    forced = F.create_map(*(F.lit(x) for pair in EXPERIMENTS.items() for x in pair))
    doubled = F.regexp_replace("query", r"^([^*]*\*) ", "$1  ")
    query = F.when(F.col("label") == "double_space", doubled).otherwise(F.col("query"))
    out = probes.select("seed_id", "label", F.col("seed").alias("variant"), query.alias("query"), F.coalesce(F.element_at(forced, F.col("label")), "cp").alias("cp"))
    if "sep" in methods:
        out = out.unionByName(sep_probes(variants, spark))
    if "triggers" in methods:
        own = trigger_probes(seeds, spark).join(seeds.select("seed_id", X.norm("seed").alias("_s")), "seed_id")
        out = out.unionByName(own.select("seed_id", F.lit("triggers").alias("label"), F.col("_s").alias("variant"), "query", "cp"))
    return out


#: Endings of nouns that come from verbs, with the letters that have to be left and the verbs' endings; any other noun of five letters or more may have one.
DEVERBAL = (
    ("ка", 3, ("ить", "ять", "лять", "ать", "ивать")), ("ция", 3, ("цировать", "ировать", "овать")), ("зия", 3, ("цировать", "ировать", "овать")),
    ("ение", 3, ("ить", "ать", "ять", "ивать")), ("ание", 3, ("ить", "ать", "ять", "ивать")), ("ние", 3, ("ить", "ать", "ять")), ("тие", 2, ("ять", "ать")), ("мент", 0, ()),
)
ANY_VERB, LEAST_NOUN, LEAST_VERB_SCORE = "ировать", 0.3, 0.9


def service_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word) of distinct words (word): nouns of an action, those whose lemma is a transitive verb's, too, or that end as nouns from verbs do where
    such a verb stands in the lexicon for sure and is transitive. lexicon: (word, rank, lemma, pos, score, grammemes)."""
    distinct = words.select("word").distinct()
    noun = lexicon.where((F.col("rank") == 0) & (F.col("pos") == "NOUN") & (F.coalesce("score", F.lit(1.0)) >= LEAST_NOUN) & (F.length("lemma") >= 4)).groupBy("word").agg(F.min("lemma").alias("lemma"))
    verbs = lexicon.where(F.col("pos").isin("VERB", "INFN") & F.array_contains("grammemes", "tran"))
    known = distinct.join(noun, "word")
    own = known.join(verbs.select("lemma").distinct(), "lemma", "left_semi").select("word")
    lemma = F.col("lemma")
    tried = F.when(F.length("lemma") >= 5, F.array(F.concat(lemma, F.lit(ANY_VERB)))).otherwise(F.array().cast("array<string>"))
    for ending, left, verb_endings in reversed(DEVERBAL):
        stem = F.expr(f"substring(lemma, 1, length(lemma) - {len(ending)})")
        made = F.array(*(F.concat(stem, F.lit(v)) for v in verb_endings)) if verb_endings else F.array().cast("array<string>")
        tried = F.when(F.endswith(lemma, F.lit(ending)) & (F.length("lemma") > 4 if ending == "ка" else F.lit(True)), F.when(F.length("lemma") - len(ending) >= left, made).otherwise(F.array().cast("array<string>"))).otherwise(tried)
    sure = verbs.where(F.coalesce("score", F.lit(1.0)) >= LEAST_VERB_SCORE).select(F.col("word").alias("verb")).distinct()
    derived = known.select("word", F.explode(tried).alias("verb")).join(sure, "verb", "left_semi").select("word")
    return own.unionByName(derived).distinct()
