"""Tails: what a keyword has beyond its seed. Null: the seed was not found; empty: the keyword is the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.functions import text as X
from seedsift.operators import grammar, morphology

#: Prepositions that lead over to a seed.
PREPOSITIONS = (
    "в", "во", "на", "по", "для", "с", "со", "к", "ко", "от", "до", "из", "у", "о", "об", "за", "под", "над", "при", "без", "через", "между", "перед", "про", "после",
    "около", "вместо", "кроме",
)


def with_lemmas(df: DataFrame, source: str, target: str, lexicon: DataFrame | None) -> DataFrame:
    """Adds the first lemma of each word of an array column; unknown words, and all without a lexicon, stand for themselves.

    Distinct arrays are looked up once, so a frequent seed or tail costs no more than a rare one.
    """
    if lexicon is None:
        return df.withColumn(target, F.col(source))
    first = lexicon.where("rank = 0").select("word", "lemma")
    tokens = df.select(source).distinct().select(source, F.posexplode(source).alias("_p", "word"))
    found = tokens.join(first, "word", "left").groupBy(source)
    pairs = F.array_sort(F.collect_list(F.struct("_p", F.coalesce("lemma", "word").alias("l"))))
    looked = found.agg(F.transform(pairs, lambda x: x["l"]).alias(target))
    return df.join(looked, source, "left").withColumn(target, F.coalesce(target, source))


def exact(q: Column, s: Column, prepositions: tuple[str, ...] = ()) -> Column:
    """Text around the first place where the seed ends at a word's end; prepositions at the end of the left part go."""
    at = F.regexp_instr(q, F.concat(F.lit("\\Q"), s, F.lit("\\E(?![\\p{L}\\p{Nd}])")))
    before = X.words(F.substring(q, F.lit(1), F.greatest(at - 1, F.lit(0))))
    if prepositions:
        last = F.aggregate(
            F.transform(before, lambda w, i: F.when(~w.isin(*prepositions), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
        )
        before = F.slice(before, F.lit(1), last)
    after = F.trim(F.substring(q, at + F.length(s), F.length(q)))
    joined = F.trim(F.concat_ws(" ", F.array_join(before, " "), after))
    return F.when((F.length(s) > 0) & (at > 0), joined)


def ordered(kw: str, seed: str, kl: str = None, sl: str = None) -> Column:
    """The words left over when the seed's words are found in their order, by word or lemma."""
    kl, sl = kl or kw, sl or seed
    step = f"""(acc, x) -> if(acc.i < size({seed}) and (x.w = {seed}[acc.i] or x.l = {sl}[acc.i]),
        named_struct('i', acc.i + 1, 'rest', acc.rest), named_struct('i', acc.i, 'rest', concat(acc.rest, array(x.w))))"""
    state = F.expr(f"aggregate(zip_with({kw}, {kl}, (w, l) -> named_struct('w', w, 'l', l)), named_struct('i', 0, 'rest', cast(array() as array<string>)), {step})")
    return F.when((F.size(seed) > 0) & (state["i"] == F.size(seed)), F.array_join(state["rest"], " "))


def unordered(kw: str, seed: str, kl: str = None, sl: str = None) -> Column:
    """The words left over when each of the seed's lemmas is found once, in any order."""
    kl, sl = kl or kw, sl or seed
    cut = "concat(slice(acc.open, 1, array_position(acc.open, x.l) - 1), slice(acc.open, array_position(acc.open, x.l) + 1, size(acc.open)))"
    step = f"""(acc, x) -> if(array_contains(acc.open, x.l),
        named_struct('open', {cut}, 'rest', acc.rest), named_struct('open', acc.open, 'rest', concat(acc.rest, array(x.w))))"""
    state = F.expr(f"aggregate(zip_with({kw}, {kl}, (w, l) -> named_struct('w', w, 'l', l)), named_struct('open', {sl}, 'rest', cast(array() as array<string>)), {step})")
    return F.when((F.size(seed) > 0) & (F.size(state["open"]) == 0), F.array_join(state["rest"], " "))


def with_lemma_sets(df: DataFrame, source: str, target: str, lexicon: DataFrame) -> DataFrame:
    """Adds, for each word of an array column, the lemmas of its parses that score nearly as high as the best one; unknown words stand for themselves."""
    sets = morphology.top_lemmas(lexicon) if "score" in lexicon.columns else lexicon.where("rank = 0").select("word", F.array("lemma").alias("lemmas"))
    tokens = df.select(source).distinct().select(source, F.posexplode(source).alias("_p", "word"))
    pairs = F.array_sort(F.collect_list(F.struct("_p", F.coalesce("lemmas", F.array("word")).alias("l"))))
    looked = tokens.join(sets, "word", "left").groupBy(source).agg(F.transform(pairs, lambda x: x["l"]).alias(target))
    return df.join(looked, source, "left").withColumn(target, F.coalesce(target, F.transform(source, lambda w: F.array(w))))


# Letters in Latin; Latin spellings of one sound, in this order.
LATIN_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "yu",
    "я": "ya",
}
ONE_SOUND = (("ph", "f"), ("th", "t"), ("ck", "k"), ("qu", "kv"), ("wh", "v"), ("x", "ks"), ("w", "v"), ("q", "k"), ("y", "i"))
#: Least similarity by edits and least share of common pairs of letters.
ALIKE, COMMON_PAIRS = 0.5, 0.2


def sound(c: str) -> str:
    """SQL for a word's sound in Latin letters."""
    single = {k: v for k, v in LATIN_LETTERS.items() if len(v) == 1}
    out = f"translate({c}, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in (*((k, v) for k, v in LATIN_LETTERS.items() if len(v) != 1), *ONE_SOUND):
        out = f"replace({out}, '{k}', '{v}')"
    return f"regexp_replace({out}, '[^a-z]', '')"


def cross_script(a: str, b: str) -> str:
    """SQL: whether two words, one Cyrillic and one Latin, sound alike: by edits and by common pairs of letters."""
    cyr, lat = (lambda w: f"{w} rlike '[\u0400-\u04ff]'"), (lambda w: f"{w} rlike '[a-z]'")
    pairs = lambda s: f"if(length({s}) < 2, array(), transform(sequence(1, length({s}) - 1), i -> substring({s}, i, 2)))"
    x, y = sound(a), sound(b)
    alike = f"length({x}) > 0 and length({y}) > 0 and 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) >= {ALIKE}"
    common = f"size(array_intersect({pairs(x)}, {pairs(y)})) >= {COMMON_PAIRS} * size(array_union({pairs(x)}, {pairs(y)})) and size(array_union({pairs(x)}, {pairs(y)})) > 0"
    return f"((({cyr(a)}) and ({lat(b)}) or ({lat(a)}) and ({cyr(b)})) and {alike} and {common})"


def _match(kw: str, seed: str, kl: str, sl: str, content: str | None) -> str:
    """SQL: which word of the keyword, by number, each word of the seed takes in turn: by word or lemma first, then by sound; -1 for none."""
    step = lambda fits: f"""(acc, s) -> if(acc[s] >= 0, acc, transform(acc, (v, i) -> if(i = s,
        coalesce(get(filter(sequence(0, size({kw}) - 1), q -> not array_contains(acc, q) and ({fits})), 0), -1), v)))"""  # noqa: E731
    rows = f"if(size({seed}) = 0, array(), sequence(0, size({seed}) - 1))"
    first = f"aggregate({rows}, transform({seed}, x -> -1), {step(f'{kw}[q] = {seed}[s] or arrays_overlap({kl}[q], {sl}[s])')})"
    if content is None:
        return first
    return f"aggregate({rows}, {first}, {step(f'{content} and ' + cross_script(f'{seed}[s]', f'{kw}[q]'))})"


def matched(kw: str, seed: str, kl: str, sl: str) -> str:
    """SQL: which word of the keyword, by number, each word of the seed takes in turn by word or lemma; -1 for none."""
    return _match(kw, seed, kl, sl, None)


def left_over(kw: str, taken: str) -> str:
    """SQL: the keyword's words that none took."""
    return f"array_join(filter(transform({kw}, (w, i) -> if(array_contains({taken}, i), null, w)), w -> w is not null), ' ')"


def by_sets(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds _by_sets: the tail by sets of lemmas and by sound: in order, in any order, or without one word of the seed that carries no content.

    In order, a word of the seed that the keyword has nowhere may be matched by sound, and stray letters between
    matched words go. A seed of three words or more may miss one that is no number and has no content part of
    speech; if that is a preposition, one that opens the tail goes with it.
    """
    df = with_lemma_sets(with_lemma_sets(df, "_qw", "_qs", lexicon), "_sw", "_ss", lexicon)
    df = grammar.with_parses(grammar.with_parses(df, "_sw", "_sp", lexicon), "_qw", "_qp", lexicon)
    function = "coalesce(_sp[s].pos in ('PREP', 'CONJ', 'PRCL', 'INTJ'), false)"
    present = "exists(sequence(0, size(_qw) - 1), j -> _qw[j] = _sw[s] or arrays_overlap(_qs[j], _ss[s]))"
    fits = f"(_qw[q] = _sw[s] or arrays_overlap(_qs[q], _ss[s]) or (not {function} and not {present} and {cross_script('_sw[s]', '_qw[q]')}))"
    after = f"""aggregate(sequence(0, size(_sw) - 1), cast(array() as array<int>), (acc, s) -> if(size(acc) < s, acc, concat(acc,
        slice(filter(sequence(0, size(_qw) - 1), q -> q > coalesce(get(acc, size(acc) - 1), -1) and {fits}), 1, 1))))"""
    df = df.withColumn("_in_order", X.settled(F.expr(f"if(size(_sw) > 0 and size(_qw) > 0, {after}, null)")))
    stray = "length(w) = 1 and w rlike '\\\\p{L}' and i > _in_order[0] and i < _in_order[size(_in_order) - 1]"
    in_order = f"array_join(filter(transform(_qw, (w, i) -> if(array_contains(_in_order, i) or ({stray}), null, w)), w -> w is not null), ' ')"
    df = df.withColumn("_any_order", X.settled(F.expr(f"if(size(_sw) > 0 and size(_qw) > 0, {_match('_qw', '_sw', '_qs', '_ss', f'not {function}')}, null)")))
    # Each word of the seed that may be missing, and the places of the others.
    skippable = r"""filter(sequence(0, size(_sw) - 1), k -> not coalesce(_sp[k].pos in ('NOUN', 'VERB', 'ADJF', 'ADJS', 'INFN', 'PRTF', 'PRTS', 'NUMR', 'NUMB'), false)
        and not _sw[k] rlike '^\\p{Nd}+$' and (_sp[k].pos is not null or not _sw[k] rlike '[Ѐ-ӿ]'))"""
    df = df.withColumn("_missing", F.expr(f"if(size(_sw) >= 3 and size(_qw) > 0, get(filter({skippable}, k -> _any_order[k] < 0 and size(filter(_any_order, v -> v < 0)) = 1), 0), null)"))
    rest = "filter(transform(_qp, (p, i) -> if(array_contains(_any_order, i), null, p)), p -> p is not null)"
    opens = f"coalesce(_sp[_missing].pos = 'PREP' and get({rest}, 0).pos = 'PREP', false)"
    partial = f"array_join(transform(if({opens}, slice({rest}, 2, size({rest})), {rest}), p -> p.word), ' ')"
    tail = f"""case when size(_in_order) = size(_sw) then {in_order} when forall(_any_order, v -> v >= 0) then {left_over('_qw', '_any_order')}
        when _missing is not null and size(filter(_any_order, v -> v >= 0)) >= 2 then {partial} end"""
    return df.withColumn("_by_sets", X.settled(F.expr(tail))).drop("_qs", "_ss", "_sp", "_qp", "_in_order", "_any_order", "_missing")


def extract_tail(kw: DataFrame, lexicon: DataFrame | None = None, prepositions: tuple[str, ...] = PREPOSITIONS, places: DataFrame | None = None) -> DataFrame:
    """Adds tail: exact place first, then the seed's words in order, then in any order; with a lexicon by sets of lemmas, by sound and without an empty word too.

    With places (seedsift.operators.geo_tails.place_kinds) keywords that name a place of the target are cut by it before all.
    """
    from seedsift.operators.geo_tails import geo_first_tail

    own = kw.columns
    kw = kw.withColumn("geo_tail", F.lit(None).cast("string")) if places is None else geo_first_tail(kw, places, lexicon)
    df = kw.withColumn("_q", X.squeeze("keyword")).withColumn("_s", X.squeeze("seed"))
    df = df.withColumn("_qw", X.words("_q")).withColumn("_sw", X.words("_s"))
    if lexicon is None:
        loose = F.coalesce(ordered("_qw", "_sw"), unordered("_qw", "_sw"))
    else:
        df, loose = by_sets(df, lexicon), F.col("_by_sets")
    tail = F.coalesce("geo_tail", exact(F.col("_q"), F.col("_s"), prepositions), loose)
    return df.withColumn("tail", X.settled(F.when(F.col("_q") == F.col("_s"), F.lit("")).otherwise(tail))).select(*own, "tail")


def side() -> Column:
    """Where the word of a one-word tail stands in its keyword: infix between words of the seed, else pre or post the seed's first word, else none."""
    q, s, t = X.words("keyword"), X.words("seed"), X.words("tail")
    at, first = F.array_position(q, F.get(t, F.lit(0))), F.array_position(q, F.get(s, F.lit(0)))
    places = F.filter(F.transform(q, lambda w, i: F.when(F.array_contains(s, w), i + 1)), lambda i: i.isNotNull())
    between = (F.size(places) > 1) & (at > F.array_min(places)) & (at < F.array_max(places))
    known = (F.size(t) == 1) & (at > 0)
    return F.when(known & between, "infix").when(known & (first > 0) & (at < first), "pre").when(known & (first > 0) & (at > first), "post").otherwise("none")


def extract_payload(kw: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds payload: the keyword's word characters without the words whose lemma is one of the seed's."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)
    df = kw.withColumn("_qw", tokens("keyword")).withColumn("_sw", tokens("seed"))
    df = with_lemmas(with_lemmas(df, "_qw", "_ql", lexicon), "_sw", "_sl", lexicon)
    left = F.expr("filter(zip_with(_qw, _ql, (w, l) -> if(array_contains(_sl, l), null, w)), w -> w is not null)")
    return df.withColumn("payload", F.array_join(left, " ")).select(*kw.columns, "payload")
