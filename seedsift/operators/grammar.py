"""Detectors that need words' parses: terms of commerce, reputation and so on, and the grammar of a tail beside its seed.

A parse column (_tp of the tail's words, _sp of the seed's) holds for each word: word, the first parse's pos, lemma,
case, number, gender and marks (further grammemes), whether the lexicon knows it, and all parses in order. Without a
lexicon a word is its own lemma and nothing else is known of it; then only words and phrases as they stand can fire.

Empty tails fire nothing; words that the lexicon lacks have no part of speech.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, phrases, cases and parts of speech of the detectors.
COMMERCE_STRONG = (
    "цена", "стоимость", "прайс", "тариф", "расценка", "прейскурант", "скидка", "акция", "гарантия", "гарантийный", "бесплатно", "бесплатный",
    "платно", "платный", "рассрочка", "кредит", "предоплата", "аванс", "бу", "б/у", "ціна", "вартість", "знижка",
)
COMMERCE_WEAK = ("купить", "заказать", "оформить", "приобрести", "арендовать", "покупка", "заказ", "оплата", "оплатить", "доставка", "замовити", "купити")
COMMERCE_PHRASES = ("сколько стоит", "почём", "по цене", "недорого", "дёшево", "дешево", "дорого", "бюджетно")
COMMERCE_VERBS = ("купить", "заказать", "приобрести", "арендовать")
REPUTATION_LEMMAS = ("отзыв", "рейтинг", "обзор", "форум", "рекомендация", "опыт", "мнение", "оценка", "сравнение", "рекомендовать")
REPUTATION_PHRASES = ("топ ", "топ-", "лучший сервис", "хороший сервис", "кто лучше", "куда лучше", "куда обратиться", "стоит ли", "можно ли доверять")
LOCATION_LEMMAS = ("рядом", "поблизости", "ближайший", "недалеко")
LOCATION_PHRASES = (
    "рядом", "поблизости", "неподалёку", "неподалеку", "на дому", "с выездом", "выезд на дом", "ближайший", "ближайшая", "ближе всего", "в моём районе",
    "в моем районе", "мой район", "возле", "около", "недалеко", "на левом берегу", "на правом берегу", "центр города", "в центре", "район", "микрорайон", "улица",
)
TIME_LEMMAS = (
    "круглосуточно", "круглосуточный", "срочно", "срочный", "экстренно", "экстренный", "сегодня", "завтра", "сейчас", "быстро", "быстрый", "ночью", "ночной",
    "утром", "утренний", "выходные", "выходной", "праздник", "праздничный",
)
TIME_PHRASES = ("24/7", "24 часа", "без выходных", "в праздники", "на праздник", "на ночь", "на утро")
ACTION_PHRASES = (
    "своими руками", "самостоятельно", "самому", "в домашних условиях", "пошагово", "пошаговая", "поэтапно", "как разобрать", "как почистить", "как починить",
    "как заменить", "как собрать", "как отремонтировать",
)
ACTION_STRONG = ("инструкция", "руководство", "мануал", "видео", "видеоинструкция", "фото", "разборка", "сборка", "чистка", "замена", "диагностика", "профилактика", "обслуживание")
ACTION_PARTS = (
    "запчасть", "деталь", "комплектующие", "фильтр", "щётка", "щетка", "шланг", "мешок", "пылесборник", "мотор", "двигатель", "турбина", "аккумулятор", "курс",
    "обучение", "мастер-класс",
)
ACTION_VERBS = ("разобрать", "собрать", "почистить", "починить", "заменить", "отремонтировать", "восстановить", "промыть", "продуть", "смазать", "перемотать")
CONTACT_LEMMAS = ("телефон", "адрес", "контакт", "email", "почта", "сайт", "график", "расписание", "карта", "маршрут", "адреса", "пошта", "графік")
CONTACT_PHRASES = (
    "номер телефона", "адрес и телефон", "официальный сайт", "как добраться", "как доехать", "где находится", "на карте", "часы работы", "время работы",
    "режим работы", "офіційний сайт", "як дістатися", "де знаходиться", "години роботи",
)
INTERROGATIVES = (
    "что", "как", "почему", "зачем", "когда", "где", "куда", "откуда", "чем", "чего", "сколько", "какой", "какая", "какое", "какие",
    "що", "як", "чому", "навіщо", "коли", "де", "куди", "звідки", "скільки", "який", "яка", "яке", "які",
)
OPENING_QUESTIONS = ("как", "где", "куда", "откуда", "почему", "зачем", "когда", "сколько", "чем", "чего", "кто", "кого", "что")
VERB_QUESTIONS = ("когда", "сколько", "коли", "скільки")
BARE_QUESTIONS = ("зачем", "почему", "что", "как", "когда", "навіщо", "чому", "що", "як", "коли")
META_PHRASES = (
    "это что", "что означает", "что такое", "что это такое", "что это", "как называется", "что значит", "это что означает", "зачем нужен", "зачем нужна",
    "зачем нужно", "в чём смысл", "в чем смысл", "что даёт", "что дает", "чем отличается", "какая разница", "какие бывают", "что входит", "что включает",
    "что делать", "что нужно знать", "что нужно", "что важно", "что лучше", "как выбрать", "на что обратить", "на что смотреть", "що це", "що таке",
    "що означає", "що це таке", "навіщо", "для чого", "як називається", "чим відрізняється", "яка різниця", "які бувають", "що потрібно", "що важливо", "як обрати",
)
MODAL_QUESTIONS = ("стоит ли", "нужно ли", "можно ли")
COPULAS = ("есть", "быть", "бывает", "бывают", "бывать", "является", "являться", "имеется")
MODALS = ("можно", "нужно", "надо", "нельзя", "стоит", "следует")
MODAL_PHRASES = ("может быть", "должен быть", "не может быть", "не может", "не должен", "не будет")
PRODUCT_SUFFIXES = ("про", "макс", "мини", "плюс", "лайт", "ультра", "минус")
ELLIPSIS = ("или", "и", "либо", "чи")
KNOWN_SHORT = ("бу", "б", "шт", "уа", "юа", "рф", "сш", "ес", "хт", "гт", "се", "еу")
NAME_MARKS = ("Geox", "Sgtm", "Name", "Surn", "Fixd")
FUNCTION = ("PREP", "CONJ", "PRCL", "INTJ")
ADJECTIVES = ("ADJF", "ADJS", "PRTF", "PRTS")
CONTENT = ("NOUN", "ADJF", "ADJS", "ADVB", "INFN", "VERB", "COMP", "PRED", "NPRO")
GENITIVE, LOCATIVE = ("gent", "gen2"), ("loct", "loc2")
#: Cases that prepositions govern: of a circumstance, and in any use.
CIRCUMSTANCE = {
    "после": GENITIVE, "до": GENITIVE, "без": GENITIVE, "для": GENITIVE, "от": GENITIVE, "около": GENITIVE, "вместо": GENITIVE, "кроме": GENITIVE, "у": GENITIVE,
    "при": LOCATIVE, "по": ("datv",), "перед": ("ablt",), "с": ("ablt", "gent"), "за": ("ablt", "accs"), "под": ("ablt", "accs"), "между": ("ablt",), "через": ("accs",),
}
GOVERNED = {
    "после": GENITIVE, "до": GENITIVE, "без": GENITIVE, "для": GENITIVE, "от": GENITIVE, "из": GENITIVE, "у": GENITIVE, "около": GENITIVE, "вместо": GENITIVE,
    "кроме": GENITIVE, "при": LOCATIVE, "на": (*LOCATIVE, "accs"), "в": (*LOCATIVE, "accs"), "о": LOCATIVE, "по": ("datv",), "к": ("datv",),
}
COMPOUND = {"из за": GENITIVE, "из под": GENITIVE, "по над": ("ablt",), "по под": ("ablt",), "по за": ("ablt",)}
#: First words of seeds that ask for a way or a reason, and those that no price answers.
NO_PLACE = ("как", "почему", "зачем", "когда", "что", "кто", "чем", "чего", "какой", "какая", "какое", "какие")
NO_PRICE = (*NO_PLACE, "где", "куда", "откуда", "можно", "нужно", "стоит", "сколько")
#: What a recognised specification explains.
BY_SPEC = ("fragment", "short_garbage", "standalone_num", "broken_grammar")

_PARSE = "struct<pos:string,case:string,number:string,gender:string,score:double,marks:array<string>>"
WORD = f"struct<word:string,pos:string,lemma:string,case:string,number:string,gender:string,known:boolean,marks:array<string>,all:array<{_PARSE}>>"


def with_parses(df: DataFrame, source: str, target: str, lexicon: DataFrame | None) -> DataFrame:
    """Adds the parses of each word of an array column. Distinct arrays are looked up once."""
    if lexicon is None:
        bare = lambda w: F.struct(w.alias("word"), F.lit(None), w.alias("lemma"), *(F.lit(None) for _ in range(5)), F.array()).cast(WORD)
        return df.withColumn(target, F.transform(source, bare))
    optional = {"score": "double", "number": "string", "gender": "string", "case": "string", "pos": "string", "grammemes": "array<string>", "known": "boolean"}
    lex = lexicon.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in lexicon.columns})
    parse = F.struct("pos", "case", "number", "gender", "score", F.coalesce("grammemes", F.array().cast("array<string>")).alias("marks"))
    by_word = lex.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "lemma", F.coalesce("known", F.lit(True)).alias("known"), parse.alias("p")))).alias("_a"))
    tokens = df.select(source).distinct().select(source, F.posexplode(source).alias("_i", "word"))
    top = F.get("_a", F.lit(0))
    word = F.struct(
        F.col("word"), top["p"]["pos"].alias("pos"), F.coalesce(top["lemma"], "word").alias("lemma"), *(top["p"][c].alias(c) for c in ("case", "number", "gender")),
        F.coalesce(top["known"], F.lit(False)).alias("known"), F.coalesce(top["p"]["marks"], F.array().cast("array<string>")).alias("marks"),
        F.coalesce(F.transform("_a", lambda x: x["p"]), F.array().cast(f"array<{_PARSE}>")).alias("all"),
    ).cast(WORD)
    looked = tokens.join(by_word, "word", "left").groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", word.alias("w")))), lambda x: x["w"]).alias(target))
    return df.join(looked, source, "left").withColumn(target, F.coalesce(target, F.array().cast(f"array<{WORD}>")))


def _in(value: str, names: tuple[str, ...]) -> str:
    return f"coalesce({value} in ({', '.join(repr(x) for x in names)}), false)"


def _says(phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(tail, {p!r})" for p in phrases) + ")"


def _cases(word: str, table: dict[str, tuple[str, ...]]) -> str:
    return "element_at(map(" + ", ".join(f"{k!r}, array({', '.join(map(repr, v))})" for k, v in table.items()) + f"), {word})"


_N = "size(_tw)"
_ONE = f"{_N} = 1"
_FIRST, _SECOND, _LAST = "get(_tp, 0)", "get(_tp, 1)", f"get(_tp, {_N} - 1)"
_SEED_VERB = f"exists(_sp, s -> {_in('s.pos', ('INFN', 'VERB'))} and coalesce(s.known, false))"
_ASKS = f"({_in(_FIRST + '.word', OPENING_QUESTIONS)} or {_in(_SECOND + '.word', OPENING_QUESTIONS)})"
_DIGITS = r"rlike '^\\p{Nd}+$'"


def _service_seed() -> str:
    """A process and what it is done to: a noun, no preposition, a genitive."""
    first, second = "get(_sp, 0)", "get(_sp, 1)"
    return (
        f"(size(_sw) >= 2 and coalesce({first}.pos = 'NOUN', false) and {_in(first + '.case', ('nomn', 'accs'))} and not coalesce({second}.pos = 'PREP', false)"
        f" and exists(slice(_sp, 2, size(_sp)), s -> coalesce(s.pos = 'NOUN' and s.case = 'gent', false)))"
    )


def commerce() -> Column:
    """A price word or phrase; a weaker word beside another content word; alone an infinitive that buys or commits."""
    first = f"get(filter(_tp, p -> {_in('p.lemma', COMMERCE_STRONG + COMMERCE_WEAK)}), 0).lemma"
    content = f"size(filter(_tp, p -> not {_in('p.pos', (*FUNCTION, 'ADVB', 'PRED'))}))"
    lone = f"{_ONE} and coalesce({_FIRST}.pos = 'INFN', false) and if({_service_seed()}, coalesce(array_contains({_FIRST}.marks, 'perf'), false), {_in(_FIRST + '.lemma', COMMERCE_VERBS)})"
    return F.expr(f"{_says(COMMERCE_PHRASES)} or {_in(first, COMMERCE_STRONG)} or ({_in(first, COMMERCE_WEAK)} and {content} > 1) or ({lone})")


def _terms(phrases: tuple[str, ...], lemmas: tuple[str, ...]) -> Column:
    return F.expr(f"{_says(phrases)} or exists(_tp, p -> {_in('p.lemma', lemmas)})")


def action() -> Column:
    """The first word of the lists decides: verbs and parts need company, self-contained nouns only in the instrumental."""
    first = f"get(filter(_tp, p -> {_in('p.lemma', ACTION_VERBS + ACTION_STRONG + ACTION_PARTS)}), 0)"
    strong = f"{_in(first + '.lemma', ACTION_STRONG)} and not coalesce({_ONE} and {first}.case = 'ablt', false)"
    return F.expr(f"{_says(ACTION_PHRASES)} or ({_in(first + '.lemma', ACTION_VERBS + ACTION_PARTS)} and {_N} > 1) or ({strong})")


def time() -> Column:
    return F.expr(f"{_says(TIME_PHRASES)} or exists(_tp, p -> not {_in('p.pos', ADJECTIVES)} and ({_in('p.lemma', TIME_LEMMAS)} or {_in('p.word', TIME_LEMMAS)}))")


def _modifies(p: str) -> str:
    """Words that modify a verb: predicatives, comparatives, infinitives and adverbs of manner."""
    return f"({_in(p + '.pos', ('PRED', 'COMP', 'INFN'))} or coalesce({p}.pos = 'ADVB' and {p}.word rlike '[ое]$' and not exists({p}.all, a -> coalesce(a.pos = 'PRCL', false)), false))"


def _thing(p: str) -> str:
    return f"coalesce({p}.pos = 'NOUN' and array_contains({p}.marks, 'inan') and not exists({p}.all, a -> array_contains(a.marks, 'Geox')), false)"


def verb_modifier() -> Column:
    """Beside a verb in the seed: modifiers alone, or modifiers and the thing that they narrow down."""
    flags = f"transform(_tp, (p, i) -> {_modifies('p')} or (i > 0 and {_in('p.word', ('ли', 'же', 'ведь'))}))"
    lead = f"if(array_position({flags}, false) = 0, {_N}, cast(array_position({flags}, false) as int) - 1)"
    rest = f"slice(_tp, {lead} + 1, {_N})"
    nouns = f"if(coalesce(get({rest}, 0).pos = 'PREP', false) and size({rest}) > 1, slice({rest}, 2, {_N}), {rest})"
    target = f"get(filter({nouns}, p -> not {_in('p.pos', ADJECTIVES)}), 0)"
    last = f"get({nouns}, size({nouns}) - 1)"
    noun_like = f"{target} is null and coalesce({last}.pos in ('ADJF', 'PRTF') and {last}.gender = 'neut' and {last}.case in ('nomn', 'accs'), false)"
    longer = f"{_N} between 3 and 5 and {lead} >= 1 and {lead} < {_N} and ({_thing(target)} or ({noun_like}))"
    two = f"{_N} = 2 and {_thing(_SECOND)} and ({_modifies(_FIRST)} or {_in(_FIRST + '.pos', ('ADJF', 'PRTF'))})"
    return F.expr(f"{_SEED_VERB} and (({_ONE} and {_in(_FIRST + '.word', VERB_QUESTIONS)}) or ({_N} <= 2 and forall(_tp, p -> {_modifies('p')})) or ({two}) or ({longer}))")


def conjunctive() -> Column:
    content = f"p -> exists(p.all, a -> {_in('a.pos', CONTENT)})"
    return F.expr(
        f"{_N} >= 2 and ((coalesce({_FIRST}.pos = 'CONJ', false) and exists(slice(_tp, 2, {_N}), {content}))"
        f" or ({_in(_LAST + '.pos', ('CONJ', 'PREP'))} and exists(slice(_tp, 1, {_N} - 1), {content})))"
    )


def prep_modifier() -> Column:
    skipped = f"{_in('p.pos', (*ADJECTIVES, 'NUMR', 'PRCL', 'PREP'))} or p.word {_DIGITS}"
    noun = f"get(filter(slice(_tp, 2, {_N}), p -> not ({skipped})), 0)"
    return F.expr(f"coalesce({_FIRST}.pos = 'PREP' and {noun}.pos = 'NOUN' and exists({noun}.all, a -> array_contains({_cases(_FIRST + '.word', CIRCUMSTANCE)}, a.case)), false)")


def info_intent() -> Column:
    """A question word, a definition, or something that does not work."""
    asks = f"exists(_tp, p -> {_in('p.word', INTERROGATIVES)} or {_in('p.lemma', INTERROGATIVES)} or coalesce(array_contains(p.marks, 'Ques'), false))"
    fails = f"{_N} >= 2 and exists(sequence(1, greatest({_N} - 1, 1)), i -> _tw[i - 1] = 'не' and {_in('get(_tp, i).pos', ('VERB', 'INFN'))})"
    return F.expr(f"{asks} or {_LAST}.word = 'это' or contains(concat(' ', tail, ' '), ' что это ') or ({fails})")


def _agreeing(side: str) -> Column:
    """One adjective on a side of the seed's first word that agrees with a noun of the seed."""
    sides = f"side in ('{side}', 'infix')" if side == "post" else f"side = '{side}'"
    agrees = "s.pos = 'NOUN' and a.number <=> s.number and a.case <=> s.case and (not a.number <=> 'sing' or a.gender <=> s.gender)"
    return F.expr(f"{_ONE} and {sides} and exists({_FIRST}.all, a -> {_in('a.pos', ADJECTIVES)} and coalesce(a.score, 1) >= 0.1 and exists(_sp, s -> coalesce({agrees}, false)))")


def fragment() -> Column:
    """A tail that breaks off: an ending function word, a copula or modal alone, a verb without a subject."""
    prev = f"get(_tp, {_N} - 2)"
    word = f"{_LAST}.word"
    excused = [
        _in(word, PRODUCT_SUFFIXES), f"({_SEED_VERB} and {_in(word, VERB_QUESTIONS)})", f"({_LAST}.pos = 'PREP' and {_in(prev + '.word', ELLIPSIS)})",
        f"(length({word}) = 1 and {word} rlike '\\\\p{{L}}' and coalesce({prev}.pos = 'NOUN', false))", f"({_ONE} and {_LAST}.pos = 'PREP' and coalesce(side = 'infix', false))", f"({word} = 'ин' and {_N} >= 2)",
    ]
    verb = f"coalesce({_LAST}.pos = 'VERB' and not array_contains({_LAST}.marks, 'impr'), false)"
    person = f"coalesce(arrays_overlap({_LAST}.marks, array('1per', '2per')), false)"
    subject = f"exists(slice(_tp, 1, greatest({_N} - 1, 0)), p -> coalesce(p.pos = 'NOUN' and p.case = 'nomn', false))"
    rules = [
        f"({_in(_LAST + '.pos', ('PREP', 'CONJ', 'PRCL'))} and not ({' or '.join(excused)}))",
        f"({_ONE} and {_in(word, COPULAS + MODALS)})", f"({word} = 'это' and {_N} <= 2)", f"({_ONE} and {verb} and not {person})", f"({_N} >= 2 and {verb} and not {_ASKS} and not {subject})",
        f"({_N} >= 2 and coalesce({_FIRST}.pos = 'CONJ', false) and not {_ASKS})", _in("tail", MODAL_PHRASES), f"({_ONE} and coalesce({_LAST}.pos = 'COMP', false))",
    ]
    return F.expr(" or ".join(rules))


def meta() -> Column:
    """A question about the notion itself."""
    modal = " or ".join(
        f"(contains(tail, '{p}') and not {_SEED_VERB} and not exists(_tp, x -> x.word = regexp_extract(tail, '{p} *([^ ]*)', 1) and {_in('x.pos', ('INFN', 'VERB'))}))" for p in MODAL_QUESTIONS
    )
    bare = f"({_ONE} and {_in('tail', BARE_QUESTIONS)} and not ({_SEED_VERB} and {_in('tail', VERB_QUESTIONS)}))"
    why = f"({_N} = 2 and {_in(_FIRST + '.word', ('почему', 'зачем'))} and {_in(_SECOND + '.pos', ('ADVB', 'ADJF', 'ADJS', 'PRED'))})"
    return F.expr(f"{_says(META_PHRASES)} or {modal} or {bare} or {why}")


def dangling() -> Column:
    """Adjectives without a noun that are no place and share no case with the seed's last noun."""
    name = f"not coalesce(p.known, false) and exists(p.all, a -> coalesce(a.pos = 'NOUN' and arrays_overlap(a.marks, array({', '.join(map(repr, NAME_MARKS))})), false))"
    adjectives = f"filter(_tp, p -> {_in('p.pos', ('ADJF', 'ADJS'))} and not ({name}))"
    noun = f"exists(_tp, p -> coalesce(p.pos = 'NOUN', false) or ({_in('p.pos', ('ADJF', 'ADJS'))} and {name}))"
    seed = "get(reverse(filter(_sp, s -> coalesce(s.pos = 'NOUN', false))), 0)"
    fits = f"exists({adjectives}, p -> exists(p.all, a -> a.case is not null and array_contains(transform({seed}.all, s -> s.case), a.case)))"
    return F.expr(f"{_N} <= 2 and size({adjectives}) > 0 and not {noun} and not has_geo and not has_foreign and {seed} is not null and not coalesce({fits}, false)")


def broken_grammar() -> Column:
    """A preposition beside a case that it does not govern; search habits and unknown words are let pass."""
    third = "get(_tp, 2)"
    pair = f"concat({_FIRST}.word, ' ', {_SECOND}.word)"
    compound = f"not {third}.word {_DIGITS} and {third}.pos is not null and not exists({third}.all, a -> coalesce(array_contains({_cases(pair, COMPOUND)}, a.case), false))"
    s = _SECOND
    excused = [
        f"{s}.word {_DIGITS}", f"{s}.pos is null", f"not exists({s}.all, a -> a.case is not null)", f"length({s}.word) = 1", f"{s}.pos = 'CONJ'",
        f"({_N} >= 3 and {s}.pos = 'NOUN' and {s}.case <=> 'nomn' and coalesce({third}.pos = 'NOUN' and {third}.case in ('gent', 'gen2'), false))",
        f"({_N} = 2 and {s}.pos = 'NOUN' and {s}.case <=> 'nomn' and (length({s}.word) >= 5 or coalesce(arrays_overlap({s}.marks, array('inan', 'anim')), false)))",
        f"exists({s}.all, a -> coalesce(array_contains({_cases(_FIRST + '.word', GOVERNED)}, a.case), false))",
    ]
    single = f"not ({' or '.join(excused)})"
    return F.expr(f"{_N} >= 2 and {_in(_FIRST + '.word', tuple(GOVERNED))} and if({_N} >= 3 and {_in(pair, tuple(COMPOUND))}, {compound}, {single})")


def number_hijack() -> Column:
    """A lone genitive that counts by the number at the seed's end."""
    n = "cast(get(_sw, size(_sw) - 1) as decimal(38, 0))"
    asked = f"case when {n} % 100 between 11 and 14 then 'plur' when {n} % 10 = 1 then null when {n} % 10 between 2 and 4 then 'sing' else 'plur' end"
    noun = f"{_FIRST}.pos = 'NOUN' and {_FIRST}.case = 'gent' and {_FIRST}.known and not array_contains({_FIRST}.marks, 'Abbr')"
    return F.expr(f"{_ONE} and coalesce(get(_sw, size(_sw) - 1) {_DIGITS} and {noun} and {_FIRST}.number = {asked}, false)")


def short_garbage() -> Column:
    """One token of one or two characters that is no number, Latin abbreviation or known word."""
    w = f"{_FIRST}.word"
    unknown = f"coalesce({_FIRST}.known, true) = false or coalesce({_FIRST}.pos = 'INTJ', false)"
    return F.expr(f"{_ONE} and length({w}) <= 2 and not {w} {_DIGITS} and not {w} rlike '^[a-zA-Z]+$' and not {_in(w, KNOWN_SHORT)} and ({unknown})")


def orphan_genitive() -> Column:
    """A lone genitive after a seed that ends in one, unless that one is governed."""
    gent = "coalesce(s.pos = 'NOUN' and s.case = 'gent', false)"
    last = f"array_max(transform(_sp, (s, i) -> if({gent}, i, -1)))"
    governor = f"get(_sp, greatest({last} - 1, 0))"
    governed = f"{last} > 0 and coalesce({governor}.pos in ('VERB', 'INFN') or ({governor}.pos = 'NOUN' and {governor}.case = 'nomn'), false)"
    noun = "get(reverse(filter(_sp, s -> coalesce(s.pos = 'NOUN', false))), 0)"
    return F.expr(f"{_ONE} and coalesce({_FIRST}.pos = 'NOUN' and {_FIRST}.case = 'gent', false) and not ({governed}) and coalesce({noun}.case = 'gent', false)")


def single_infinitive() -> Column:
    """A lone infinitive beside a product without a verb."""
    return F.expr(f"{_ONE} and coalesce({_FIRST}.pos = 'INFN', false) and not exists(_sp, s -> {_in('s.pos', ('INFN', 'VERB'))}) and not {_service_seed()} and not {_in(_FIRST + '.lemma', COMMERCE_VERBS)}")


POSITIVE = {
    "commerce": commerce, "reputation": lambda: _terms(REPUTATION_PHRASES, REPUTATION_LEMMAS), "location": lambda: _terms(LOCATION_PHRASES, LOCATION_LEMMAS),
    "action": action, "time": time, "contacts": lambda: _terms(CONTACT_PHRASES, CONTACT_LEMMAS), "verb_modifier": verb_modifier, "conjunctive": conjunctive,
    "prep_modifier": prep_modifier, "info_intent": info_intent, "premod_adj": lambda: _agreeing("pre"), "postmod_adj": lambda: _agreeing("post"),
}
NEGATIVE = {
    "fragment": fragment, "meta": meta, "dangling": dangling, "broken_grammar": broken_grammar, "number_hijack": number_hijack, "short_garbage": short_garbage,
    "orphan_genitive": orphan_genitive, "single_infinitive": single_infinitive,
}


def settle_conflicts(df: DataFrame) -> DataFrame:
    """Adds intent_mismatch where the seed asks for what no price or place answers; a district's word is no location of its own, and a
    specification drops what it explains."""
    first = "get(_sw, 0)"
    clash = f"({_in(first, NO_PRICE)} and array_contains(positive, 'commerce')) or ({_in(first, NO_PLACE)} and array_contains(positive, 'geo'))"
    df = df.withColumn("negative", F.expr(f"if({clash}, array_append(negative, 'intent_mismatch'), negative)"))
    df = df.withColumn("positive", F.expr("if(arrays_overlap(negative, array('wrong_district', 'unknown_district')), array_remove(positive, 'location'), positive)"))
    names = ", ".join(map(repr, BY_SPEC))
    return df.withColumn("negative", F.expr(f"if(array_contains(positive, 'product_spec'), array_except(negative, array({names})), negative)"))
