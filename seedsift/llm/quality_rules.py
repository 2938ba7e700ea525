"""Quality rules, all in Spark's own functions.

Base measures follow fixed rules; the cascade adds cheap statistical rules. Rules are conjunctive, so
their order changes the cost of a verdict and never the verdict itself: on a sample of all rows it is
measured what each rule rejects and how long it takes, and rules run by rejection per cost. What only one
rule needs is computed inside that rule's branch, thus only for rows that no rule before it rejected; the
base measures are asked for of every row.

Null or empty text: no words, every count 0, base_failed and not kept. Repeated rows: judged one by one;
there are no ties. Very long texts: time n log n in their words. Columns of docs with a result's name are
replaced, all others stay. Empty input: empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import Scratch, numbered

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows expected in the sample that prices the rules; it sets an order only.
SAMPLE_ROWS = 1000
#: The position's bits in a packed window; texts with more windows than fit take the way for colliding hashes.
POS_BITS = 26


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the base measures and over _text, _words (without blanks) and _lines (with a word)."""

    name: str
    fails: str


RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule("dup_lines", "10 * n_dup_lines > 5 * size(_lines)"),
    Rule("shouting", "10 * length(regexp_replace(_text, '[^A-Z]+', '')) > 6 * word_chars"),
    Rule("letters", r"10 * size(filter(_words, w -> w rlike r'[A-Za-z\x80-\x{10FFFF}]')) < 7 * n_words"),
    Rule("bullets", r"10 * size(filter(_lines, x -> x rlike r'^[\x20\x09-\x0D]*[-*\x{2022}]')) > 9 * size(_lines)"),
    Rule("ellipses", r"10 * size(filter(_lines, x -> x rlike r'(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) > 3 * size(_lines)"),
)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*MEASURES, "base_failed", "failed_rule", "kept"]
PARTS = ["_text", "_words", "_lines"]


def _removed(col: Column, chars: str) -> Column:
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _with_repeated(df: DataFrame) -> DataFrame:
    """Adds _again: the sorted places of _words where a window stands that the text has twice or more; null for none."""
    low = (1 << POS_BITS) - 1
    df = df.withColumn("_word_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_hashes", F.expr("case when size(_words) > 3 then transform(sequence(0, size(_words) - 3), i -> xxhash64(_word_hashes[i], _word_hashes[i + 1], _word_hashes[i + 2])) end"))
    # Different hashes, different windows: most texts need no more.
    df = df.withColumn("_repeats", F.expr("_hashes is not null and size(array_distinct(_hashes)) < size(_hashes)"))
    # A hash's high bits and the place in the low ones: after one sort of plain longs, equal windows are neighbours.
    df = df.withColumn("_packed", F.expr(f"case when _repeats and size(_hashes) <= {low} then sort_array(transform(_hashes, (h, i) -> (h & {~low}L) | cast(i as bigint))) end"))
    place = lambda at: f"cast(_packed[{at}] & {low}L as int)"
    equal = lambda a, b: f"shiftright(_packed[{a}], {POS_BITS}) = shiftright(_packed[{b}], {POS_BITS})"
    differ = " or ".join(f"_words[{place('i')} + {k}] <> _words[{place('i - 1')} + {k}]" for k in range(3))
    df = df.withColumn("_mixed", F.expr(f"case when _packed is not null then exists(sequence(1, size(_packed) - 1), i -> {equal('i', 'i - 1')} and ({differ})) end"))
    # Where windows with equal bits differ, or places do not fit, the windows themselves are sorted.
    df = df.withColumn(
        "_spelled",
        F.expr("case when _repeats and coalesce(_mixed, true) then sort_array(transform(_hashes, (h, i) -> struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) as g, i as i))) end"),
    )
    twice = lambda same, n: f"i -> (i > 0 and {same('i', 'i - 1')}) or (i < {n} - 1 and {same('i', 'i + 1')})"
    return df.withColumn(
        "_again",
        F.expr(
            f"""case when _spelled is not null then sort_array(transform(filter(sequence(0, size(_spelled) - 1),
                  {twice(lambda a, b: f"_spelled[{a}].g = _spelled[{b}].g", "size(_spelled)")}), i -> _spelled[i].i))
                when _packed is not null then sort_array(transform(filter(sequence(0, size(_packed) - 1),
                  {twice(equal, "size(_packed)")}), i -> {place("i")})) end"""
        ),
    )


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs, the base measures, and the parts that rules read."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", F.filter(F.split("_text", SPACES), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return _with_repeated(df).select(
        *docs.columns,
        *PARTS,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_removed(F.col("_text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_removed(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.coalesce(F.size("_again"), F.lit(0)) <= 0, F.lit(0).cast("long"))
        .otherwise(F.expr("aggregate(transform(sequence(0, size(_again) - 1), i -> if(i = size(_again) - 1, 3, least(3, _again[i + 1] - _again[i]))), 0L, (a, x) -> a + x)"))
        .alias("n_repeat_words"),
    )


def ordered_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share of rows rejected per second, both measured on a sample drawn from all rows; ties keep the given order."""
    scratch = Scratch(docs.sparkSession)
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.col(text).alias("text")).sample(share, seed=1)
    sample = scratch.write(_measured(sample, "text").drop("text"))

    def run(fails: str) -> tuple[int, float]:
        took = []
        for _ in range(2):  # the first run compiles the rule's code
            began = time.perf_counter()
            n = sample.agg(F.count_if(F.expr(fails))).first()[0]
            took.append(time.perf_counter() - began)
        return n, min(took)

    _, idle = run("n_words < 0")
    found = {r.name: run(r.fails) for r in rules}
    scratch.drop(sample)
    return sorted(rules, key=lambda r: -found[r.name][0] / max(found[r.name][1] - idle, 1e-3))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the base measures, base_failed, failed_rule (the first rule of the cascade that rejects, else null) and kept."""
    docs, names = numbered(docs, RESULTS)
    text = names[text]
    failed = F.lit(None).cast("string")
    for r in reversed(ordered_rules(docs, text, rules)):
        failed = F.when(F.expr(r.fails), F.lit(r.name)).otherwise(failed)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        _measured(docs, text)
        .withColumn("base_failed", base)
        .withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(failed))
        .withColumn("kept", F.col("failed_rule").isNull())
        .select(*(F.col(n).alias(c) for c, n in names.items()), *RESULTS)
    )


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
k as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from g),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from k) where c > 1),
cov as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from rep) group by r),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::bigint as n_upper,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x80-\x{10FFFF}]'))) as n_letters,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) as n_bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) as n_ellipses, coalesce(cov.n, 0)::bigint as n_repeat_words
      from w left join cov using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words
    or (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words))
    or 10 * n_dup_lines > 5 * n_lines or 10 * n_upper > 6 * word_chars
    or 10 * n_letters < 7 * n_words or 10 * n_bullets > 9 * n_lines or 10 * n_ellipses > 3 * n_lines) as kept
from m
"""
