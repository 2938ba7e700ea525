"""What large tables asked for: results over the bounds of one block, and plans that carry no needless rows."""

from seedsift.operators import clean, geo, seed_match, verdicts
from seedsift.plans import seed_queries
from seedsift.sources import tables as S
from tests.conftest import DATA


def test_batches_of_a_seed_are_numbered_as_one(spark):
    rows = [(s, f"word {i * 7919 % 5000:05d}") for s, m in ((1, 2345), (2, 20), (3, 1)) for i in range(m)]
    got = verdicts.make_batches(spark.createDataFrame(rows, "seed_id long, keyword string")).collect()
    want = {}
    for s in (1, 2, 3):
        k = sorted(w for x, w in rows if x == s)
        for at in range(0, len(k), 20):
            part = k[at : at + 20]
            want[s, at // 20] = (0, len(part), "\n".join(f"{i}. {w}" for i, w in enumerate(part, 1)))
    assert {(r.seed_id, r.batch): (r.bucket, r.size, r.prompt) for r in got} == want and len(got) == len(want)


def test_known_tokens_hold_all_that_may_be_names(spark):
    texts = ["доставка из нижнего новгорода", "киев купить", "в киеве b", "new york hotel", "york b", "нижний двор", "", None, "c d e f g h"]
    kw = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "seed_id long, kw_id long, keyword string")
    dim = spark.createDataFrame([("киев",), ("new york",), ("нижнего новгорода",), ("one two three four",), (None,)], "name string")
    known = geo.known_tokens(kw, [dim])
    rows = lambda toks: sorted(map(str, geo.by_form(toks, dim).collect()))
    assert rows(known) == rows(geo.tokens(kw)) and len(rows(known)) == 4
    assert known.count() <= 10 < geo.tokens(kw).count()


def test_keyword_text_stands_once_in_the_plan(spark):
    plan = clean.dedupe_first(S.keywords(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN concat_ws") <= 9 and plan.count("regexp_replace") == 1


def test_demoted_l2_makes_keywords_once(spark, monkeypatch):
    judge, read = seed_match.sanity_demotions, []
    monkeypatch.setattr(seed_match, "sanity_demotions", lambda kw, *rest: read.extend(kw.inputFiles()) or judge(kw, *rest))
    seed_queries.demoted_l2(spark, DATA)
    assert read and not [f for f in read if f.endswith("lineitem.parquet")]


def test_equal_keywords_go_before_their_seed_is_looked_up(spark):
    """Behind the joins with line items comes the distinct, then the seed; their texts are not spelled anew for each line item, and no part is broadcast."""
    query = seed_queries._keywords(spark, DATA)._jdf.queryExecution()
    plan, run = query.optimizedPlan().toString().split("\n"), query.executedPlan().toString()
    joins, distinct = ([i for i, line in enumerate(plan) if kind in line] for kind in (" Join Inner", "Aggregate [seed#"))
    assert joins[0] < distinct[0] < joins[1] < joins[2]
    assert not [line for line in plan[: joins[2]] if "translate(" in line and "concat_ws" in line]
    assert run.count("ShuffledHashJoin") == 2


def test_demoted_l2_decides_tails_of_valid_and_demoted_keywords(spark):
    """A tail that stands beside its whole seed in one keyword and in a demoted one is decided like any other grey tail."""
    first, valid = {}, set()
    for r in seed_queries.demotions(spark, DATA).join(seed_queries._seeds(spark, DATA), "seed_id").orderBy("keyword").collect():
        key = r.seed_id, " ".join(w for w in r.keyword.split() if w not in r.seed.split())
        if r.seed in r.keyword and r.demoted_reason is None:
            valid.add(key)
        elif key[1]:
            first.setdefault(key, r.demoted_reason is not None)
    got = seed_queries.demoted_l2(spark, DATA).collect()
    assert {(r.seed_id, r.tail): r.rule == "r0_demoted" for r in got} == first and len(got) == len(first)
    assert [k for k in first if first[k] and k in valid]
