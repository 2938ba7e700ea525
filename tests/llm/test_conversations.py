import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedsift.llm import conversations as c
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """All paths, best first by (cost, audit), over (initial, fault) rows: an independent search with whole strings."""
    best = {"": (0, "")}  # by the automaton's state, named by what it has seen last: "", s, u, a

    def insert(states):
        states = dict(states)
        for _ in range(3):
            for q, (cost, audit) in list(states.items()):
                to = "a" if q == "u" else "u"
                got = (cost + 5, audit + "I")
                if to not in states or got < states[to]:
                    states[to] = got
        return states

    for initial, fault in rows:
        made = {}
        for q, (cost, audit) in insert(best).items():
            moves = [(q, cost + 2, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to = "a" if q == "u" else "u"
                moves.append((to, cost + 1 + more, audit + "R"))
                if initial == to or (initial == "s" and q == ""):
                    moves.append((initial, cost + more, audit + "K"))
            for to, *got in moves:
                if to not in made or tuple(got) < made[to]:
                    made[to] = tuple(got)
        best = made
    ends = insert(best)
    return min(ends[q] for q in ("", "a") if q in ends)


def plain(rows):
    """Summaries by sorting lists in the driver."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, said = set(), []
        for _, role, text in turns:
            visible = BLANK.findall(text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            said.append((role[:1], fault))
        cost, audit = cheapest(said) if said else (0, "")
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        lines, state, rest = [], "", iter(turns)
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            state = "s" if e == "K" and role[:1] == "s" else "a" if state == "u" else "u"
            lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        count = [sum(f == name for _, f in said) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(said, said[1:]))
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", "  \n", "Why? ", None, "a.b", " .", "x ", "long " * 30 + "."]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", "User", None, "unknown"]
    return [(rng.choice([1, 2, 3, 4, 5, None, -7]) if n < 100 else rng.randint(0, n // 6), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 60, 600])
def test_equal_to_a_plain_search(spark, n):
    rows = made(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = c.summaries(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_query_equals_a_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in c.op11_conversation_repair(spark, DATA).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("n", [0, 60, 600])
def test_sql_equals_a_plain_search(n):
    import duckdb

    rows = made(n, n + 1)
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.sql(c.OP11_SQL).fetchall(), key=str) == plain(rows)


LETTERS = [chr(65 + i) for i in range(16)]


def test_runs_equal_single_steps():
    """Binary powers and unrolling by halves against the plain search, with runs over the bound of held costs."""
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice(LETTERS) * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(0, 7)))
        cost, audit = cheapest([c.meaning(x) for x in s])
        assert int(c.times(c.over(s), c.at_end())[0]) == cost
        assert c.unroll(s, c.at_end(), 0, True)[0] == audit
    for s in ("G" * 700, "E" * 300 + "I" * 301, "A" * 100 + "M" * 200 + "B" * 65):
        cost, audit = cheapest([c.meaning(x) for x in s])
        assert (int(c.times(c.over(s), c.at_end())[0]), c.unroll(s, c.at_end(), 0, True)[0]) == (cost, audit)


def test_audit_is_the_least_of_all_cheapest():
    """Every string of edits of short conversations is tried."""
    for s in itertools.chain.from_iterable(itertools.product("AEIMFJG", repeat=n) for n in range(4)):
        rows = [c.meaning(x) for x in s]
        found = []
        for extra in range(5):
            for audit in itertools.product("DIKR", repeat=len(rows) + extra):
                if sum(e != "I" for e in audit) != len(rows):
                    continue
                state, cost, rest = 0, 0, iter(rows)
                for e in audit:
                    if e == "I":
                        state, cost = c.fed(state), cost + 5
                        continue
                    initial, fault = next(rest)
                    if e == "D":
                        cost += 2
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += 5 * (fault == "truncated") + (e == "R")
                    if e == "K" and initial == "s" and state == 0:
                        state = 1
                    elif e == "R" or initial == ("a" if c.fed(state) == 3 else "u"):
                        state = c.fed(state)
                    else:
                        break
                else:
                    if state in (0, 3):
                        found.append((cost, "".join(audit)))
            if len(rows) > 2 and extra > 1:
                break
        assert cheapest(rows) == min(found)


def test_a_hot_conversation_is_cut_into_pieces(spark):
    """One conversation over many ranges: pieces entered in every state give the same audit."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["A.", f"{i}.", f"{i}", ""])) for i in range(3000)] + [(2, 0, "user", "Hi.")]
    found = c.symbols(c.ordered(c.damaged(spark.createDataFrame(rows, SCHEMA))).withColumn("seg", F.expr("cast(shiftright(pos, 33) * 1000 + (pos & 8589934591L) div 40 as int)")))
    parts = c.pieces(found)
    assert parts.where("conv_id = 1").count() > 40
    got = {r.conv_id: (r.facts[4], r.audit) for r in c.audits(parts).collect()}
    want = {r[0]: (r[6], r[7]) for r in plain(rows)}
    assert got == want


def test_repaired_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "bot", "Hello!"), (1, 3, "user", "and"), (None, 0, "assistant", "Yes."), (None, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "seg": F.lit("y"), "audit": F.lit(1), "head": F.lit(2), "_first": F.lit(3)})
    got = sorted(((r.conv_id, r.place, r.role, r.text) for r in c.repaired(df).collect()), key=str)
    assert [g[2:] for g in got if g[0] == 1] == [("user", "Hi."), ("assistant", "Hello!")]
    assert [g[2:] for g in got if g[0] is None] == []
    assert c.summaries(df).count() == 2


def test_very_long_text(spark):
    rows = [(1, 5, "user", "word " * 400_000 + "end."), (1, 6, "assistant", "x" * 1_000_000)]
    assert [tuple(r) for r in c.summaries(spark.createDataFrame(rows, SCHEMA)).collect()] == plain(rows)


def test_matrices_are_min_plus_closed():
    ins = c.inserting()
    assert (c.times(ins, ins) == ins).all() and ins[c.NONE, c.ASSISTANT] == 10
    assert np.array_equal(c.power("E", 3), c.over("E" * 8))
