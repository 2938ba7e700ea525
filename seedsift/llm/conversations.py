"""Repair of conversation structure by a run-length dynamic program.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. A row may be kept, given another role,
or deleted, and empty turns of user or assistant inserted; blank rows and duplicates have to go. What a row asks
for is one symbol of its role and its first fault; the states are those of the small automaton of the pattern.
Each symbol has a min-plus matrix of the costs from state to state. Equal consecutive symbols are one run, and a
run's matrix comes from cached binary powers. The cheapest edits are then unrolled, the least letter first
where several are as cheap: Delete, Insert, Keep, Rerole.

No task holds a whole conversation's rows: they are dealt by ranges of their order, each range gives pieces of
one letter a row, pieces give matrices, a conversation's matrices give the costs at every piece's end, and each
piece is unrolled by itself for every state that it may be entered in. The repaired rows stream; only the
audit, one letter a row, is a single value. An earlier equal row is found by the least place of equal rows,
whose hash spreads over tasks.

Null role or text counts as one space. Rows of one turn go by role, then text; null turns come first; rows
without conv_id form a conversation of their own. Repeated rows are duplicates. A conversation that loses all
its rows has zeros, an empty audit and the hash of nothing; no rows give no result. Very long texts are read
whole. Only conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seedsift.llm.common import Scratch, map_batches, table

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the pattern: nothing yet, after a system, a user and an assistant turn. The first and the last may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
_NEVER = 1 << 40
#: A symbol is a letter: four faults for each of four initials.
FAULTS = ("", "truncated", "blank", "duplicate")
INITIALS = ("s", "u", "a", "")


def symbol(initial: Column, fault: Column) -> Column:
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + role * 4 + fault)


def meaning(letter: str) -> tuple[str, str]:
    """The initial and the fault of a symbol."""
    return INITIALS[(ord(letter) - 65) // 4], FAULTS[(ord(letter) - 65) % 4]


def fed(state: int) -> int:
    """The state after the turn that alone may follow without being a system turn."""
    return ASSISTANT if state == USER else USER


def edits(letter: str) -> dict[str, list[tuple[int, int, int]]]:
    """(from state, to state, cost) by edit of a row with this symbol."""
    initial, fault = meaning(letter)
    out = {"D": [(q, q, DELETE) for q in range(4)], "K": [], "R": []}
    if fault in ("blank", "duplicate"):
        return out
    more = TRUNCATED if fault == "truncated" else 0
    for q in range(4):
        to = fed(q)
        out["R"].append((q, to, REROLE + more))
        if initial == "s" and q == NONE:
            out["K"].append((q, SYSTEM, more))
        elif initial == ("a" if to == ASSISTANT else "u"):
            out["K"].append((q, to, more))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two matrices, or of a matrix and a vector of costs to go."""
    made = (a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b[None]).min(1)
    return np.minimum(made, _NEVER)


@functools.cache
def inserting() -> np.ndarray:
    """The costs from state to state by inserting turns."""
    m = np.full((4, 4), _NEVER)
    for q in range(4):
        m[q, q] = 0
        m[q, fed(q)] = INSERT
    return times(m, times(m, m))


@functools.cache
def matrix(letter: str) -> np.ndarray:
    """The costs from state to state over one row, with the turns inserted before it."""
    m = np.full((4, 4), _NEVER)
    for moves in edits(letter).values():
        for q, to, cost in moves:
            m[q, to] = min(m[q, to], cost)
    return times(inserting(), m)


@functools.cache
def power(letter: str, j: int) -> np.ndarray:
    """The matrix of 2 ** j rows of one symbol."""
    return matrix(letter) if j == 0 else times(power(letter, j - 1), power(letter, j - 1))


def over_run(letter: str, n: int, after: np.ndarray) -> np.ndarray:
    """n rows of one symbol before what follows."""
    for j in range(n.bit_length()):
        if n >> j & 1:
            after = times(power(letter, j), after)
    return after


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(k, sum(1 for _ in g)) for k, g in itertools.groupby(symbols)]


def over(symbols: str) -> np.ndarray:
    """The matrix of a piece."""
    m = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for letter, n in reversed(runs(symbols)):
        m = over_run(letter, n, m)
    return m


@functools.cache
def at_end() -> np.ndarray:
    """The costs to go after the last row."""
    return inserting()[:, ENDS].min(1)


#: Rows of a run whose costs to go are held at once while its edits are unrolled.
HELD = 64


def _unroll_run(letter: str, n: int, after: np.ndarray, state: int, out: list[str]) -> int:
    """Appends the edits of n rows of one symbol, entered in a state; gives the state after them."""
    if n > HELD:
        half = 1 << (n.bit_length() - 2)  # the later half, so that its power is cached
        state = _unroll_run(letter, n - half, over_run(letter, half, after), state, out)
        return _unroll_run(letter, half, after, state, out)
    costs = [after.tolist()]
    for _ in range(n):
        after = times(matrix(letter), after)
        costs.append(after.tolist())
    moves = {(e, q): (to, cost) for e, found in edits(letter).items() for q, to, cost in found}
    for i in range(n, 0, -1):
        here, rest = costs[i], costs[i - 1]
        while True:
            for e in "DIKR":
                if e == "I":
                    if INSERT + here[fed(state)] == here[state]:
                        state = fed(state)
                        out.append("I")
                        break
                elif (move := moves.get((e, state))) and move[1] + rest[move[0]] == here[state]:
                    state = move[0]
                    out.append(e)
                    break
            if out[-1] != "I":
                break
    return state


def unroll(symbols: str, after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The cheapest edits of a piece, entered in a state, before rows with these costs to go; and the state after it."""
    parts = runs(symbols)
    follows = [after]
    for letter, n in reversed(parts[1:]):
        follows.append(over_run(letter, n, follows[-1]))
    out: list[str] = []
    for (letter, n), rest in zip(parts, reversed(follows)):
        state = _unroll_run(letter, n, rest, state, out)
    while last and state not in ENDS:
        state = fed(state)
        out.append("I")
    return "".join(out), state


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults that the checksum of `conv_id:turn` plants."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_kind"))
        .where("_kind != 0")
        .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("text", F.expr("case _kind when 1 then '' when 2 then translate(text, '.!?', '') else text end"))
        .select("conv_id", "turn", "role", "text", F.explode(F.expr("sequence(1, if(_kind = 3, 2, 1))")).alias("_copy"))
        .drop("_copy")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order of all, dealt by ranges of it; seg numbers the ranges."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)))  # ranges only: rows equal so far share one
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumns({"pos": F.monotonically_increasing_id(), "seg": F.spark_partition_id()})


def symbols(rows: DataFrame) -> DataFrame:
    """(pos, seg, conv_id, turn, symbol) of ordered rows."""
    firsts = rows.groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("_text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select("pos", "seg", "conv_id", "turn", F.left("role", F.lit(1)).alias("_initial"), last.alias("_last"))
    fault = F.when(F.col("_last") == "", 2).when(F.col("_first").isNull(), 3).when(~F.col("_last").isin(".", "!", "?"), 1).otherwise(0)
    return narrow.join(firsts, "pos", "left").select("pos", "seg", "conv_id", "turn", symbol(F.col("_initial"), fault).alias("symbol"))


def pieces(found: DataFrame) -> DataFrame:
    """(conv_id, seg, symbols): a conversation's letters in one range."""
    return found.groupBy("conv_id", "seg").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, symbol))), x -> x.symbol), '')").alias("symbols"))


_FACTS = "blank long, duplicate long, truncated long, illegal long"
_LEGAL = {"su", "ua", "au"}


def facts(symbols: str) -> list[int]:
    """Faults of a piece's rows, and its neighbours whose roles may not follow each other."""
    said = [meaning(x) for x in symbols]
    return [*(sum(f == name for _, f in said) for name in FAULTS[2:]), sum(f == "truncated" for _, f in said), sum(x[0] + y[0] not in _LEGAL for x, y in zip(said, said[1:]))]


def priced(parts: DataFrame) -> DataFrame:
    """Pieces with their costs to go at the end, whether they are a conversation's first or last one, and the conversation's facts and cost."""

    def one(convs, segs, letters):
        fact = [facts(x) for x in letters]
        return {"conv_id": convs, "seg": segs, "matrix": [over(x).ravel() for x in letters], "ends": [x[0] + x[-1] for x in letters], "facts": fact}

    made = map_batches(parts, ["conv_id", "seg", "symbols"], one, "conv_id long, seg int, matrix array<long>, ends string, facts array<long>")
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "matrix", "ends", "facts"))).alias("parts"))

    def all_of(convs, lists):
        out = {c: [] for c in ("conv_id", "seg", "after", "first", "last", "facts")}
        for conv, items in zip(convs, lists):
            after, afters = at_end(), []
            for x in reversed(items):
                afters.append(after)
                after = times(np.array(x["matrix"]).reshape(4, 4), after)
            total = np.sum([x["facts"] for x in items], axis=0).tolist()
            total[3] += sum(meaning(x["ends"][1])[0] + meaning(y["ends"][0])[0] not in _LEGAL for x, y in zip(items, items[1:]))
            for i, (x, a) in enumerate(zip(items, reversed(afters))):
                for name, value in zip(out, (conv, x["seg"], a, i == 0, i == len(items) - 1, [*total, int(after[NONE])])):
                    out[name].append(value)
        return out

    return map_batches(whole, ["conv_id", "parts"], all_of, "conv_id long, seg int, after array<long>, first boolean, last boolean, facts array<long>")


def audits(parts: DataFrame) -> DataFrame:
    """(conv_id, facts, audit) of pieces."""
    mine = parts.withColumnsRenamed({"conv_id": "_conv", "seg": "_seg"})
    known = mine.join(priced(parts), F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_seg") == F.col("seg")))

    def one(convs, segs, letters, afters, firsts, lasts):
        out = {"conv_id": convs, "seg": segs, "said": [], "left": []}
        for x, after, first, last in zip(letters, afters, firsts, lasts):
            got = [unroll(x, np.array(after), q, last) for q in range(1 if first else 4)]
            out["said"].append([g[0] for g in got])
            out["left"].append([g[1] for g in got])
        return out

    said = map_batches(known, ["conv_id", "seg", "symbols", "after", "first", "last"], one, "conv_id long, seg int, said array<string>, left array<int>", carry=["facts"])
    whole = said.groupBy("conv_id").agg(F.first("facts").alias("facts"), F.sort_array(F.collect_list(F.struct("seg", "said", "left"))).alias("parts"))
    step = "struct(concat(x.audit, p.said[x.state]) as audit, p.left[x.state] as state)"
    return whole.select("conv_id", "facts", F.expr(f"aggregate(parts, struct('' as audit, 0 as state), (x, p) -> {step}).audit").alias("audit"))


_HEAD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_EDITED = "conv_id long, head boolean, facts array<long>, audit string, place long, edit string, role string, text string"


def _heads(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, facts, audit) of every conversation of the rows before damage, with the gaps first."""
    turns = found.groupBy("conv_id").agg(F.expr("max(turn) - min(turn) + 1 - count(distinct turn)").alias("gaps"))
    parts = rows.select("conv_id").distinct().unionByName(turns, allowMissingColumns=True).unionByName(audits(pieces(found)), allowMissingColumns=True)
    whole = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "facts", "audit")))
    facts_ = F.concat(F.array(F.coalesce("gaps", F.lit(0).cast("long"))), F.coalesce("facts", F.expr("array_repeat(0L, 5)")))
    return whole.select("conv_id", facts_.alias("facts"), F.coalesce("audit", F.lit("")).alias("audit"))


def _edit(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From rows in order, each conversation's head before its turns: the head, then one row for each edit."""
    audit = at = state = place = conv = None
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = fed(state)
                out.append((conv, False, None, None, place, "I", "assistant" if state == ASSISTANT else "user", ""))
                at, place = at + 1, place + 1

        for row_conv, head, row_facts, row_audit, role, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if head:
                if audit is not None:
                    insert()
                conv, audit, at, state, place = row_conv, row_audit, 0, NONE, 0
                out.append((conv, True, row_facts, row_audit, None, None, None, None))
                continue
            insert()
            e = audit[at]
            at += 1
            if e == "K":
                state = SYSTEM if state == NONE and role[:1] == "s" else fed(state)
            elif e == "R":
                state = fed(state)
                role = "assistant" if state == ASSISTANT else "user"
            out.append((conv, False, None, None, place, e, role, text))
            place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if audit is not None and at < len(audit):
        rest = []
        for _ in audit[at:]:
            state = fed(state)
            rest.append((conv, False, None, None, place, "I", "assistant" if state == ASSISTANT else "user", ""))
            place += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), schema)], schema=schema)


def edited(rows: DataFrame, damage=damaged) -> DataFrame:
    """A head row of each conversation, followed in its partition by one row for each edit: place, edit, role and text (of deleted rows as they were)."""
    scratch = Scratch(rows.sparkSession)
    turns = scratch.write(ordered(damage(rows)))
    heads = scratch.write(_heads(rows, scratch.write(symbols(turns))))
    both = heads.withColumn("head", F.lit(True)).unionByName(turns.select("conv_id", "pos", "role", "text", F.lit(False).alias("head")), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "pos")
    schema = to_arrow_schema(T.StructType.fromDDL(_EDITED))
    return dealt.select("conv_id", "head", "facts", "audit", "role", "text").mapInArrow(lambda batches: _edit(batches, schema), _EDITED)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations, taken as they are."""
    plain = lambda d: d.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return edited(rows, plain).where("not head and edit != 'D'").select("conv_id", "place", "role", "text")


SUMMARY = f"conv_id long, {', '.join(f'{c} long' for c in _HEAD)}, audit string, repaired_sha256 string"


def summaries(rows: DataFrame, damage=damaged) -> DataFrame:
    """One row for each conversation of the rows: faults, cost, audit and the hash of the repaired `role:text` lines."""
    schema = to_arrow_schema(T.StructType.fromDDL(SUMMARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, empty = None, None, True
        for batch in batches:
            done = []
            for conv, head, row_facts, audit, _, e, role, text in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if head:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest, empty = (conv, *row_facts, audit), hashlib.sha256(), True
                elif e != "D":
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, digest.hexdigest()), schema)], schema=schema)

    return edited(rows, damage).mapInArrow(run, SUMMARY)


def op11_conversation_repair(spark, sf_dir):
    return summaries(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
with recursive tb(i, k, v) as (select i, 0, i::ubigint from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from tb where k < 8),
tl as (select list(v order by i) as crc from tb where k = 8),
c0 as (select dense_rank() over (order by conv_id nulls first) as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
c1 as (select c0.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::ubigint), lambda acc, b: xor(acc >> 8, crc[(xor(acc, b) & 255)::int + 1]), 4294967295::ubigint), 4294967295::ubigint) % 20 as kind from c0, tl),
c2 as (select c, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) from c1 where kind <> 0),
c3 as (select *, row_number() over (partition by c order by turn nulls first, role, text) as p from c2),
c4 as (select *, row_number() over (partition by c, role, text order by p) as again, role[1:1] as ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from c3),
r as (select c, p, turn, role, text, ini, case when last = '' then 'blank' when again > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(ini) over (partition by c order by p) as before from c4),
s as (select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal from r group by c),
go(c, p, v) as (select c, n, [0, 10, 5, 0]::bigint[] from s union all
  select c, p - 1, [least(u[1], 5 + u[3], 10 + u[4]), least(u[2], 5 + u[3], 10 + u[4]), least(u[3], 5 + u[4]), least(u[4], 5 + u[3])] from (
    select go.c, go.p, list_transform(range(0, 4), lambda q: least(2 + v[q + 1], case when fault in ('blank', 'duplicate') then 1000000000 else (case fault when 'truncated' then 5 else 0 end)
      + least(1 + v[case when q = 2 then 4 else 3 end], case when ini = 's' and q = 0 then v[2] when ini = (case when q = 2 then 'a' else 'u' end) then v[case when q = 2 then 4 else 3 end] else 1000000000 end) end)) as u
    from go join r on r.c = go.c and r.p = go.p) x),
walk(c, p, q, audit, said) as (select c, 0::bigint, 0, '', []::varchar[] from s union all
  select c, case when e = 'I' then p else p + 1 end, case e when 'D' then q when 'K' then case when ini = 's' and q = 0 then 1 else fed end else fed end, audit || e,
    case e when 'D' then said else list_append(said, case when e = 'K' then role else case fed when 3 then 'assistant' else 'user' end end || ':' || case when e = 'I' then '' else text end) end from (
    select w.c, w.p, q, audit, said, role, text, ini, case when q = 2 then 3 else 2 end as fed, case when r.c is null then 'I' when 2 + b.v[q + 1] = a.v[q + 1] then 'D' when 5 + a.v[case when q = 2 then 4 else 3 end] = a.v[q + 1] then 'I'
        when fault not in ('blank', 'duplicate') and (case fault when 'truncated' then 5 else 0 end) + case when ini = 's' and q = 0 then b.v[2] when ini = (case when q = 2 then 'a' else 'u' end) then b.v[case when q = 2 then 4 else 3 end] else 1000000000 end = a.v[q + 1] then 'K' else 'R' end as e
    from walk w join s on s.c = w.c join go a on a.c = w.c and a.p = w.p left join go b on b.c = w.c and b.p = w.p + 1 left join r on r.c = w.c and r.p = w.p + 1 where w.p < s.n or a.v[q + 1] > 0) y),
done as (select c, arg_max(audit, length(audit)) as audit, arg_max(said, length(audit)) as said from walk group by c)
select i.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(go.v[1], 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
from (select distinct c, conv_id from c0) i left join s on s.c = i.c left join go on go.c = i.c and go.p = 0 left join done on done.c = i.c
"""
