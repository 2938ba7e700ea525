"""Chat formatting with a proven round trip.

A turn renders as an opening mark, its text and a closing mark:

    user        [INST] text [/INST]
    assistant   (blank) text </s>
    any other   [ROLE name] text [/ROLE]

Each rendered turn is parsed again by a deterministic parser, which refuses a control string inside a text.
Where a turn does not come back as its source, the conflicting content is escaped (backslashes doubled, a
backslash put after the first character of every control string) and rendered again, until both are
identical: in what is rendered, control strings stand as marks only. A turn ends at its first closing mark,
so turns that come back one by one also come back from the whole conversation.

Rows are formatted one by one; the digests of a conversation stream over its sorted rows, so a task never
holds a whole conversation, and of a very long text one copy as rendered. Null text and null role count as
empty. Ties on turn go by role, then text; null turns come first; repeated rows are turns of their own; rows
without conv_id form one conversation of their own. No rows, no conversations. Only conv_id, turn, role and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seedsift.llm.common import map_batches

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE ", "[/ROLE]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return " ", " </s>"
    name = escape(role).replace("]", "\\]")
    return f"[ROLE {name}] ", " [/ROLE]"


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """The turn that starts at a place: role, text, start and stop of the text as rendered, and where the next turn starts.

    None if no turn starts there, or if a control string or a backslash that escapes nothing stands in its text.
    """
    if text.startswith("[INST] ", at):
        role, start, close = "user", at + 7, " [/INST]"
    elif m := _ROLE.match(text, at):
        role, start, close = unescape(m[1]), m.end(), " [/ROLE]"
    elif text.startswith(" ", at):
        role, start, close = "assistant", at + 1, " </s>"
    else:
        return None
    stop = text.find(close, start)
    if stop < 0:
        return None
    body = text[start:stop]
    if any(c in body for c in CONTROLS) or "\\" in _ESCAPED.sub("", body):
        return None
    return role, unescape(body), start, stop, stop + len(close)


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        got = parse_turn(text, at)
        if got is None:
            raise ValueError(f"no turn at character {at}")
        out.append(got[:2])
        at = got[4]
    return out


def render_turn(role: str, text: str) -> str:
    head, close = marks(role)
    for body in (text, escape(text)):
        made = head + body + close
        got = parse_turn(made)
        if got is not None and got[:2] == (role, text) and got[4] == len(made):
            return made
    raise ValueError("the turn does not survive a round trip")


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with each row's rendered segment and its loss span, the assistant's text, in characters of the segment."""

    def run(convs, turns, roles, texts):
        segments = [render_turn(r or "", t or "") for r, t in zip(roles, texts)]
        spans = [parse_turn(s)[2:4] if r == "assistant" else (None, None) for r, s in zip(roles, segments)]
        return {
            "conv_id": convs, "turn": turns, "role": roles, "text": texts, "segment": segments,
            "loss_start": [a for a, _ in spans], "loss_stop": [b for _, b in spans],
        }

    schema = "conv_id long, turn long, role string, text string, segment string, loss_start int, loss_stop int"
    return map_batches(rows.withColumn("turn", F.col("turn").cast("long")), ["conv_id", "turn", "role", "text"], run, schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv_id):
        self.row = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def add(self, segment: str, loss_start, loss_stop) -> None:
        """Reads one segment back."""
        role, text = parse(segment)[0]
        row = self.row
        row[1] += 1
        row[2].update(f"{role}\n{text}\n".encode())
        if loss_start is not None:
            loss = unescape(segment[loss_start:loss_stop])
            row[3] += len(loss)
            row[4].update(loss.encode())
        row[5] += len(segment)

    def values(self) -> list:
        return [x.hexdigest() if hasattr(x, "hexdigest") else x for x in self.row]


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the segments of each conversation back gives."""
    arrow = to_arrow_schema(T.StructType.fromDDL(DIGESTS))

    def run(batches):
        now, done = None, []
        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is None or now.row[0] != conv:
                    if now is not None:
                        done.append(now.values())
                    now = _Digest(conv)
                now.add(segment, a, b)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.values(), arrow)], schema=arrow)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = formatted.repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "segment", "loss_start", "loss_stop").mapInArrow(run, DIGESTS)


TRICKY = "</s>[INST] ok [/INST]"


def op3_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(rows.unionByName(own)))


OP3_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *,
        replace(replace(replace(replace(replace(replace(replace(t, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>'), '[ROLE ', '[\ROLE '), '[/ROLE]', '[\/ROLE]') as t_out,
        replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>'), '[ROLE ', '[\ROLE '), '[/ROLE]', '[\/ROLE]') as r_out from c),
f as (select *, case role when 'user' then '[INST] ' || t_out || ' [/INST]' when 'assistant' then ' ' || t_out || ' </s>'
        else '[ROLE ' || replace(r_out, ']', '\]') || '] ' || t_out || ' [/ROLE]' end as made from e)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
  coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(made))::bigint as formatted_chars
from f group by conv_id
"""
