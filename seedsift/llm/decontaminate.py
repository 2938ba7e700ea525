"""Benchmark decontamination.

Test items and documents are normalised alike: A-Z lowered, words by one rule. A window is 13 consecutive item
words. One Aho-Corasick automaton over the words of the normalised items scans a document once; what it holds
are the items cut into runs of seven words, since every window has one of those runs whole in it (pigeonhole:
13 = 2 * 7 - 1), and items shorter than a window as they are. Where a run stands, the windows around it are
looked up in the table of all windows, word for word, each place once; hits are mapped to the document's words
and to characters of the original text. So memory is some hundred bytes per item word, not a path of 13 words.

Items go to the tasks as a broadcast of their text, whose size is checked. A benchmark over BLOCK_BYTES is
dealt into blocks: each block's pass gives only what it found, by a digest of the text, and the last step
brings the findings of all passes together; only texts with findings are shuffled for that.

Null or empty text: no words, no hits, not contaminated; the hash is that of no bytes. Items without words
have no window. Repeated rows are scanned one by one; repeated item_ids count once. Items without item_id hit
like others and count as one item together, which is not listed by name. Very long texts: work and memory are
linear in the text. Columns of docs with a result's name are replaced, all others stay. Empty input: empty
result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import ALNUM, Scratch, bitmap, map_batches, maybe_in, numbered, surely_not_in

WINDOW = 13
#: Bytes of item texts in one automaton and its broadcast.
BLOCK_BYTES = 4_000_000
#: Letters that spell a word's number; a block has fewer words than they can tell apart.
LETTERS = 3
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()


def _letters(words: np.ndarray) -> str:
    """Numbers of words as LETTERS letters each: no state of the automaton then has more than 256 ways on."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :LETTERS].tobytes().decode("latin-1")


class Automaton:
    """The windows of a block of items, (item_id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.size, self.run = size, (size + 1) // 2
        self.ids: dict[bytes, int] = {}
        self.names = sorted({x for x, _ in items if x is not None}) + [None]
        number = {x: k for k, x in enumerate(self.names)}
        spelled = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in normalised(t)], np.uint32) for _, t in items]
        self.words = np.concatenate([np.zeros(0, np.uint32), *spelled])
        runs: set[str] = set()
        whole: dict[str, set[int]] = {}
        places, owners, start = [], [], 0
        for (item, _), words in zip(items, spelled):
            if len(words) >= size:
                flat = _letters(words)
                runs.update(flat[at * LETTERS : (at + self.run) * LETTERS] for at in range(0, len(words) - self.run + 1, self.run))
                places.append(np.arange(start, start + len(words) - size + 1))
                owners.append(np.full(len(words) - size + 1, number[item]))
            elif len(words):
                whole.setdefault(_letters(words), set()).add(number[item])
            start += len(words)
        self._index(np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *owners]))
        self.trie = ahocorasick.Automaton()
        for x in runs:
            self.trie.add_word(x, (self.run, True, ()))
        for x, names in whole.items():
            self.trie.add_word(x, (len(x) // LETTERS, x in runs, tuple(names)))
        self.empty = not len(self.trie)
        if not self.empty:
            self.trie.make_automaton()

    def _hash(self, words: np.ndarray, at: int) -> int:
        return xxhash.xxh3_64_intdigest(words[at : at + self.size].tobytes())

    def _index(self, place: np.ndarray, owner: np.ndarray) -> None:
        """The windows by hash, with a place that spells each and its item; an item's repeated windows once."""
        h = np.fromiter((self._hash(self.words, at) for at in place), np.uint64, len(place))
        order = np.lexsort((owner, h))
        h, place, owner = h[order], place[order], owner[order]
        again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
        span = np.arange(self.size)
        same = [k for k in again if np.array_equal(self.words[place[k] + span], self.words[place[k - 1] + span])]
        keep = np.ones(len(h), bool)
        keep[same] = False
        self.hash, self.place, self.owner = h[keep], place[keep], owner[keep]

    def window(self, words: np.ndarray, at: int) -> set[int] | None:
        """The items that have the window at a place of a text, or None. Windows that share a hash are told apart by their words."""
        h, mine, found = np.uint64(self._hash(words, at)), words[at : at + self.size], set()
        a, b = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        for k in range(a, b):
            if np.array_equal(self.words[self.place[k] : self.place[k] + self.size], mine):
                found.add(int(self.owner[k]))
        return found or None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Disjoint spans of hit words (stop excluded) and the items found."""
        if self.empty or not words:
            return [], set()
        get = self.ids.get
        flat, found, items, tried = np.array([get(w, 0) for w in words], np.uint32), [], set(), -1
        if not flat.any():
            return [], set()
        known: dict[bytes, set[int] | None] = {}
        for end, (n, is_run, owners) in self.trie.iter(_letters(flat)):
            stop, odd = divmod(end + 1, LETTERS)
            if odd:
                continue  # letters of two words that happen to spell another one
            first = stop - n
            if owners:
                found.append((first, stop))
                items.update(owners)
            if is_run:
                for at in range(max(tried + 1, stop - self.size, 0), min(first, len(flat) - self.size) + 1):
                    key = flat[at : at + self.size].tobytes()
                    if key not in known:
                        known[key] = self.window(flat, at)
                        items.update(known[key] or ())
                    if known[key] is not None:
                        found.append((at, at + self.size))
                    tried = at
        return merged(found), {self.names[k] for k in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original_offsets(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text or "")]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def blocks_of(items: DataFrame, scratch: Scratch) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """The items in blocks of bounded size, dealt by id, one collected at a time, and whether there is but one."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    named = items.select(F.col("item_id").cast("string"), "text").where("text is not null")
    n = -(-total // BLOCK_BYTES)
    if n <= 1:
        yield [tuple(r) for r in named.collect()], True
        return
    keyed = scratch.write(named.withColumn("_block", F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(n))))
    for k in range(n):
        yield [tuple(r) for r in keyed.where(F.col("_block") == k).drop("_block").collect()], False


_built: dict[str, Automaton] = {}


def _automaton(key: str, sent: Broadcast, size: int) -> Automaton:
    """The block's automaton, built once in each worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(sent.value, size)
    return _built[key]


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "offsets"]
SPANS = "array<struct<start:int,stop:int>>"
SCHEMA = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans {SPANS}, offsets {SPANS}"


def _row(text: str | None, n_words: int, spans: list[tuple[int, int]], items: set[str | None]) -> tuple:
    hit = sum(b - a for a, b in spans)
    names = sorted(x for x in items if x is not None)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    pairs = [[{"start": a, "stop": b} for a, b in x] for x in (spans, original_offsets(text, spans))]
    return n_words, hit, len(items), digest, hit > 0 and 20 * hit >= n_words, names, *pairs


def scan_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with counts, verdict, items, spans (in words) and offsets (the same in characters of the text) of every row's text against items (item_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs, names = numbered(docs, RESULTS)
    docs, back = docs.withColumnRenamed(names["text"], "text"), [F.col("text" if c == "text" else n).alias(c) for c, n in names.items()]
    found = []
    for block, only in blocks_of(items, scratch):
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)
        if only:
            return _scan(docs, key, sent, size).select(*back, *RESULTS)
        found.append(scratch.write(_findings(docs, key, sent, size)))
    return _together(docs, found, scratch).select(*back, *RESULTS)


def _scan(docs: DataFrame, key: str, sent: Broadcast, size: int) -> DataFrame:
    def run(texts):
        made, rows = _automaton(key, sent, size), []
        for t in texts:
            words = normalised(t)
            rows.append(_row(t, len(words), *made.scan(words)))
        return dict(zip(RESULTS, zip(*rows)))

    return map_batches(docs, ["text"], run, SCHEMA, carry=docs.columns)


def _digest(df: DataFrame) -> DataFrame:
    """Adds a digest of the text."""
    return df.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))


def _findings(docs: DataFrame, key: str, sent: Broadcast, size: int) -> DataFrame:
    """(_key, items, spans) of the texts in which one block's pass finds something; a null in items is an item without id."""

    def run(texts):
        made, rows = _automaton(key, sent, size), []
        for t in texts:
            spans, names = made.scan(normalised(t))
            if spans:
                rows.append((hashlib.sha256(t.encode()).hexdigest(), list(names), [{"start": a, "stop": b} for a, b in spans]))
        return dict(zip(("_key", "items", "spans"), zip(*rows))) if rows else None

    return map_batches(docs, ["text"], run, f"_key string, items array<string>, spans {SPANS}")


def _together(docs: DataFrame, found: list[DataFrame], scratch: Scratch) -> DataFrame:
    """What all passes found, for every row of docs. Copies of a text give equal findings, so one of each pass is kept."""
    parts = [f.dropDuplicates(["_key"]) for f in found]
    every = parts[0]
    for f in parts[1:]:
        every = every.unionByName(f)
    every = every.groupBy("_key").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    every = scratch.write(every)
    bits = scratch.write(bitmap(every, "_key"))
    scratch.keep_only(every, bits)
    keyed = _digest(docs)
    some = maybe_in(keyed, "_key", bits).join(every, "_key", "left")
    rest = surely_not_in(keyed, "_key", bits).withColumns({"_items": F.lit(None).cast("array<string>"), "_spans": F.lit(None).cast(SPANS)})

    def run(texts, names, spans):
        rows = [_row(t, len(normalised(t)), merged([(s["start"], s["stop"]) for s in b or ()]), set(a or ())) for t, a, b in zip(texts, names, spans)]
        return dict(zip(RESULTS, zip(*rows)))

    return map_batches(some.unionByName(rest.select(*some.columns)), ["text", "_items", "_spans"], run, SCHEMA, carry=docs.columns)


def op7_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scan_documents(docs.select("doc_id", "text"), items).drop("text", "items", "spans", "offsets")


OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as w
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
ns as (select distinct n from bw),
dw as (select r, n, i, array_to_string(ws[i:i + n - 1], ' ') as w from (select r, n, ws, unnest(range(1, len(ws) - n + 2)) as i from d, ns where len(ws) >= n)),
hit as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw using (n, w)),
cov as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join cov using (r) left join its using (r)
"""
