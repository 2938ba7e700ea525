"""Line dedup by a log-template tree.

A line's words are its tokens; tokens with a digit are variable fields and become one mark. The tree has a
fixed depth: the first level is the token count, the next ones are the leading tokens. In a leaf, distinct
token sequences are clustered in a fixed order (most documents first): a sequence joins the first template
that it agrees with in enough places, and places that differ become variable too.

A line recurs if its masked sequence stands in two documents or more, or if its generalised template covers
enough sequences in documents. The document with the smallest doc_id keeps a recurring line; all others
drop it. Lines shorter than MIN_TOKENS never count: short ones coincide by chance.

Only hashes of lines are shuffled; token sequences travel just for leaves that could hold a generalised
template, and texts just for documents that lose a line. Lines meet by the hash of the whole sequence and by
that of their leaf together, so a chance collision needs two lines of one leaf. A leaf is always clustered as
a whole: a large one streams through an index of its templates, with the same result.

Null or empty text: no lines, nothing dropped, the text stays as it is. Rows without doc_id are left alone
and count for nothing. Rows that share a doc_id count as one document. Ties between sequences in as many
documents go by their text. Very long texts: their lines are hashed one by one and only hashes travel. Columns
named n_lines or n_dropped are replaced, all others stay. Empty input: empty result.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import Scratch, bitmap, map_batches, maybe_in, numbered, surely_not_in

MIN_TOKENS = 5
DEPTH = 3
SIMILAR = 0.8
#: Documents that a line has to stand in, and (document, sequence) pairs that a generalised template has to cover.
MIN_DOCS, MIN_COVERED = 2, 4
#: Sequences of a leaf that are compared with its templates one by one; templates of larger leaves are indexed.
BLOCK = 2000
ANY = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def masked(line: bytes) -> list[bytes] | None:
    """The line's tokens with variable fields marked, or None for a short line."""
    tokens = line.split()
    if len(tokens) < MIN_TOKENS:
        return None
    return [ANY if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def hashed(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) - (1 << 63)


def leaf_of(tokens: list[bytes]) -> int:
    return hashed([b"%d" % len(tokens), *tokens[:DEPTH]])


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def cluster(sequences: list[list[bytes]]) -> list[int]:
    """For each sequence, the number of the template it joins; all have equal lengths and come in the fixed order."""
    templates: list[list[bytes]] = []
    out = []
    for s in sequences:
        for k, t in enumerate(templates):
            # Places that are variable already are not counted as agreement unless enough fixed ones agree.
            if sum(x == y for x, y in zip(t, s)) >= SIMILAR * len(s):
                templates[k] = [x if x == y else ANY for x, y in zip(t, s)]
                break
        else:
            k = len(templates)
            templates.append(s)
        out.append(k)
    return out


class Templates:
    """cluster() for a leaf of any size: the templates so far, indexed by pieces of their places.

    What joins a template differs from it in n - need places at most, so that of n - need + 1 pieces of the places
    behind the leading tokens one at least is equal in both (pigeonhole). All templates with an equal piece are
    compared; a template that gets variable places is entered again under its new pieces.
    """

    ANY = xxhash.xxh3_64_intdigest(ANY)

    def __init__(self, n: int):
        self.need = math.ceil(SIMILAR * n)
        k = n - self.need + 1
        self.cuts = [DEPTH + (n - DEPTH) * i // k for i in range(k + 1)]
        self.rows = np.empty((64, n), np.uint64)
        self.heads = array("q")
        self.index: dict[int, array] = {}

    def keys(self, row: np.ndarray) -> list[int]:
        return [xxhash.xxh3_64_intdigest(row[a:b].tobytes(), seed=i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def join(self, h: int, tokens: list[bytes]) -> int:
        """Adds the next sequence and gives the hash of the first one in its template."""
        row = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
        keys = self.keys(row)
        some = [np.frombuffer(self.index[x], np.int32) for x in keys if x in self.index]
        some = np.unique(np.concatenate(some)) if some else np.empty(0, np.int32)
        for at in range(0, len(some), 1 << 14):
            part = some[at : at + (1 << 14)]
            fits = (self.rows[part] == row).sum(axis=1) >= self.need
            if fits.any():
                k = int(part[fits.argmax()])
                differs = self.rows[k] != row
                if differs.any():
                    before = set(self.keys(self.rows[k]))
                    self.rows[k][differs] = self.ANY
                    self.enter(k, [x for x in self.keys(self.rows[k]) if x not in before])
                return self.heads[k]
        k = len(self.heads)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[k] = row
        self.heads.append(h)
        self.enter(k, keys)
        return h

    def enter(self, k: int, keys: list[int]) -> None:
        for x in keys:
            self.index.setdefault(x, array("i")).append(k)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, leaf) of each distinct masked line of each row."""

    def run(ids, texts):
        rows = []
        for i, t in zip(ids, texts):
            seen = {}
            for line in lines_of(t):
                tokens = masked(line)
                if tokens is not None:
                    seen.setdefault(hashed(tokens), leaf_of(tokens))
            rows += [(i, h, leaf) for h, leaf in seen.items()]
        return dict(zip(("doc_id", "h", "leaf"), zip(*rows))) if rows else None

    return map_batches(docs.where("doc_id is not null"), ["doc_id", "text"], run, "doc_id long, h long, leaf long")


def line_tokens(docs: DataFrame) -> DataFrame:
    """(h, leaf, tokens) of each distinct masked line of each row."""

    def run(texts):
        rows = {}
        for t in texts:
            for line in lines_of(t):
                tokens = masked(line)
                if tokens is not None:
                    rows.setdefault(hashed(tokens), tokens)
        return {"h": list(rows), "leaf": [leaf_of(x) for x in rows.values()], "tokens": [b" ".join(x).decode("utf-8", "replace") for x in rows.values()]} if rows else None

    return map_batches(docs, ["text"], run, "h long, leaf long, tokens string")


TEMPLATES = "leaf long, h long, template long"


def _cluster_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "tokens"], ascending=[False, True], kind="stable")
    sequences = [t.encode().split(b" ") for t in pdf["tokens"]]
    group = cluster(sequences)
    head: dict[int, int] = {}
    for k, h in zip(group, pdf["h"]):
        head.setdefault(k, h)
    return pd.DataFrame({"leaf": pdf["leaf"], "h": pdf["h"], "template": [head[k] for k in group]})


def _stream_leaves(batches):
    """The same for whole leaves, one after the other, in the fixed order."""
    now, made = None, None
    for batch in batches:
        out = []
        for leaf, h, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
            tokens = tokens.encode().split(b" ")
            if leaf != now:
                now, made = leaf, Templates(len(tokens))
            out.append(made.join(h, tokens))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["leaf", "h", "template"])


def templates(lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, h, template) of the sequences of every leaf that could hold a generalised template. lines: (h, leaf, n, lo, hi)."""
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("size"), F.sum("n").alias("covered"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = scratch.write(leaves.where(f"size > 1 and covered >= {MIN_COVERED} and lo < hi").select("leaf", "size"))
    wanted = scratch.write(lines.join(leaves, "leaf").select("h", "leaf", "size", "n", "lo"))
    # A sequence's first document spells it; only such documents are read closely.
    some = maybe_in(docs, "doc_id", bitmap(wanted, "lo"))
    spelled = line_tokens(some).groupBy("h", "leaf").agg(F.first("tokens").alias("tokens"))
    spelled = scratch.write(wanted.drop("lo").join(spelled, ["h", "leaf"]))
    scratch.drop(leaves, wanted)
    small = spelled.where(F.col("size") <= BLOCK).groupBy("leaf").applyInPandas(_cluster_leaf, TEMPLATES)
    large = spelled.where(F.col("size") > BLOCK).repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "tokens", "h")
    return scratch.write(small.unionByName(large.select("leaf", "h", "tokens").mapInArrow(_stream_leaves, TEMPLATES)))


def dropped_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h) of the lines that documents lose."""
    found = scratch.write(line_hashes(docs).distinct())
    lines = scratch.write(found.groupBy("h", "leaf").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    of = templates(lines, docs, scratch)
    wide = lines.join(of, ["h", "leaf"]).groupBy("leaf", "template").agg(F.sum("n").alias("t_n"), F.min("lo").alias("t_lo"), F.max("hi").alias("t_hi"))
    wide = wide.where(f"t_n >= {MIN_COVERED} and t_lo < t_hi")
    general = of.join(wide, ["leaf", "template"]).select("h", "leaf", "t_lo")
    owner = lines.join(general, ["h", "leaf"], "left").select("h", "leaf", F.coalesce("t_lo", F.expr(f"if(n >= {MIN_DOCS}, lo, null)")).alias("owner"))
    owner = scratch.write(owner.where("owner is not null"))
    return found.join(owner, ["h", "leaf"]).where("doc_id > owner").select("doc_id", "h")


def drop_recurring_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs with the text's recurring lines dropped, and n_lines and n_dropped."""
    scratch = Scratch(docs.sparkSession)
    docs, names = numbered(docs, ["n_lines", "n_dropped"])
    key, text = names["doc_id"], names[text]
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lost = scratch.write(dropped_lines(narrow, scratch))
    bits = scratch.write(bitmap(lost, "doc_id"))
    scratch.keep_only(lost, bits)
    per_doc = lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("h").alias("_lost"))
    some = maybe_in(docs, key, bits).join(per_doc, key, "left").select(*docs.columns, "_lost")
    rest = surely_not_in(docs, key, bits)

    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long")
    rest = rest.withColumn("n_lines", lines).withColumn("n_dropped", F.lit(0).cast("long"))
    own = [c for c in docs.columns if c != text]
    some = map_batches(some.withColumn("n_lines", lines), [text, "_lost"], lambda t, gone: dict(zip((text, "n_dropped"), cut(t, gone))), f"{text} string, n_dropped long", carry=[*own, "n_lines"])
    out = some.select(*rest.columns).unionByName(rest)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "n_lines", "n_dropped")


def cut(texts: list, lost: list) -> tuple[list, list]:
    """The texts without their lost lines, and how many lines that were."""
    out, gone_lines = [], []
    for text, gone in zip(texts, lost):
        if text is None or gone is None:
            out.append(text)
            gone_lines.append(0)
            continue
        gone, lines = set(gone), lines_of(text)
        kept = [x for x in lines if (tokens := masked(x)) is None or hashed(tokens) not in gone]
        out.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
        gone_lines.append(len(lines) - len(kept))
    return out, gone_lines


def op2_line_templates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs)
