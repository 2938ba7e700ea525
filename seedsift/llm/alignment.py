"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by a byte-level BPE (A, over a space and the text) and by a piece model (B, which adds
that space itself). Where the bytes of both are the text's, tokens become sparse incidence matrices in CSR
form, built by hand: rows are token occurrences, columns are bytes (all of a token's, or only its last) or
groups, the runs between byte offsets where tokens of both end. Gustavson's row products of A's matrix with
the transposed one of B give the links: which tokens overlap, end together, or share a group.

Texts are aligned in chunks of bounded bytes, so a task holds few of them. Counts of id pairs over the corpus
go block by block: a task numbers the id pairs it meets (at most PAIRS, then a new block starts), documents
keep the numbers, and only the blocks' distinct pairs are shuffled, summed, and sent back to their block. So a
pair that stands in every document is one row a block, not one a document.

Null and empty texts, and those whose bytes do not come back (a text that holds U+2581 itself, say), have no
tokens: zeros and an empty string. Repeated rows are aligned one by one and each counts in the corpus. Ties
for a B id's highest count are all best. Very long texts take time and memory in proportion. Only doc_id and
text are read, so other columns cannot clash. Empty input: empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seedsift.llm.common import Scratch, table
from seedsift.llm.vocabulary import byte_letters

#: Distinct id pairs of a block, and bytes of texts aligned at once (a longer text goes alone): both bound a task's memory.
PAIRS, CHUNK_BYTES = 1 << 20, 1 << 19


class Csr(NamedTuple):
    """A sparse matrix of zeros and ones: the columns of row i are columns[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def from_pairs(rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
    """The matrix with ones at these places; rows ascend."""
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=height)))), columns, width)


def transposed(m: Csr) -> Csr:
    """Rows and columns exchanged."""
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    if (m.columns[1:] >= m.columns[:-1]).all():
        return from_pairs(m.columns, rows, m.width, len(m.starts) - 1)
    order = np.argsort(m.columns, kind="stable")
    return from_pairs(m.columns[order], rows[order], m.width, len(m.starts) - 1)


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a·b by Gustavson: row i is the sum of the rows of b that row i of a names."""
    size = np.diff(b.starts)[a.columns]
    first = np.cumsum(size) - size
    where = np.arange(int(size.sum())) + np.repeat(b.starts[a.columns] - first, size)
    key = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), size) * np.int64(b.width) + b.columns[where]
    if len(key) and not (key[1:] >= key[:-1]).all():
        key = np.sort(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    values = np.diff(np.append(new, len(key)))
    return key[new] // b.width, key[new] % b.width, values


def bytes_of(size: np.ndarray, n_bytes: int) -> Csr:
    """Tokens by all their bytes, from their sizes in order."""
    return Csr(np.concatenate(([0], np.cumsum(size))), np.arange(n_bytes), n_bytes)


def last_bytes_of(size: np.ndarray, n_bytes: int) -> Csr:
    """Tokens by their last byte."""
    return Csr(np.arange(len(size) + 1), np.cumsum(size) - 1, n_bytes)


class Alignment(NamedTuple):
    """Token occurrences of both sides are numbered from 0; a link is a pair of such numbers."""

    cuts: np.ndarray  # offsets where tokens of both sides end
    a_group: np.ndarray
    b_group: np.ndarray
    ends: tuple[np.ndarray, np.ndarray]  # links of tokens that end together
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # links of tokens that overlap, with the bytes they share
    shared: tuple[np.ndarray, np.ndarray]  # links of tokens of one group


def align(a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Aligns two rows of tokens, given by their sizes, over the same bytes."""
    n = int(a_size.sum())
    a_end, b_end = np.cumsum(a_size, dtype=np.int64), np.cumsum(b_size, dtype=np.int64)
    ended = np.zeros(n + 1, bool)
    ended[a_end] = True
    cuts = b_end[ended[b_end]]
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    by_group = [from_pairs(np.arange(len(g)), g, len(g), len(cuts)) for g in (a_group, b_group)]
    ends = product(last_bytes_of(a_size, n), transposed(last_bytes_of(b_size, n)))
    overlaps = product(bytes_of(a_size, n), transposed(bytes_of(b_size, n)))
    shared = product(by_group[0], transposed(by_group[1]))
    return Alignment(cuts, a_group, b_group, ends[:2], overlaps, shared[:2])


#: Fixed value: the pattern for pre-tokens that the byte-level file asks for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Side:
    """The bytes and decimal names of a tokenizer's ids."""

    def __init__(self, tokens: list[bytes], inside: str, after: str):
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.inside, self.after = (np.array([f"{i}{x}" for i in range(len(tokens))], object) for x in (inside, after))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids].astype(np.int64)
        first = np.cumsum(size) - size
        return self.blob[np.arange(int(size.sum())) + np.repeat(self.start[ids] - first, size)].tobytes()


class Encoders:
    """Both tokenizers. The byte-level file's merges are in the order of its ids, so its vocabulary alone gives the ranks."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        letters = {c: i for i, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in ids.items()}
        self.a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        tokens = [b""] * (max(ids.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.sides = _Side(tokens, ",", "|"), _Side([self._piece(i) for i in range(self.b.get_piece_size())], ",", ";")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts and how many each text has; none where the bytes of one side are not the text's."""
        coded = [self.a.encode_ordinary(f" {t}") for t in texts], self.b.encode(texts, num_threads=1)
        n = [np.fromiter(map(len, c), np.int64, len(texts)) for c in coded]
        ids = [np.fromiter(itertools.chain.from_iterable(c), np.int64, int(k.sum())) for c, k in zip(coded, n)]
        raw = [f" {t}".encode() if t else b"" for t in texts]
        good = np.fromiter(map(bool, raw), bool, len(texts))
        for side, i, k in zip(self.sides, ids, n):
            said, size = side.bytes_of(i), np.bincount(np.repeat(np.arange(len(texts)), k), side.size[i], len(texts)).astype(int)
            good &= [said[stop - z : stop] == r for r, stop, z in zip(raw, np.cumsum(size).tolist(), size.tolist())]
        return [(i[np.repeat(good, k)], np.where(good, k, 0)) for i, k in zip(ids, n)]


@functools.lru_cache(maxsize=1)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of the texts with at most CHUNK_BYTES characters, or one text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def aligned_texts(e: Encoders, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Counts and hash of each text, the id pairs (A's id << 32 | B's id) of all links of tokens that end together, and where each text's begin."""
    (a, n_a), (b, n_b) = e.encode([t or "" for t in texts])
    al = align(e.sides[0].size[a], e.sides[1].size[b])  # texts end at cuts, so no group or link crosses them
    a_doc = np.repeat(np.arange(len(texts)), n_a)
    group_doc = np.zeros(len(al.cuts), np.int64)
    group_doc[al.a_group] = a_doc
    parts, order = _spelled(e, a, b, al)
    stops = np.cumsum(n_a + n_b)
    rows = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=len(texts))}
    for name, links in (("n_links", al.ends), ("n_overlaps", al.overlaps), ("n_shared", al.shared)):
        rows[name] = np.bincount(a_doc[links[0]], minlength=len(texts))
    hashes = []
    for stop, n in zip(stops, n_a + n_b):
        hashes.append(hashlib.sha256("".join(parts[order[stop - n : stop]])[:-1].encode()).hexdigest() if n else "")
    rows["groups_sha256"] = hashes
    return rows, a[al.ends[0]] << 32 | b[al.ends[1]], np.concatenate(([0], np.cumsum(rows["n_links"])))


def _spelled(e: Encoders, a: np.ndarray, b: np.ndarray, al: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """Each token's id with the separator after it, and the order that puts each group's A tokens before its B tokens."""
    parts = []
    for side, ids, group in zip(e.sides, (a, b), (al.a_group, al.b_group)):
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        parts.append(np.where(last, side.after[ids], side.inside[ids]))
    order = np.argsort(np.concatenate((al.a_group * 2, al.b_group * 2 + 1)), kind="stable")
    return np.concatenate(parts), order


COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups_sha256 string"
#: A document's row has its links as numbers of the block's pairs; a pair's row its number, the pair and how many links of the block hold it.
BLOCKS = f"block long, kind int, doc_id long, {COUNTS}, links array<int>, pair long, n long"


class _Block:
    """Numbers of the id pairs met so far, and how often each was."""

    def __init__(self):
        self.pairs, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sorted, self.number = self.pairs, self.pairs

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """The pairs' numbers; new ones get the next."""
        found, back, n = np.unique(pairs, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.sorted, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.sorted)
        known[inside] = self.sorted[at[inside]] == found[inside]
        number = np.empty(len(found), np.int64)
        number[known] = self.number[at[known]]
        fresh = found[~known]
        number[~known] = np.arange(len(self.pairs), len(self.pairs) + len(fresh))
        self.sorted = np.insert(self.sorted, at[~known], fresh)
        self.number = np.insert(self.number, at[~known], number[~known])
        self.pairs, self.count = np.concatenate((self.pairs, fresh)), np.concatenate((self.count, np.zeros(len(fresh), np.int64)))
        self.count[number] += n
        return number[back].astype(np.int32)


def _batch(schema: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def blocks(docs: DataFrame, a_path: str, b_path: str, rows: int = 64, most_pairs: int = PAIRS) -> DataFrame:
    """The aligned documents and the id pairs of each block, as rows of two kinds."""
    schema = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def pairs_of(block: _Block, name: int) -> pa.RecordBatch:
        n = len(block.pairs)
        return _batch(schema, n, block=[name] * n, kind=[0] * n, links=[[i] for i in range(n)], pair=block.pairs, n=block.count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, block, name = encoders(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, texts = (batch.column(i).slice(at, rows).to_pylist() for i in (0, 1))
                for lo, hi in chunks(texts):
                    made, pairs, starts = aligned_texts(e, texts[lo:hi])
                    links = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(block.add(pairs)))
                    yield _batch(schema, hi - lo, block=[name] * (hi - lo), kind=[1] * (hi - lo), doc_id=ids[lo:hi], links=links.cast(schema.field("links").type), **made)
                    if len(block.pairs) > most_pairs:
                        yield pairs_of(block, name)
                        block, name = _Block(), name + 1
        yield pairs_of(block, name)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): in how many links of the corpus each id pair stands, and whether no pair of its B id stands in more."""
    pairs = made.where("kind = 0").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.expr("pair & 4294967295L"))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


ALIGNED = f"doc_id long, {COUNTS}, n_best long, count_sum long"


def align_documents(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = PAIRS) -> DataFrame:
    """One row for each row of (doc_id, text): tokens, groups, links by kind, and what the links' id pairs count over the corpus."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.write(blocks(docs, a_path, b_path, most_pairs=most_pairs))
    known = made.where("kind = 0").select("block", F.col("links")[0].alias("number"), "pair").join(pair_counts(made), "pair")
    lookups = known.select("block", F.lit(0).alias("kind"), "number", "n", "best")
    rows = made.where("kind = 1").drop("pair", "n").unionByName(lookups, allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")
    schema = to_arrow_schema(T.StructType.fromDDL(ALIGNED))
    kept = ["doc_id", *(c.split()[0] for c in COUNTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n, best = None, [], [], []
        tables = None
        for batch in batches:
            block, kind = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi in _runs(block, kind):
                part = batch.slice(lo, hi - lo)
                if block[lo] != now:
                    now, number, n, best, tables = block[lo], [], [], [], None
                if kind[lo] == 0:
                    for into, c in ((number, "number"), (n, "n"), (best, "best")):
                        into.append(part.column(c).to_numpy(zero_copy_only=False))
                    continue
                if tables is None:
                    at = np.concatenate(number) if number else np.zeros(0, np.int64)
                    tables = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    if number:
                        tables[0][at], tables[1][at] = np.concatenate(n), np.concatenate(best)
                links = part.column("links")
                flat, size = links.flatten().to_numpy(), np.diff(links.offsets.to_numpy())
                doc = np.repeat(np.arange(hi - lo), size)
                sums = [np.zeros(hi - lo, np.int64) for _ in tables]
                for total, values in zip(sums, tables):
                    np.add.at(total, doc, values[flat])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sums[1]), pa.array(sums[0])], schema=schema)

    chosen = ["block", "kind", *kept, "links", "number", "n", "best"]
    return dealt.select(*chosen).mapInArrow(run, ALIGNED)


def _runs(block: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows of one block and kind."""
    if not len(block):
        return
    stops = [*(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1), len(block)]
    yield from zip([0, *stops[:-1]], stops)


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
