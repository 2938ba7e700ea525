"""BPE encoding and decoding of whole texts.

Encoding backtracks: one pass of an Aho-Corasick automaton over a pre-token gives the longest token that
starts at each place, and a table gives the next shorter token that is a prefix of it; a token is taken if it
is compatible with the one before, that is if the merges of the two side by side would keep both. What a pair
of tokens was found to be is kept in a table of bounded size. Each place and token is tried once, so the work
is linear in the text, and the result is what the merges give, exactly. Pre-tokens recur, so their results are
remembered up to a bound.

Decoding gathers slices of one blob of token strings by a table of offsets.

Null or empty text: no tokens, the hashes of no bytes. Repeated rows are encoded one by one; there are no
ties, because the merges have one order. Very long texts and pre-tokens take time and memory in proportion
to their length. Only doc_id and text (or ids) are read, so other columns cannot clash. Empty input: empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from seedsift.llm.common import map_batches
from seedsift.llm.vocabulary import Memory, Vocabulary, load

#: Pairs of tokens in the compatibility table; beyond, it starts anew before the next pre-token.
PAIRS = 1 << 18
#: Chunks and pre-tokens remembered in each of two generations: half of what counting remembers, as their ids take more bytes.
CHUNKS = 100_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Encodes pre-tokens. In its patterns one private letter, the mark, stands for the word end."""

    mark = "\ue000"

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        plain = [t.removesuffix(v.end) + self.mark if t.endswith(v.end) else t for t in v.tokens]
        self.trie = ahocorasick.Automaton()
        #: Tokens of one letter stand at every place; the automaton holds the longer ones.
        self.letter = {plain[i]: i for i in v.ids.values() if len(plain[i]) == 1}
        for i in v.ids.values():
            if len(plain[i]) > 1:
                self.trie.add_word(plain[i], i)
        self.trie.make_automaton()
        self.size = [len(t) for t in plain]
        #: The longest proper prefix of each token that is a token too, or -1.
        self.shorter = [-1] * len(plain)
        by_text = {plain[i]: i for i in v.ids.values()}
        for i in v.ids.values():
            t = plain[i]
            self.shorter[i] = next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1)
        self.good: dict[int, bool] = {}
        self.single = v.singles

    def _compatible(self, a: int, b: int) -> bool:
        """Undoes the later of the two tokens' merges, again and again: no pair across the border may have merged before it was undone."""
        pairs, split = self.vocabulary.pairs, self.vocabulary.split
        before = len(split)  # a merge across the border with a lower id than this would have come first
        while True:
            if pairs.get((a, b), before) < before:
                return False
            whole_a, whole_b = split[a] == (a, a), split[b] == (b, b)
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, split[a][1]
            else:
                before, b = b + 1, split[b][0]

    def longest(self, text: str) -> list[int]:
        """The longest token that starts at each place, or -1, from one pass of the automaton."""
        out, size = [*map(self.letter.get, text[:-1]), -1, -1], self.size
        for last, token in self.trie.iter(text):
            out[last + 1 - size[token]] = token  # of one start, longer tokens end later
        return out

    def part(self, spelled: str) -> list[int]:
        """The tokens of one pre-token."""
        if spelled in self.single:
            return [self.single[spelled]]
        text, good, shorter, size = spelled + self.mark, self.good, self.shorter, self.size
        if len(good) > PAIRS:
            good.clear()
        longest = self.longest(text)
        stop = len(text)
        open_ = [True] * (stop + 1)  # places from where the rest may still be covered
        open_[stop - 1] = False  # the mark alone is no token
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if open_[end]:
                    if not out:
                        break
                    key = out[-1] << 20 | token
                    fits = good.get(key)
                    if fits is None:
                        fits = good[key] = self._compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == stop:
                    return out
                at, token = end, longest[end]
            else:
                open_[at] = False
                token = out.pop()
                at -= size[token]
                token = shorter[token]


class Codec:
    """Encodes texts and decodes ids; remembers the ids of chunks and of their pre-tokens as bytes, in one memory: a pre-token is its own only part."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.encoder = Encoder(self.vocabulary)
        self.chunk = Memory(self._chunk, CHUNKS)
        strings = [(t + " ").encode() for t in self.vocabulary.tokens]
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)

    def _part(self, part: str) -> bytes:
        found = self.encoder.part(part if part.isalpha() and part.isascii() else self.vocabulary.spelled(part))
        return struct.pack(f"<{len(found)}I", *found)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii():
            return self._part(chunk)
        parts = self.vocabulary.parts(chunk)
        return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self.chunk.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece, special in self.vocabulary.segments(text):
            if special is None:
                out.extend(map(self.chunk.__getitem__, self.vocabulary.chunks(piece)))
            else:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The token strings joined by blanks, in UTF-8: what a file without a decoder gives."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        size = self.offsets[i + 1] - self.offsets[i]
        first = np.cumsum(size) - size
        where = np.arange(first[-1] + size[-1]) + np.repeat(self.offsets[i] - first, size)
        return self.blob[where].tobytes()[:-1]


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token count, and the hashes of ids and of the decoded text, of every row of (doc_id, text)."""

    def run(ids, texts):
        c, rows = codec(path), []
        for t in texts:
            got = c.encode(t or "")
            rows.append((len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(c.decode(got)).hexdigest()))
        return {"doc_id": ids} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows)))

    return map_batches(docs, ["doc_id", "text"], run, SCHEMA)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row of (doc_id, text)."""

    def run(ids, texts):
        c = codec(path)
        return {"doc_id": ids, "ids": [np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32) for t in texts]}

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, ids array<int>")


def detokenize(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of every row of (doc_id, ids); null ids decode to empty text."""

    def run(ids, tokens):
        c = codec(path)
        return {"doc_id": ids, "text": [c.decode(np.array(t or [], "<u4").tobytes()).decode() for t in tokens]}

    return map_batches(rows, ["doc_id", "ids"], run, "doc_id long, text string")


def op6_bpe_codec(spark, sf_dir):
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
