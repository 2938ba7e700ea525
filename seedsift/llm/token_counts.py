"""Token counts of whole texts, without encoding most of them.

Offline, once per worker, the merges of every vocabulary string that ends a word are run: those that end in
one token are proven to encode alone. A pre-token among them counts as one directly; only the rest are
merged, long ones through a heap, and their counts remembered up to a bound.

Null or empty text: 0 bytes, 0 tokens, not over the limit. Repeated rows are counted one by one; merges of
one rank go leftmost first. Very long texts and pre-tokens take time n log n and memory in proportion. Only
doc_id and text are read, so other columns cannot clash. Empty input: empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from seedsift.llm.common import map_batches
from seedsift.llm.vocabulary import Memory, load

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.chunk = Memory(self._chunk)

    def _chunk(self, chunk: str) -> int:
        """A pre-token is its own only part, so one memory serves both."""
        parts = self.vocabulary.parts(chunk)
        if len(parts) != 1:
            return sum(map(self.chunk.__getitem__, parts))
        spelled = self.vocabulary.spelled(parts[0])
        return 1 if spelled in self.vocabulary.singles else len(self.vocabulary.merged(spelled))

    def count(self, text: str) -> int:
        n = 0
        for piece, special in self.vocabulary.segments(text):
            n += 1 if special is not None else sum(map(self.chunk.__getitem__, self.vocabulary.chunks(piece)))
        return n


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, tokens and whether they exceed the limit, for every row of (doc_id, text)."""

    def run(ids, texts):
        c = counter(path)
        n = [c.count(t or "") for t in texts]
        return {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(docs, ["doc_id", "text"], run, SCHEMA)


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
