"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed terms: its lower-cased words, the shapes of its words (upper, lower,
digits, other marks) and immediate repetitions, damped, weighted by inverse document frequency and brought
to unit length. A truncated SVD of a bounded labelled sample gives the latent space; the sample's vectors are
broadcast (size: SAMPLE rows times DIMS), exact cosines to all of them are computed block by block for every
document, and the nearest ones vote with their similarity as weight. Only the text enters a score. The sample
stays sparse in the driver and is spread out a block of rows at a time.

Null or empty text, and text without any known direction: score 0. Ties in similarity beyond the last voter go
to any of the tied rows. Repeated rows get equal scores; a document labelled twice counts by its higher label.
Very long texts: one row of TERMS counts each, whatever their length. Columns of docs named score or predicted
are replaced, all others stay. With no labels at all every score is 0; no documents, no scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import map_batches
from seedsift.llm.vocabulary import Memory

#: Labelled rows that the classifier is fitted on at most, the ones with the smallest hashes of doc_id.
SAMPLE = 6000
TERMS = 4096
SHAPES = 512
DIMS = 64
VOTERS = 25
THRESHOLD = 0.3

_RUNS = re.compile(rb"A+|a+|0+")
_CLASSES = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


def _term(word: bytes) -> int:
    """A word's slot and its shape's slot, packed."""
    shape = _RUNS.sub(lambda m: m[0][:2], word.translate(_CLASSES))
    bare = word.lower().strip(b".,;:!?#$%&*|<>()\"'")
    return (SHAPES + 1 + zlib.crc32(bare) % (TERMS - SHAPES - 1)) << 16 | zlib.crc32(shape[:24]) % SHAPES


class Counter:
    """Term counts of texts."""

    def __init__(self):
        self.terms = Memory(_term)

    def counts(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        packed = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
        out = np.bincount(packed >> 16, minlength=TERMS).astype(np.float32)
        out += np.bincount(packed & 0xFFFF, minlength=TERMS)
        out[SHAPES] = np.count_nonzero(packed[1:] == packed[:-1])  # immediate repetitions
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


class Rows:
    """Sparse rows of counts: slots and values of all rows, and where each row starts."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
        self.slots, self.values, self.starts = slots, values, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def blocks(self, size: int = 512):
        """Dense blocks of rows."""
        for at in range(0, len(self), size):
            starts = self.starts[at : at + size + 1]
            out = np.zeros((len(starts) - 1, TERMS), np.float32)
            part = slice(starts[0], starts[-1])
            out[np.repeat(np.arange(len(out)), np.diff(starts)), self.slots[part]] = self.values[part]
            yield out


class Model:
    """idf, projection, the sample's unit vectors and labels."""

    def __init__(self, rows: Rows, labels: np.ndarray):
        n = len(rows)
        self.idf = np.log((1 + max(n, 1)) / (1 + np.bincount(rows.slots, minlength=TERMS))).astype(np.float32) + 1
        k = min(DIMS, n)
        self.projection = np.zeros((TERMS, max(k, 1)), np.float32)
        if n:
            base = np.random.default_rng(0).standard_normal((TERMS, k + 16)).astype(np.float32)
            for _ in range(4):  # randomised SVD by power iterations
                base = np.linalg.qr(sum(x.T @ (x @ base) for x in map(self._weighted, rows.blocks())))[0]
            _, _, right = np.linalg.svd(np.concatenate([self._weighted(x) @ base for x in rows.blocks()]), full_matrices=False)
            self.projection = np.ascontiguousarray((base @ right.T)[:, :k], np.float32)
        self.vectors = np.concatenate([np.zeros((0, self.projection.shape[1]), np.float32), *(_unit(self._weighted(x) @ self.projection) for x in rows.blocks())])
        self.labels = labels.astype(np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        """In place of the counts, to spare memory."""
        np.log1p(counts, out=counts)
        counts *= self.idf
        size = np.linalg.norm(counts, axis=1, keepdims=True)
        counts /= np.where(size > 1e-12, size, 1)
        return counts

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(counts))
        similar = _unit(self._weighted(counts) @ self.projection) @ self.vectors.T
        k = min(VOTERS, len(self.labels))
        best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, best, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        votes = (weight * self.labels[best]).sum(axis=1)
        return np.clip(np.divide(votes, total, out=np.zeros_like(votes), where=total > 1e-12), 0, 1)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample labelled rows that are not held out. labels: (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(ids, texts, quality):
        made = Counter()
        rows = [made.counts(t) for t in texts]
        slots = [np.flatnonzero(r).astype(np.int32) for r in rows]
        return {"doc_id": ids, "quality": quality, "slots": slots, "counts": [r[s] for r, s in zip(rows, slots)]}

    schema = "doc_id long, quality int, slots array<int>, counts array<float>"
    texts = texts.withColumn("quality", F.col("quality").cast("int"))
    table = map_batches(texts, ["doc_id", "text", "quality"], run, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return Model(Rows(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)), np.zeros(0))
    # In the order of doc_id, so that a fit does not depend on how rows are dealt.
    table = table.sort_by("doc_id").combine_chunks()
    slots, values = table["slots"].chunk(0), table["counts"].chunk(0)
    rows = Rows(slots.flatten().to_numpy(), values.flatten().to_numpy(), slots.offsets.to_numpy().astype(np.int64) - slots.offsets[0].as_py())
    return Model(rows, table["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted of every row's text."""
    sent, made = docs.sparkSession.sparkContext.broadcast(model), []

    def run(texts):
        if not made:
            made.append(Counter())
        rows = np.stack([made[0].counts(t) for t in texts])
        known = rows.any(axis=1)
        return {"score": np.where(known, sent.value.score(rows), 0.0)}

    own = [c for c in docs.columns if c not in ("score", "predicted")]
    out = map_batches(docs, ["text"], run, "score double", rows=256, carry=own)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_knn(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
