"""Near-duplicate documents by SuperMinHash.

1. Each text becomes its set of word shingles, hashed to 64 bits. Documents with equal sets form a class;
   its smallest doc_id stands for it from here on, so copies are never paired.
2. SuperMinHash: in step j each element puts j plus a random fraction at the next place of its own random
   permutation of the signature's places, and a place keeps its minimum. All places of an element have
   different ranks, which makes the variance lower than with independent hashes, and once every place holds
   less than j no later step can change it: long texts stop after a few steps.
3. Banding: ROWS places make a band's key. In each bucket, members are paired with the smallest one only.
4. Verification: pairs that sizes or one-bit sketches of the signatures leave possible are confirmed on
   the full sets of both texts.
5. Union-find groups what was confirmed. In buckets whose members then still lie in several components,
   every pair across components is settled too: small buckets give pairs as above; large ones are cut into
   blocks of bounded size, two blocks meet in a task by sketches first, then the texts of members with a
   possible partner meet, and only confirmed links come out. A pair is looked at in the first band that it shares. Groups are then formed again, so no pair of
   a bucket that could add a link is left out.

Null or empty text has an empty set and no links. A row without doc_id has no links, a null component_id and
is kept. Rows that share a doc_id count as one node, linked by each of their texts, and each keeps its row and the
size of its own set; the smallest doc_id of a group stays, so there are no ties. Very long texts: only the few bytes of their bands travel, and their text only
if they are candidates. Only doc_id and text are read, so other columns cannot clash. Empty input: empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import Scratch, arrow_rows, bitmap, map_batches, maybe_in
from seedsift.llm.components import components
from seedsift.llm.vocabulary import Memory

BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
WORDS, PERCENT = 5, 80
#: Of 96 one-bit places, pairs with similarity 0.8 agree in 86.4, with a deviation of 2.9: this is over six below.
LEAST_AGREEING = 68
#: Members up to which a bucket gives pairs, and members in a block of a larger one.
SMALL_BUCKET, BLOCK = 32, 1024
#: Shingles in a block on average.
BLOCK_SHINGLES = 1_000_000
#: Word hashes that a task remembers in each of two generations, and rows of a batch to Python.
REMEMBERED, BATCH = 50_000, 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads a counter-like input over all bits."""
    x = x + _ODD[0]
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, words: int):
        self.words, self.hashes = words, Memory(xxhash.xxh3_64_intdigest, REMEMBERED)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles; with fewer words, one hash of them all."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.words + 1)
        width = min(self.words, len(h))
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mixed(out * _ODD[1] + h[k : k + n])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, all at once: a row of PLACES values for each."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets)
    out = np.full((len(sets), PLACES), np.inf)
    flat = out.reshape(-1)
    order = None  # each element's permutation, shuffled one place a step
    for j in range(PLACES):
        x = _mixed(x)
        # The high bits give the fraction, others the place to swap with.
        fraction = (x >> np.uint64(12)).astype(np.float64) / 2.0**52
        pick = (j + ((x * _ODD[2]) >> np.uint64(33)) % np.uint64(PLACES - j)).astype(np.intp)
        if j == 0:
            place, first = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                order[rows, first], order[:, 0] = 0, first
            rows = np.arange(len(x))
            place = order[rows, pick]
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * PLACES + place, j + fraction)
        if j + 1 < PLACES:
            open_ = out.max(axis=1) >= j + 1
            keep = open_[owner]
            if not keep.any():
                break
            if not keep.all():
                x, owner = x[keep], owner[keep]
                first = first[keep] if order is None else first
                order = order if order is None else order[keep]
    return out


def set_key(s: np.ndarray) -> np.ndarray:
    """128 bits of a set, in two halves; the first one tells the texts of one document apart."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    """Of every row of (doc_id, text): set size, a key of the set in two halves, band keys and two sketches."""
    made: list[Shingler] = []
    bits = np.uint64(1) << np.arange(PLACES // 2, dtype=np.uint64)

    def run(ids, texts):
        if not made:
            made.append(Shingler(words))
        sets = [made[0].set_of(t) for t in texts]
        n = np.array([len(s) for s in sets])
        key = np.array([[0, 0] if not len(s) else set_key(s) for s in sets], np.int64)
        bands = np.zeros((len(sets), BANDS), np.uint64)
        sketch = np.zeros((len(sets), 2), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            values = signatures([sets[i] for i in full]).view(np.uint64)
            band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
            for r in range(ROWS):
                band = _mixed(band * _ODD[1] + values[:, r::ROWS])
            bands[full] = band
            low = _mixed(values) & np.uint64(1)
            sketch[full] = np.stack([(low[:, : PLACES // 2] * bits).sum(axis=1), (low[:, PLACES // 2 :] * bits).sum(axis=1)], axis=1)
        return {"doc_id": ids, "n": n, "k1": key[:, 0], "k2": key[:, 1], "s1": sketch[:, 0].view(np.int64), "s2": sketch[:, 1].view(np.int64), "bands": list(bands.view(np.int64))}

    schema = "doc_id long, n long, k1 long, k2 long, s1 long, s2 long, bands array<long>"
    return map_batches(docs, ["doc_id", "text"], run, schema, rows=128)


def _possible(n_a, n_b, s1_a, s1_b, s2_a, s2_b, percent: int):
    """Whether sizes and sketches leave a pair possible."""
    agreeing = PLACES - F.bit_count(F.col(s1_a).bitwiseXOR(F.col(s1_b))) - F.bit_count(F.col(s2_a).bitwiseXOR(F.col(s2_b)))
    least, most = F.least(F.col(n_a), F.col(n_b)), F.greatest(F.col(n_a), F.col(n_b))
    possible = 100 * least >= percent * most
    return possible & (agreeing >= LEAST_AGREEING) if percent >= 80 else possible


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, ka, b, kb) whose full sets meet the threshold, as edges (u, v). Of several texts of a document the one with the set's key counts."""
    made: list = []

    def run(a, keys_a, texts_a, b, keys_b, texts_b):
        if not made:
            made.extend((Shingler(words), {}))
        shingler, last = made
        u, v = [], []
        for i, ki, s, j, kj, t in zip(a, keys_a, texts_a, b, keys_b, texts_b):
            if last.get("text") != s:
                found = shingler.set_of(s)
                last.update(text=s, set=found, key=set_key(found)[0])
            if last["key"] != ki:
                continue
            mine, other = last["set"], shingler.set_of(t)
            if set_key(other)[0] != kj:
                continue
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= percent * (len(mine) + len(other) - both):
                u.append(i)
                v.append(j)
        return {"u": u, "v": v}

    first = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    some = maybe_in(second, "b", bitmap(pairs, "b"))
    wide = pairs.join(some, "b")
    wide = wide.join(maybe_in(first, "a", bitmap(pairs, "a")), "a")
    return map_batches(wide, ["a", "ka", "text_a", "b", "kb", "text_b"], run, "u long, v long", rows=64)


def block_links(members: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links (u, v) across components inside large buckets, two blocks of a bucket at a time.

    Blocks meet twice. First only sizes, sketches and bands travel, and say which members have a possible partner in
    the other block; then those members' texts do. A block holds BLOCK members and BLOCK_SHINGLES shingles on average.
    """
    bits = scratch.write(bitmap(members, "id"))
    known = scratch.write(members.join(maybe_in(reps, "id", bits), ["id", "k"]))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    counted = known.groupBy("bucket").agg(F.sum("n").alias("weight"))
    dealt = known.join(counted, "bucket").withColumn("own", F.pmod(F.xxhash64("id", "k"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "m", "weight")

    def partners(pdf):
        """Of each member of the first block: the members of the second one that sizes, sketches and earlier bands leave possible."""
        band, (sizes, comp, own) = int(pdf["band"].iloc[0]), (pdf[c].to_numpy() for c in ("n", "c", "own"))
        before = np.stack(pdf["bands"].to_numpy())[:, :band]
        sketch = np.stack([pdf["s1"].to_numpy(), pdf["s2"].to_numpy()], axis=1).view(np.uint64)
        second = np.flatnonzero(own == pdf["y"].iloc[0])
        for i in np.flatnonzero(own == pdf["x"].iloc[0]):
            j = second[(comp[second] != comp[i]) & (100 * np.minimum(sizes[second], sizes[i]) >= percent * np.maximum(sizes[second], sizes[i]))]
            j = j[PLACES - np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64) >= LEAST_AGREEING] if percent >= 80 else j
            j = j[~(before[j] == before[i]).any(axis=1)]
            if len(j):
                yield i, j

    def meet(pdf):
        pdf = pdf.drop_duplicates(["id", "k"])
        some = np.zeros(len(pdf), bool)
        for i, j in partners(pdf):
            some[i] = some[j] = True
        return pdf.loc[some, ["bucket", "x", "y", "id", "k"]]

    def settle(pdf):
        shingler = Shingler(words)
        sets = [shingler.set_of(t) for t in pdf["text"]]
        kept = np.array([i for i, (s, k) in enumerate(zip(sets, pdf["k"])) if len(s) and set_key(s)[0] == k], np.intp)
        kept = kept[~pdf[["id", "k"]].iloc[kept].duplicated().to_numpy()]
        pdf, sets = pdf.iloc[kept], [sets[i] for i in kept]
        ids, sizes = pdf["id"].to_numpy(), np.array([len(s) for s in sets])
        u, v = [], []
        for i, j in partners(pdf):
            all_of = np.concatenate([sets[k] for k in j])
            at = np.minimum(np.searchsorted(sets[i], all_of), sizes[i] - 1)
            both = np.add.reduceat(sets[i][at] == all_of, np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
            good = j[100 * both >= percent * (sizes[j] + sizes[i] - both)]
            u += [ids[i]] * len(good)
            v += list(ids[good])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    wanted = scratch.write(dealt.groupBy("bucket", "x", "y").applyInPandas(meet, "bucket long, x int, y int, id long, k long"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    few = maybe_in(texts, "id", bitmap(wanted, "id"))
    return dealt.join(wanted, ["bucket", "x", "y", "id", "k"]).join(few, "id").groupBy("bucket", "x", "y").applyInPandas(settle, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    feats = scratch.write(features(docs, words))
    classes = scratch.write(feats.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    small = percent / (100 - percent) if percent < 100 else float("inf")  # smaller sets link to equal ones only
    chosen = feats.where(F.col("n") >= small).join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2"], "left_semi")
    reps = scratch.write(chosen.dropDuplicates(["doc_id", "k1", "k2"]).withColumnsRenamed({"doc_id": "id", "k1": "k"}).drop("k2"))
    sketches = reps.select("id", "k", "n", "s1", "s2")
    members = reps.select("id", "k", F.posexplode("bands").alias("band", "bucket"))
    heads = members.groupBy("bucket").agg(F.min(F.struct("id", "k")).alias("h"), F.max("id").alias("z"), F.count("*").alias("m")).where("h.id < z")
    shared = scratch.write(members.join(heads.select("bucket", F.col("h.id").alias("a"), F.col("h.k").alias("ka"), "m"), "bucket"))
    stars = shared.where("id > a").select("a", "ka", F.col("id").alias("b"), F.col("k").alias("kb")).distinct()
    named = lambda side: sketches.select(F.col("id").alias(side), F.col("k").alias(f"k{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "s1", "s2")))
    stars = stars.join(named("a"), ["a", "ka"]).join(named("b"), ["b", "kb"])
    fit = _possible("n_a", "n_b", "s1_a", "s1_b", "s2_a", "s2_b", percent)
    pair = ["a", "ka", "b", "kb"]
    tried = scratch.write(stars.where(fit).select(*pair).distinct())
    # A document with several texts is one node: its own id and the ids that stand for its texts belong together.
    several = feats.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo <> hi").select("doc_id")
    own = feats.select("doc_id", "k1", "k2").join(several, "doc_id", "left_semi").join(classes, ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = scratch.write(confirm(tried, docs, words, percent).unionByName(own))
    groups = scratch.write(components(edges, scratch))

    placed = shared.join(groups, shared["id"] == groups["node"], "left").select("bucket", "band", "m", "id", "k", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    left = scratch.write(placed.join(mixed, "bucket"))
    scratch.drop(shared)
    few = left.where(F.col("m") <= SMALL_BUCKET).join(sketches, ["id", "k"])
    one, two = (few.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "k", "n", "s1", "s2", "c"))) for s in ("a", "b"))
    across = one.join(two, "bucket").where((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & fit)
    across = scratch.write(across.select(*(F.col(f"{c}_{s}").alias(x) for c, s, x in zip(("id", "k") * 2, "aabb", pair))).distinct().join(tried, pair, "left_anti"))
    more, many = confirm(across, docs, words, percent), left.where(F.col("m") > SMALL_BUCKET)
    if not many.isEmpty():
        more = more.unionByName(block_links(many, reps, docs, words, percent, scratch))
    more = scratch.write(more)
    scratch.drop(left, reps, across, tried)
    if not more.isEmpty():
        groups = scratch.write(components(edges.unionByName(more), scratch))
    of_class = feats.drop("bands", "s1", "s2").join(classes, ["k1", "k2"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = of_class.join(groups, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = scratch.write(out)
    scratch.keep_only(out)
    return out


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


OP1_SQL = r"""
with recursive d as (select doc_id, row_number() over () as r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, r, g from (select doc_id, r, unnest(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) when len(ws) = 1 then ws else [] end) as g from d)),
n as (select r, count(*) as n from s group by r),
p as (select a.doc_id as a, b.doc_id as b, a.r as ra, b.r as rb, count(*) as n_both from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select distinct a, b from p join n x on x.r = ra join n y on y.r = rb where 100 * n_both >= 80 * (x.n + y.n - n_both)),
r(doc_id, other) as (select distinct doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join n on n.r = d.r left join c on c.doc_id = d.doc_id
"""
