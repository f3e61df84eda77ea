"""Near-duplicate documents (operator 3), by SetSketch registers (Ertl, 2021) and exact confirmation.

A document's set has its distinct word shingles.  Register i of its sketch is floor(1 - log_b(m_i)) clipped to
16 bits, m_i being the least of the i-th hash over the set as a fraction of one: exponentially spaced,
truncated minima, which merge by maximum and agree on two sets with about the probability of their Jaccard
similarity.  The steps:

1. One Arrow pass makes set hash and sketch of each document.  Documents of one set collapse to the least id.
2. Sketches are cut in bands of ROWS registers; equal bands put documents in one bucket.  No bucket is
   expanded into pairs: in each of ROUNDS rounds every remaining member is tied to the bucket's leader if the
   joint likelihood of their registers puts their similarity at LOOSE or more, and leaves the bucket at
   CLOSE or more.  By the triangle inequality of the Jaccard distance a document that is linked with one that
   left at CLOSE is similar enough to the leader to be tied to it.  What remains after the last round is
   tied to its leader unconditionally.  Components of the ties are families: supersets of what links can join.
3. Families' full sets are compared exactly, by inverted lists within blocks of BLOCK members.  In a family of
   more blocks, the members linked with the family's first document are set apart: they need not meet one another,
   only the blocks of the others, if there are any.  A block, or pair of blocks, gives a spanning forest of its links; components follow.

Null and empty texts and texts without words have n_shingles 0 and are linked with nothing.  Rows with one
doc_id count as one document whose set is that of the row of least set hash.  Rows without doc_id are kept and linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltql.llm import hashing as H
from basaltql.llm.common import Scratch, arrow_pass, id_and_text, spread_join, without_ids
from basaltql.llm.components import connected_components

REGISTERS, ROWS, BASE = 96, 4, 1.02
BANDS = REGISTERS // ROWS
#: Ties and departures by estimated similarity; with 96 registers an estimate's error is about 0.045.
LOOSE, CLOSE, ROUNDS = 0.4, 0.75, 3
#: Families are compared in blocks of so many members.
BLOCK = 1024
#: Bits of the table of ids by which a scan skips texts in no family; when it fills up it skips none, and all stays right.
FILTER_BITS = 1 << 23

_rng = np.random.Generator(np.random.PCG64(3_141_592))
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.int64).astype(np.uint64)
_ODD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_GRID = np.linspace(0.0, 1.0, 51)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sketches (uint16, one row each) of the non-empty sets that begin at starts in values."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat(((values ^ _XOR[i]) * _ODD[i]) >> np.uint64(32), starts)
        out[:, i] = np.clip(np.floor(1 - np.log((least + 1.0) / 2.0**32) / np.log(BASE)), 0, 65535)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarities of the pairs of sketches in rows of a and b, for sets of known sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most[:, None] * _GRID

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    fit = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (binary; null without words), sketch (binary; null without words)."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, part in H.groups(b.column(1).to_pylist()):
            h, first, *_ = H.words(part)
            s, text, _ = H.shingles(h, first, width)
            sets = H.distinct_sets(s, text, len(part))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(n)
            made = [None] * len(sets)
            if len(some):
                regs = registers(np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(n[some])[:-1]]))
                for i, r in zip(some.tolist(), regs, strict=True):
                    made[i] = r.tobytes()
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(n), pa.array(digests, pa.binary()), pa.array(made, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sketch"])

    return arrow_pass(docs, id_and_text(), "doc_id long, n_shingles long, set_hash binary, sketch binary", batch)


def _bands(distinct: DataFrame) -> DataFrame:
    """(bucket, id): a row for each band of each sketch."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
        h = np.tile(np.arange(BANDS, dtype=np.uint64), (b.num_rows, 1))
        for i in range(ROWS):
            h = H.mix(h * np.uint64(0xD6E8FEB86659FD93) + regs[:, :, i] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "id"])

    return arrow_pass(distinct, [F.col("id"), F.col("sketch")], "bucket long, id long", batch)


def _estimated(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Adds the estimated similarity to (a, b)."""
    side = lambda x: distinct.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, b.num_rows, 4096):
            c = b.slice(at, 4096).columns
            regs = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (c[3], c[5])]
            yield pa.RecordBatch.from_arrays([c[0], c[1], pa.array(estimate(*regs, c[2].to_numpy(), c[4].to_numpy()))], ["a", "b", "likely"])

    joined = spread_join(pairs, side("b"), "b", pairs.count()).join(side("a"), "a")
    return arrow_pass(joined, [F.col(x) for x in ("a", "b", "n_a", "s_a", "n_b", "s_b")], "a long, b long, likely double", batch)


def families(spark: SparkSession, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, family) of the sets that share a bucket with a similar one."""
    rows = scratch.keep(_bands(distinct))
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    active = scratch.keep(spread_join(rows, counted, "bucket", distinct.count() * BANDS))
    scratch.drop(rows)
    ties = None
    for turn in range(ROUNDS):
        order = F.struct(F.xxhash64("id", F.lit(turn)), F.col("id"))
        leader = active.groupBy("bucket").agg(F.min(order)["id"].alias("b"))
        led = scratch.keep(spread_join(active.withColumnRenamed("id", "a"), leader, "bucket", active.count()).where("a <> b"))
        pairs = scratch.keep(led.select("a", "b").distinct())
        judged = scratch.keep(_estimated(pairs, distinct))
        scratch.drop(active, pairs)
        tied = judged.where(F.col("likely") >= LOOSE).select("a", "b")
        ties = tied if ties is None else ties.unionAll(tied)
        apart = led.join(judged.where(F.col("likely") >= CLOSE), ["a", "b"], "left_anti")
        if turn < ROUNDS - 1:
            active = scratch.keep(apart.select("bucket", F.col("a").alias("id")))
    # What no round brought near a leader stays with the last leader of its bucket.
    left = led.join(judged.where(F.col("likely") >= CLOSE), ["a", "b"], "left_anti").select("a", "b")
    return connected_components(spark, ties.unionAll(left), scratch).select("id", F.col("component").alias("family"))


def _id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each hashed id; its size is fixed, whatever the number of ids."""
    spot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    parts = ids.select(spot.alias("spot")).groupBy(F.expr("bitmap_bucket_number(spot)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for r in parts:
        out[r.n] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def _full_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, words): the full sets, as sorted 64-bit hashes, of the documents that ids may hold."""
    bits = spark.sparkContext.broadcast(_id_filter(ids, "id"))
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    # bitmap_bucket_number counts from one.
    place = F.expr("bitmap_bucket_number(spot) * 32768 + bitmap_bit_position(spot)")

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = b.column(2).to_numpy()
        keep = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if not len(keep):
            return
        b = b.take(pa.array(keep))
        for i, part in H.groups(b.column(1).to_pylist()):
            h, first, *_ = H.words(part)
            s, text, _ = H.shingles(h, first, width)
            sets = [x.tobytes() for x in H.distinct_sets(s, text, len(part))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(sets, pa.binary())], ["id", "words"])

    some = docs.where("doc_id is not null").select(*id_and_text(), spot.alias("spot")).select("doc_id", "text", place.alias("place"))
    return arrow_pass(some, [F.col("doc_id"), F.col("text"), F.col("place")], "id long, words binary", batch)


def _links_in(sets: list[np.ndarray], percent: int, split: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (or only across the split), by inverted lists."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = np.fromiter(map(len, sets), np.int64, len(sets))
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    owner_by_value, ordered = owner[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    ends = np.concatenate([starts[1:], [len(ordered)]])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.repeat(np.arange(len(starts)), ends - starts)
    cut = np.concatenate([[0], np.cumsum(n)])
    out = []
    for x in range(len(sets) if split is None else split):
        own = rank[cut[x] : cut[x + 1]]
        a, b = starts[own], ends[own]
        many = b > a + 1
        a, b = a[many], b[many]
        size = b - a
        if not len(a):
            continue
        lists = owner_by_value[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)]
        common = np.bincount(lists, minlength=len(sets))
        linked = np.flatnonzero(100 * common >= percent * (n[x] + n - common))
        for y in linked[linked > x] if split is None else linked[linked >= split]:
            if (p := find(x)) != (q := find(int(y))):
                root[p] = q
                out.append((x, int(y)))
    return out


def _exact_links(spark: SparkSession, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members (id, family, words) to links (a, b) that connect what is linked."""
    count = members.count()
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("leader"))
    members = spread_join(members, size, "family", count)
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    # A large family's leader goes to as many places as the family has blocks.
    big = members.where(F.col("k") > BLOCK).withColumn("place", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    leaders = big.where("id = leader").select("family", F.col("words").alias("lead"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("place"))

    def with_leader(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, group, k, leader, words, lead = b.columns
        near = []
        for w, x in zip(words, lead, strict=True):
            s, t = np.frombuffer(w.as_py(), np.uint64), np.frombuffer(x.as_py(), np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            near.append(100 * common >= percent * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([ids, group, k, leader, words, pa.array(near, pa.bool_())], ["id", "family", "k", "leader", "words", "near"])

    judged = arrow_pass(big.join(leaders, ["family", "place"]), [F.col(x) for x in ("id", "family", "k", "leader", "words", "lead")], "id long, family long, k long, leader long, words binary, near boolean", with_leader)
    judged = scratch.keep(judged)
    near = judged.where("near").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    # The distant members have blocks of their own, which meet every block; blocks of members near the leader meet only those.
    distant = judged.where("not near").groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("far"))
    at = F.when(F.col("near"), F.col("far") + F.pmod(F.xxhash64("id"), blocks)).otherwise(F.pmod(F.xxhash64("id"), F.col("far"))).cast("int")
    placed = spread_join(judged, distant, "family", count).select("id", "family", "words", "far", blocks.alias("n"), at.alias("own"))
    meets = F.sequence(F.lit(0), F.when(F.col("own") < F.col("far"), F.col("far") + F.col("n")).otherwise(F.col("far")) - 1)
    pairs = placed.select("id", "words", "family", "own", F.explode(meets).alias("other"))
    pairs = pairs.select("id", "words", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    alone = members.where(F.col("k") <= BLOCK).select("id", "words", "family", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("own"))

    def compare(t: pa.Table) -> pa.Table:
        ids, sides = t.column("id").to_pylist(), t.column("own").to_pylist()
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        order = sorted(range(len(ids)), key=lambda i: (sides[i] != x, ids[i]))
        sets = [np.frombuffer(t.column("words")[i].as_py(), np.uint64) for i in order]
        split = None if x == y else sum(s == x for s in sides)
        found = [] if split in (0, len(ids)) else _links_in(sets, percent, split)
        return pa.table({"a": pa.array([ids[order[p]] for p, _ in found], pa.int64()), "b": pa.array([ids[order[q]] for _, q in found], pa.int64())})

    inside = alone.unionAll(pairs).groupBy("family", "x", "y").applyInArrow(compare, "a long, b long")
    return inside.unionAll(near.where("a <> b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; documents are linked when 100 * intersection >= percent * union."""
    scratch, kept = Scratch(spark), Scratch(spark)
    made = scratch.keep(sketches(docs, width))
    one = made.where("doc_id is not null and set_hash is not null")
    same = one.groupBy("doc_id").agg(F.min("set_hash").alias("set_hash")).groupBy("set_hash").agg(F.min("doc_id").alias("id"))
    distinct = one.join(same.withColumnRenamed("set_hash", "hash"), (F.col("doc_id") == F.col("id")) & (F.col("set_hash") == F.col("hash")))
    distinct = scratch.keep(distinct.select("id", F.col("n_shingles").alias("n"), "sketch", "set_hash").dropDuplicates(["id"]))
    family = scratch.keep(families(spark, distinct, scratch))
    sets = _full_sets(spark, docs, family, width)
    members = scratch.keep(family.join(sets, "id").join(distinct.select("id", "set_hash"), "id").where("length(words) > 0").groupBy("id", "family").agg(F.min("words").alias("words")))
    links = scratch.keep(_exact_links(spark, members, percent, scratch))
    scratch.drop(members)
    component = connected_components(spark, links, scratch)
    of_set = distinct.join(component, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    # Ids are unique as a rule; a repeated one belongs to the set of its least set hash.
    label = spread_join(one.groupBy("doc_id").agg(F.min("set_hash").alias("set_hash")), of_set, "set_hash", one.count()).select("doc_id", "component_id")
    out = made.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    root = F.coalesce("component_id", "doc_id")
    # Only the result stays on disk.
    out = kept.keep(out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept")))
    scratch.clear()
    return out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id, in the columns of docs."""
    return without_ids(docs, near_duplicates(spark, docs, width, percent).where("not kept").select("doc_id").distinct())
