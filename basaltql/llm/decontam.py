"""Benchmark decontamination (operator 4), with DataFrame and SQL functions only.

Texts are lower-cased and cut into words at everything but letters and digits; a set has the distinct hashes
of five words in a row.  The search finds short items inside long documents by MinHash containment, in size classes:

* Class c holds the items of 2**c to 2**(c+1) - 1 members.  Up to class SMALL every member is a register; class c above
  has REGISTERS + STEP * (c - SMALL) registers: an item's least members under a second hash, a uniform sample.
* A document that contains the threshold's share of an item holds about that share of its registers.  A small class
  needs exactly this share of them, so its lookup is exact; a larger class needs so many that missing an item is an
  event of probability MISS.
* A document is looked up in a class only if it has at least as many shingles as the class's smallest item, times
  the threshold, has members: long items are never looked for in short documents.

Candidates are then confirmed on the full sets.

The index grows with the benchmark, not with the documents; it is broadcast only if it is small (BROADCAST_ROWS)
and joined by shuffling otherwise (a frequent shingle's partition is then split by adaptive execution).  Null and
empty texts, and items of under five words, match nothing.  Rows of one item_id count as one with the union of their
sets; of rows with one doc_id the one that shares most counts.  Rows without id are ignored, as are extra columns.  Very long texts are cut into
rows of one shingle, so that none is copied.  There are no ties: all pairs over the threshold are found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltql.llm.common import BROADCAST_ROWS, Scratch, without_ids

SMALL, REGISTERS, STEP = 4, 32, 4
#: The probability that a contained item of a larger class is no candidate.
MISS = 1e-6


def registers(size_class: int) -> int:
    """How many of its members stand for an item of the class."""
    return (2 << size_class) - 1 if size_class <= SMALL else REGISTERS + STEP * (size_class - SMALL)


def needed(m: int, percent: int) -> int:
    """The most hits that a sample of m members of an item misses with probability MISS at the threshold (binomial, an upper bound)."""
    total, p = 0.0, percent / 100
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > MISS:
            return max(1, k)
    return m


def _classes(spark: SparkSession, most: int, percent: int) -> DataFrame:
    """size_class, registers, hits (null in exact classes), least_doc: a row for each class up to that of the largest item."""
    rows = [(c, registers(c), None if c <= SMALL else needed(registers(c), percent), -(-percent * (1 << c) // 100)) for c in range(max(1, most).bit_length())]
    return spark.createDataFrame(rows, "size_class int, registers int, hits int, least_doc int")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(df: DataFrame, key: str, width: int, least: int = 1) -> DataFrame:
    """(key, version, shingle, n), with repetitions, of texts of n >= least shingles: nothing is shuffled, and the words of a row are never copied."""
    words = df.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("version"), word_list(F.col("text")).alias("words")).where(F.col(key).isNotNull() & (F.size("words") >= width + least - 1))
    at = words.select(key, "version", "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
    return at.select(key, "version", F.xxhash64(*(F.get("words", F.col("at") + i) for i in range(width))).alias("shingle"), (F.size("words") - (width - 1)).alias("n"))


def _beside(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def build_index(spark: SparkSession, benchmark: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(members of items, sizes of items, index of registers by class, the fewest shingles of a document that can contain an item)."""
    full = scratch.keep(shingled(benchmark, "item_id", width).select("item_id", "shingle").distinct())
    sizes = scratch.keep(full.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item")))
    most = sizes.agg(F.max("n_item"), F.min("n_item")).first()
    classed = sizes.withColumn("size_class", F.floor(F.log2("n_item")).cast("int")).join(F.broadcast(_classes(spark, most[0] or 1, percent)), "size_class")
    needs = F.coalesce("hits", F.ceil(F.col("n_item") * percent / 100).cast("int")).alias("needed")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("shingle", F.lit(1)), "shingle"))
    index = full.join(classed, "item_id").withColumn("rank", rank).where("rank <= registers").select("item_id", "size_class", needs, "least_doc", "shingle")
    return full, sizes, scratch.keep(index), max(1, -(-percent * (1 << ((most[1] or 1).bit_length() - 1)) // 100))


def candidates(docs: DataFrame, index: DataFrame, rows: int, least: int, width: int = 5) -> DataFrame:
    """(doc_id, item_id) with as many register hits as the item's class needs, in documents large enough for the class."""
    left = shingled(docs, "doc_id", width, least)
    hits = left.join(_beside(index.withColumnRenamed("shingle", "member"), rows), (F.col("shingle") == F.col("member")) & (F.col("n") >= F.col("least_doc")))
    found = hits.select("doc_id", "item_id", "needed", "shingle").distinct().groupBy("doc_id", "item_id", "needed").agg(F.count(F.lit(1)).alias("hits"))
    return found.where("hits >= needed").select("doc_id", "item_id")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair with 100 * n_shared >= percent * n_item."""
    scratch = Scratch(spark)
    full, sizes, index, least = build_index(spark, benchmark, scratch, width, percent)
    pairs = scratch.keep(candidates(docs, index, index.count(), least, width))

    ids = pairs.select("doc_id").distinct()
    chosen = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = chosen.join(_beside(ids, pairs.count()), "doc_id", "left_semi")
    shared = shingled(chosen, "doc_id", width).select("doc_id", "version", "shingle").join(_beside(full, full.count()), "shingle").distinct()
    counted = shared.groupBy("doc_id", "version", "item_id").agg(F.count(F.lit(1)).alias("n_shared")).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"))
    counted = counted.join(pairs, ["doc_id", "item_id"], "left_semi")
    found = counted.join(sizes, "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that contain a benchmark item, in the columns of docs; rows without doc_id stay."""
    ids = Scratch(spark).keep(contaminated(spark, docs, benchmark, width, percent).select("doc_id").distinct())
    return without_ids(docs, ids, ids.count() <= BROADCAST_ROWS)
