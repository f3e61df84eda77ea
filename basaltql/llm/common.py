"""What the text operators share: Arrow passes, the label split, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id tables of at most so many rows (16 MB) may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: A key is hot with more than one part in HOT_KEYS of all rows (and more than HOT_ROWS), so at most HOT_KEYS keys are.
HOT_KEYS, HOT_ROWS = 4096, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about SLICE_BYTES, so that Python never holds all texts of a batch as objects."""
    rows = max(1, int(b.num_rows * SLICE_BYTES // max(1, b.get_total_buffer_size())))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def release() -> None:
    """Gives freed memory back to the system: workers are kept for later stages, beside which it would count."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_pass(df: DataFrame, columns: list[Column], schema: str, batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], whole: bool = False) -> DataFrame:
    """Runs batch over the chosen columns, slice by slice (or, if whole, one Arrow batch after the other); rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for part in [b] if whole else slices(b):
                    if part.num_rows:
                        yield from batch(part)
        finally:
            release()

    return df.select(*columns).mapInArrow(run, schema)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, k = {c.lower() for c in df.columns}, 0
    while f"{stem}_{k}" in taken:
        k += 1
    return f"{stem}_{k}"


def without_ids(docs: DataFrame, ids: DataFrame, small: bool = False) -> DataFrame:
    """docs without the rows whose doc_id is in the only column of ids, which are distinct; rows without doc_id stay."""
    gone = unused(docs, "gone")
    ids = ids.toDF(gone)
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"].cast("long") == F.col(gone), "left_anti")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(id, label) of the ids outside the held-out third; ids whose labels disagree are left out."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("label"))
    return known.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, id, label) for the bounded table chosen (id, label): of rows with one doc_id the text of least hash counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("text", "id", "label")


def id_and_text(extra: tuple[Column, ...] = ()) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra]


def held_out(name: str = "doc_id") -> Column:
    """True for the third of the ids on which learned operators are judged and from which they never learn."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of left (of so many rows) with right, which has a key once; rows of a hot key stay where they are.

    The hot keys are read to the driver and their rows of right broadcast, HOT_KEYS at most; all others meet by
    shuffling, where a key has at most one part in HOT_KEYS of the rows.  Key is a long or binary column.
    """
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > max(HOT_ROWS, rows // HOT_KEYS))
    hot = [r[0] for r in counted.where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.expr(f"`{key}` IN ({', '.join(f'{x}L' if isinstance(x, int) else f"X'{x.hex()}'" for x in hot)})")
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key).unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where the session names none and all runs in one process (as in tests) one of our own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage; a lost executor costs no recomputation beyond them.

    What a returned plan still reads stays until the driver ends; then the whole folder goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in frames:
            for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
                _delete(self.spark, path)

    def clear(self) -> None:
        """Deletes all tables."""
        if self.spark.sparkContext._jsc is None:
            return
        with contextlib.suppress(Py4JError, Py4JNetworkError, OSError):  # the JVM may have ended before
            _delete(self.spark, self.root)
