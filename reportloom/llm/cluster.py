"""What the operators need from the running session: a shared folder, lineage cuts and input tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold about so many bytes, or one row, where lineage is cut; both sides of a Python worker keep some at once.
BATCH_BYTES = 8 << 20
#: What holds while lineage is cut and stages are written.
CUT = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bits of a bitmap of keys (16 MB), in blocks of Spark's bitmap functions.
BITS, BLOCK = 1 << 27, 1 << 15
#: Rows for each part of a small table, and the most rows of one.
PART_ROWS, FEW_ROWS = 1 << 13, 1 << 20
#: With these, adaptive execution merges small partitions.
MERGES = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="reportloom-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Frames made and run in here have Arrow batches of ``BATCH_BYTES``; their shuffle files go when they have run, not when the
    driver happens to collect its garbage. A frame holds to the setting under which it was made."""
    before = {k: spark.conf.get(k) for k in CUT}
    try:
        for k, v in CUT.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder, ``freeing`` what it took."""
    shared_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold about ``BATCH_BYTES``, also where the caller runs a lazy frame."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table (cheap to count) of at most ``rows`` rows; any other join beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, of narrow rows, in a part for every ``PART_ROWS`` of the ``rows`` that it comes from, if these are known and at most ``FEW_ROWS``.

    The driver keeps something of every task, however little the task reads; of a small table most shuffle partitions are nearly empty.
    Where adaptive execution merges them, ``df`` stays as it is.
    """
    merges = all(df.sparkSession.conf.get(k) == "true" for k in MERGES)
    return df if merges or rows is None or rows > FEW_ROWS else df.coalesce(rows // PART_ROWS + 1)


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """A filter of ``BITS`` bits that all keys (longs, evenly spread) of ``df`` pass, and some others; built by the tasks in blocks of 4 KB."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1
    blocks = df.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros((BITS // BLOCK, BLOCK // 8), np.uint8)
    for n, bits in zip(blocks["n"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
        out[n - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys pass the filter; those it was built of all do."""
    place = keys.astype(np.int64) & (BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, key: str, info: DataFrame, how: str = "left", n: int | None = None) -> DataFrame:
    """``rows`` joined with ``info`` (one row per ``key``) although one key may hold most of the rows.

    Rows of a key are dealt to as many parts as there are shuffle partitions; a key's info is copied only to the parts
    that its rows are in. The result is in ``few`` parts for a table of ``n`` rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    spread = few(few(salted.select(key, "__part").distinct(), n).join(info, key, how), n)
    return few(salted.join(spread, [key, "__part"], how).drop("__part"), n)
