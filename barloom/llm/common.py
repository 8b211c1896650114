"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in every contract here: space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
#: One word: a run of characters that are not white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tidy_worker(keep: bool = False) -> None:
    """Drops what earlier tasks kept in this Python worker (unless ``keep``) and gives unused memory back to the system."""
    if not keep:
        sys.modules.pop("barloom_worker", None)
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # only glibc has it
        trim(0)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
    """``work`` for mapInArrow, whose memory goes back when its task ends: idle workers hold nothing beside later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            tidy_worker(keep)

    return run


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most ``rows`` rows to Python at once from now on: texts may be long, and what is returned runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, UPPER, UPPER.lower())


def ready(spark: SparkSession) -> SparkSession:
    """Makes sure that checkpoint() has a folder: the one in spark.checkpoint.dir.

    Only a local master (tests) gets a folder of its own; a cluster without the setting is refused, since
    its executors could not read the driver's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[[^,\]]*(,\s*\d+)?\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark


def kept_in_worker(name: str, make: Callable[[], object]):
    """What ``make`` gives, kept for later tasks of this Python worker.

    Functions of this package travel by value, so their own module variables last one task only.
    """
    kept = sys.modules.setdefault("barloom_worker", types.ModuleType("barloom_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that a lost executor costs one stage at most."""
    ready(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (node, component) with the smallest node of each.

    Takes large-star and small-star steps together (one aggregate and one equi-join a round) until the edges stop
    changing; the number of rounds grows with the logarithm of the longest path. A hub's edges meet its
    minimum in a plain join, which adaptive execution splits when one hub holds most of the rows.
    Null ends and loops are ignored, repeated edges count once; nodes without an edge are not returned.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(f"{a} is not null and {b} is not null and u <> v")
        .distinct()
    )
    mark = None
    while True:
        # a node and its neighbours hang on the smallest node it sees
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        hung = both.join(low, F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        e2 = cut(hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = e2
        if now == mark:
            break
        mark = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.union(roots)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marks the side of a join for broadcast if a count shows at most ``rows`` (narrow) rows; else leaves the plan open.

    The count reads a checkpointed table, so it costs one small job.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Eager steps inside send at most ``rows`` rows to Python at once; for rows that hold whole token sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
