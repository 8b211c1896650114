"""The store of feature records: one folder for each run, written whole or not at all."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_records(records: DataFrame, folder: str, run: str) -> None:
    """Adds the records of one run to the store, for a folder that all executors share.

    Rows are staged beside the store and the run's folder appears when the job commits, so a lost job leaves no
    part of a run, and a run that is written again replaces itself. A record without a name or a time ends the
    job before anything is seen. No records, no run.
    """
    bad = F.col("feature").isNull() | F.col("symbol").isNull() | F.col("ce").isNull()
    checked = records.withColumn("feature", F.when(bad, F.raise_error(F.lit("record without symbol, time or feature")).cast("string")).otherwise(F.col("feature")))
    checked.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def stored_records(spark: SparkSession, folder: str, runs: list[str] | None = None) -> DataFrame:
    """All records of the store, or those of some runs (other folders are not opened)."""
    r = spark.read.parquet(folder)
    return r if runs is None else r.where(F.col("run").isin(runs))


# -- small files of the shared store, through the file systems that Spark knows -------------------------------


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    f = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    f = fs.create(p, True)
    f.write(bytearray(text.encode()))
    f.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that was not there; False if another writer was first. One of several writers wins."""
    fs, p = _at(spark, path)
    if fs.getUri().getScheme() == "file":  # the local file system's create looks first and writes then
        local = p.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        f = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    f.write(bytearray(text.encode()))
    f.close()
    return True


# -- configurations, one row for each digest ------------------------------------------------------------------


def _commits(spark: SparkSession, folder: str) -> list[str]:
    """The data folders of all commits so far, in order; a commit's number is its place."""
    out: list[str] = []
    while exists(spark, f"{folder}/log/{len(out):010}"):
        out.append(read_text(spark, f"{folder}/log/{len(out):010}"))
    return out


def stored_configs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    made = _commits(spark, folder)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{m}" for m in made]) if made else spark.createDataFrame([], schema)


def upsert_configs(df: DataFrame, folder: str, digest: str = "digest", before_commit=None) -> int:
    """Adds the rows whose digest is not stored yet; a digest that is there stays as it is. Returns how often another writer was first.

    Rows are written aside and count only once the next number of the log is theirs. If another writer has taken it, what he
    wrote is left out and the next number is tried: two jobs at once leave one row for each digest. Of rows that share
    a digest in ``df`` the smallest stays; a null digest ends the job.
    """
    spark, lost = df.sparkSession, 0
    names = [c for c in df.columns if c != digest]
    named = F.coalesce(F.col(digest), F.raise_error(F.lit("a configuration without a digest")).cast("string"))
    one = df.withColumn(digest, named).groupBy(digest).agg(F.min(F.struct(*names)).alias("row")).select(digest, "row.*").select(*df.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema.fields)
    while True:
        made = _commits(spark, folder)
        new = one.join(stored_configs(spark, folder, schema).select(F.col(digest).alias("known")), F.col(digest) == F.col("known"), "left_anti") if made else one
        own = uuid.uuid4().hex
        new.write.parquet(f"{folder}/data/{own}")
        if before_commit is not None:
            before_commit(lost)
        if claim(spark, f"{folder}/log/{len(made):010}", own):
            return lost
        lost += 1
