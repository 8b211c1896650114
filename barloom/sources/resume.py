"""Studies that go on where they were stopped: stages kept as Parquet under the identity of their inputs and parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, read_text, write_text


def input_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows that does not depend on their order: one aggregate, nothing collected but three numbers."""
    names = sorted(df.columns)
    a, b = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
    n = df.agg(F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in (a, b)]).first()
    return hashlib.sha256(json.dumps([names, *map(str, n)]).encode()).hexdigest()


class Study:
    """Stages of one study in ``folder``.

    ``identity`` has what the results depend on: digests of inputs, parameters, versions. A folder that was made under
    another identity is refused, with the fields that differ. Rows that ``holdout`` is true for are never stored: a stage that
    holds one ends the job.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: dict, holdout: Column | None = None) -> None:
        self.spark, self.folder, self.holdout = spark, folder, holdout
        self.identity = json.loads(json.dumps(identity, sort_keys=True, default=str))
        #: Stages that this run took from the folder, and those that it made.
        self.resumed: list[str] = []
        self.made: list[str] = []
        at = f"{folder}/identity.json"
        if exists(spark, at):
            known = json.loads(read_text(spark, at))
            differ = sorted(k for k in {*known, *self.identity} if known.get(k, "-") != self.identity.get(k, "-") or (k in known) != (k in self.identity))
            if differ:
                raise ValueError("the checkpoint is of another study: " + ", ".join(f"{k} is {self.identity.get(k)!r}, was {known.get(k)!r}" for k in differ))
        else:
            write_text(spark, at, json.dumps(self.identity, sort_keys=True))

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a stage: read back if it was finished, else built and written. A stage counts once its mark is there."""
        at, mark = f"{self.folder}/{name}", f"{self.folder}/{name}.json"
        if exists(self.spark, mark):
            out, known = self.spark.read.parquet(at), json.loads(read_text(self.spark, mark))
            if out.count() != known["rows"]:
                raise ValueError(f"stage {name}: {known['rows']} rows were written, others are there")
            self.resumed.append(name)
            return out
        df = build()
        if self.holdout is not None:
            first = df.columns[0]
            kept_out = F.when(F.coalesce(self.holdout, F.lit(False)), F.raise_error(F.lit(f"stage {name} holds rows of the holdout")).cast(df.schema[first].dataType)).otherwise(F.col(first))
            df = df.withColumn(first, kept_out)
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        write_text(self.spark, mark, json.dumps({"rows": out.count()}))
        self.made.append(name)
        return out
