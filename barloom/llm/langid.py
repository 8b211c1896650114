"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, table, tidied

#: Stands for a word's edge in an n-gram; no letter has this code point.
EDGE = 1


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (1 to 3 letters, with word edges) of a whole text, packed in 21 bits a place, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(letters[c], c, EDGE)
    c = np.concatenate(([EDGE], c, [EDGE]))
    c = c[np.concatenate(([True], (c[1:] != EDGE) | (c[:-1] != EDGE)))]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != EDGE]
    return np.unique(np.concatenate((c[c != EDGE], two, three)), return_counts=True)


def _top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes first; equal counts in code order."""
    return codes[np.lexsort((codes, -counts))[:size]]


def train_profiles(docs: DataFrame, text: str, lang: str, size: int, per_lang: int, seed: int) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, most frequent first.

    Fits on at most about ``per_lang`` documents of each language, chosen by a hash of the text. Counts are
    summed in each task before they meet; only ``size`` rows of each language come to the driver.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    have = labelled.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "have_lang")
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(small_side(have), F.col("lang") == F.col("have_lang")).where(draw * F.col("n") < per_lang).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, total = _letters(), {}, 0

        def out(held: dict) -> pa.RecordBatch:
            names, codes, sums = [], [], []
            for name, parts in held.items():
                u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                names += [name] * len(u)
                codes.append(u)
                sums.append(np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(sums))], names=["lang", "code", "n"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _counts(t, letters)
                held.setdefault(name, []).append(part)
                total += len(part[0])
                if total > 2_000_000:
                    yield out(held)
                    held, total = {}, 0
        if total:
            yield out(held)

    sums = sample.mapInArrow(tidied(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = sums.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "code", "rank").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = 300, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``pred`` and ``score`` to every row, from the whole text and the profiles alone.

    A document's ``size`` most frequent n-grams are ranked; for each, the distance to a language is how far
    the n-gram's rank in that profile is out of place (``size`` if it is missing). The language with the
    least sum wins, the first in code point order if several do. score is 1 less the sum over its largest
    possible value. Null text, text without a letter, and no profiles give ``und`` and score 0. Rows are
    independent: repeated rows repeat, an empty table stays empty, no shuffle is made. Profiles hold
    ``size`` entries for each language, so what travels to tasks is bounded.
    """
    names = sorted(profiles)
    union = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(union), len(names)), size, np.int64)
    for j, n in enumerate(names):
        ranks[np.searchsorted(union, profiles[n]), j] = np.arange(len(profiles[n]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                codes, counts = _counts(t or "", letters)
                if not len(codes) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                mine = _top(codes, counts, size)
                at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
                apart = np.abs(ranks[at] - np.arange(len(mine))[:, None])
                apart[(union[at] != mine), :] = size
                apart[(ranks[at] == size)] = size
                total = apart.sum(axis=0)
                best = int(total.argmin())
                langs.append(names[best])
                scores.append(1.0 - float(total[best]) / (size * len(mine)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    slim = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("__text"))
    n = len(docs.columns)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), f"c{n} string", f"c{n + 1} double"])
    out = slim.mapInArrow(tidied(predict), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*docs.columns, pred, score])])


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id's text, modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    profiles = train_profiles(docs.where(~F.col("held_out")), "text", "lang", size=300, per_lang=10_000, seed=11)
    return predict_language(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
