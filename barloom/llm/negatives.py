"""Hard negatives for retrieval training: Strassen products of int64 tiles, and mergeable heaps of positives and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """The product of two integer matrices; both are padded with zeros so that they halve down to ``leaf``.

    Only additions, subtractions and products of integers, so an int64 result is exact whenever it fits, even if
    a sum on the way wraps round.
    """
    sides = (a.shape[0], a.shape[1], b.shape[1])
    if not min(sides):
        return np.zeros((sides[0], sides[2]), a.dtype)
    step = 1
    while min(sides) > leaf * step:
        step *= 2
    m, k, n = (-(-s // step) * step for s in sides)
    x, y = np.zeros((m, k), a.dtype), np.zeros((k, n), b.dtype)
    x[: sides[0], : sides[1]], y[: sides[1], : sides[2]] = a, b
    return _halved(x, y, step)[: sides[0], : sides[2]]


def _halved(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    if step == 1:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.zeros((2 * m, 2 * n), a.dtype)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = _halved(a11 + a22, b11 + b22, step // 2)
    c11 += p
    c22 += p
    p = _halved(a21 + a22, b11, step // 2)
    c21 += p
    c22 -= p
    p = _halved(a11, b12 - b22, step // 2)
    c12 += p
    c22 += p
    p = _halved(a22, b21 - b11, step // 2)
    c11 += p
    c21 += p
    p = _halved(a11 + a12, b22, step // 2)
    c11 -= p
    c12 += p
    c22 += _halved(a21 - a11, b11 + b12, step // 2)
    c11 += _halved(a12 - a22, b21 + b22, step // 2)
    return out


class Side:
    """One side of a meeting of blocks: ids (with null ones last), row hashes, labels and whole-numbered vectors."""

    def __init__(self, rows: pa.Table, scale: float) -> None:
        order = rows.append_column("no_id", pa.array(rows.column("id").is_null().to_numpy())).append_column("at", pa.array(range(rows.num_rows), pa.int64()))
        self.rows = rows.take(order.sort_by([("no_id", "ascending"), ("id", "ascending"), ("rid", "ascending")]).column("at"))
        self.rid, self.label = self.rows.column("rid").to_numpy(), self.rows.column("label").to_numpy()
        vectors = self.rows.column("v").combine_chunks()
        self.sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.flat = np.floor(scale * flat)
        self.most = float(np.abs(self.flat).max(initial=0))
        if not np.isfinite(self.most):
            raise OverflowError("a scaled component is too large for a double")

    def matrix(self, width: int, kind: type) -> np.ndarray:
        """The vectors as rows of ``width``, shorter ones with zeros behind them."""
        out = np.zeros((len(self.sizes), width), kind)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        out[row, at] = self.flat.astype(np.int64) if kind is np.int64 else [int(x) for x in self.flat]
        return out


def _scores(group: pa.Table, scale: float, tile: int):
    """Anchors, candidates, and for each strip of anchors the place of its first one and its scores against all candidates."""
    anchor = group.column("side").to_numpy() == 0
    a, c = Side(group.filter(pa.array(anchor)), scale), Side(group.filter(pa.array(~anchor)), scale)
    width = int(max(a.sizes.max(initial=0), c.sizes.max(initial=0)))
    # 100 scores are compared, so these must fit too; else Python's whole numbers take over
    kind = np.int64 if a.most * c.most * max(width, 1) * 100 < 2.0**62 and max(a.most, c.most) < 2.0**53 else object
    x, y = a.matrix(width, kind), c.matrix(width, kind).T

    def strips():
        for i in range(0, len(x), tile):
            yield i, np.hstack([strassen(x[i : i + tile], y[:, j : j + tile]) for j in range(0, y.shape[1], tile)] or [np.zeros((len(x[i : i + tile]), 0), kind)])

    return a, c, strips()


def _first(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` places of ``among`` with the highest scores, earlier ones first among equals."""
    return among[np.argsort(-scores[among], kind="stable")[:n]]


def _taken(a: Side, anchors: list[int], c: Side, places: list[int], scores: list[int], **more) -> pa.Table:
    own = a.rows.take(pa.array(anchors, pa.int64()))
    other = c.rows.take(pa.array(places, pa.int64()))
    cols = {"a_id": own.column("id"), "a_rid": own.column("rid"), "id": other.column("id"), "rid": other.column("rid"), "score": pa.array([int(s) for s in scores], pa.int64())}
    return pa.table(cols | {k: pa.array(v, pa.int64()) for k, v in more.items()})


def _positives(group: pa.Table, scale: float, tile: int, most: int) -> pa.Table:
    """A heap of each anchor of a meeting: its best other rows of its label."""
    a, c, strips = _scores(group, scale, tile)
    same = {k: np.flatnonzero(c.label == k) for k in np.unique(a.label)}
    id_a, id_c = (x.rows.column("id").to_pylist() for x in (a, c))
    anchors, places, scores = [], [], []
    for start, strip in strips:
        for i, row in enumerate(strip, start):
            best = _first(row, same[a.label[i]], most + 1)
            # the anchor itself is there at most once: rows are told apart by id and hash
            best = [j for j in best if c.rid[j] != a.rid[i] or id_c[j] != id_a[i]][:most]
            anchors += [i] * len(best)
            places += best
            scores += [row[j] for j in best]
    return _taken(a, anchors, c, places, scores)


def _windows(group: pa.Table, scale: float, tile: int, most: int, low: int, high: int) -> pa.Table:
    """A heap of each (anchor, positive) of a meeting: the best rows of other labels inside the positive's window."""
    a, c, strips = _scores(group, scale, tile)
    other = {k: np.flatnonzero(c.label != k) for k in np.unique(a.label)}
    wanted = a.rows.column("p").to_pylist()
    anchors, places, scores, which = [], [], [], []
    for start, strip in strips:
        for i, row in enumerate(strip, start):
            ranked = _first(row, other[a.label[i]], len(row))
            falling = -row[ranked]
            for p in wanted[i] or ():
                s = p["score"]
                begin = int(np.searchsorted(falling, -(high * s // 100), "left"))  # 100 * score <= high * s
                end = int(np.searchsorted(falling, low * -s // 100, "right"))  # 100 * score >= low * s
                best = ranked[begin : min(end, begin + most)]
                anchors += [i] * len(best)
                places += best.tolist()
                scores += [row[j] for j in best]
                which += [p["k"]] * len(best)
    return _taken(a, anchors, c, places, scores, k=which)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, anchor_block: int = 4096, block: int = 4096, tile: int = 512
) -> DataFrame:
    """For each anchor and positive the hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(scale * x). A row's score is its inner product with the anchor, exact; higher
    ones come first, ties by smaller vec_id (null last), then by a hash of the row. Positives are an anchor's
    first ``positives`` other rows of its label, negatives the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a shorter vector counts as
    filled up with zeros. Rows that repeat in id, label and vector count once; different rows may share an id,
    and as anchors each gets its own results. Other columns are ignored; an empty table, or one without anchors,
    gives an empty table. A score that a long cannot hold fails the job.

    Anchors and candidates are dealt by hash into blocks, each two blocks meet in a task of their own, and a
    task holds one strip of ``tile`` anchors' scores. What leaves it are heaps, at most ``positives`` (or ``negatives``)
    rows for each anchor, cut again before the shuffle that merges them. Windows need all positives, so
    the products are made twice rather than kept.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    slim = slim.where("label is not null and v is not null").where(F.coalesce(finite, F.lit(False)))
    slim = cut(slim.dropDuplicates(["id", "label", "v", "anchor"]).withColumn("rid", F.xxhash64("label", "v")))
    n = slim.agg(F.count("*").alias("all"), F.count_if("anchor").alias("anchors")).first()
    g, h = max(1, -(-n["all"] // block)), max(1, -(-n["anchors"] // anchor_block))
    place = lambda blocks: F.pmod(F.xxhash64("id", "rid"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = "array<struct<k:bigint,score:bigint>>"
    columns = ["g", "h", "side", "id", "rid", "label", "v", "p"]
    candidates = slim.select(place(g).alias("g"), every(h).alias("h"), F.lit(1).alias("side"), "id", "rid", "label", "v", F.lit(None).cast(kind).alias("p"))
    anchors = slim.where("anchor").withColumn("h", place(h))
    meet = lambda df: df.select(every(g).alias("g"), "h", F.lit(0).alias("side"), "id", "rid", "label", "v", "p").select(*columns).unionByName(candidates).groupBy("g", "h")
    best = [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]

    def first(group: pa.Table) -> pa.Table:
        return _positives(group, scale, tile, positives)

    def window(group: pa.Table) -> pa.Table:
        return _windows(group, scale, tile, negatives, low, high)

    found = meet(anchors.withColumn("p", F.lit(None).cast(kind))).applyInArrow(first, "a_id long, a_rid long, id long, rid long, score long")
    heaps = cut(found.withColumn("k", F.row_number().over(Window.partitionBy("a_id", "a_rid").orderBy(*best)).cast("long")).where(F.col("k") <= positives))
    wanted = heaps.groupBy(F.col("a_id").alias("w_id"), F.col("a_rid").alias("w_rid")).agg(F.collect_list(F.struct("k", "score")).alias("p"))
    asked = cut(anchors.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("rid") == F.col("w_rid"))))
    found = meet(asked).applyInArrow(window, "a_id long, a_rid long, id long, rid long, score long, k long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("a_id", "a_rid", "k").orderBy(*best))).where(F.col("rank") <= negatives)
    own = heaps.select(F.col("a_id").alias("h_id"), F.col("a_rid").alias("h_rid"), F.col("k").alias("h_k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = ranked.join(own, F.col("a_id").eqNullSafe(F.col("h_id")) & (F.col("a_rid") == F.col("h_rid")) & (F.col("k") == F.col("h_k")))
    return out.select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
