"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, small_side, table


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is scaled to 1 first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar(x: np.ndarray, y: np.ndarray, candidate: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs of two sets of unit vectors have a cosine of ``threshold`` or more; others are not computed.

    Where most rows have candidates with most columns, the product of just these rows and columns is the cheaper way.
    """
    link = np.zeros(candidate.shape, bool)
    rows, cols = np.flatnonzero(candidate.any(axis=1)), np.flatnonzero(candidate.any(axis=0))
    n = int(candidate.sum())
    if 8 * n > len(rows) * len(cols):
        box = np.ix_(rows, cols)
        link[box] = candidate[box] & (x[rows] @ y[cols].T >= threshold)
        return link
    i, j = np.nonzero(candidate)
    for lo in range(0, n, 50_000):
        a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
        link[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return link


def choose_pivots(vectors: DataFrame, column: str, pivots: int, sample: int, seed: int) -> dict[int, np.ndarray]:
    """Reference points for each vector length: unit vectors, far apart, from at most about ``sample`` rows.

    The rows are those with the smallest hash; each next pivot is the sampled point whose nearest pivot so far is farthest.
    """
    n = vectors.count()
    draw = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.where(draw * F.lit(float(n)) < sample).select(column).collect()
    out = {}
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r[0]), []).append(r[0])
    for d, group in by_length.items():
        x = unit(np.unique(np.array(group, np.float64), axis=0))
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(pivots, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[d] = x[chosen]
    return out


def _verify(key: tuple, group: pa.Table, pivots: int, shared: int, threshold: float) -> pa.Table:
    """One pair of blocks of an inverted list: candidates by shared-pivot counts, then their cosines.

    A pair with several shared pivots meets in several lists; the list of the smallest one owns it.
    """
    own, left, right = (key[i].as_py() for i in (2, 3, 4))
    side = group.column("side").to_numpy()
    ids, weights = group.column("cid").to_numpy(), group.column("w").to_numpy()
    x = unit(np.array(group.column("v").to_pylist(), np.float64))
    near = np.array(group.column("near").to_pylist(), np.int64)
    has = np.zeros((len(ids), pivots), np.float32)
    has[np.arange(len(ids))[:, None], near] = 1
    a = np.flatnonzero(side == left)
    b = a if left == right else np.flatnonzero(side == right)
    candidate = (has[a] @ has[b].T >= shared) & (has[a, :own] @ has[b, :own].T == 0)
    if left == right:
        np.fill_diagonal(candidate, False)
    link = similar(x[a], x[b], candidate, threshold)
    degree = np.zeros(len(ids), np.int64)
    degree[a] += link @ weights[b]
    if left != right:
        degree[b] += link.T @ weights[a]
    # the smallest id that each vector reaches inside the two blocks stands for its links here
    low, before = ids.copy(), None
    while link.any() and (before is None or (low != before).any()):
        before = low.copy()
        top = np.iinfo(np.int64).max
        low[a] = np.minimum(low[a], np.where(link, low[b], top).min(axis=1))
        low[b] = np.minimum(low[b], np.where(link.T, low[a], top).min(axis=1))
    hit = np.flatnonzero(degree)
    return pa.table({"cid": ids[hit], "degree": degree[hit], "low": low[hit]})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, pivots: int = 128, prefix: int = 6, shared: int = 2, sample: int = 4096, block: int = 2048, seed: int = 5) -> DataFrame:
    """Links rows of equal label with cosine >= threshold: vec_id, n_links, component_id, kept.

    Each vector is described by its ``prefix`` nearest of ``pivots`` reference points in order of nearness, and
    stands in those inverted lists of its label. Two vectors that share at least ``shared`` pivots are
    candidates, and a candidate pair's cosine is computed in double precision. Pivots are fitted on a bounded
    sample, every row is indexed; recall against brute force is measured in the tests.

    Vectors that are null, of length 0, zero, or hold null or non-finite components, and rows with a null
    label link with nothing; vectors of different lengths do not link. Equal vectors of a label are collapsed
    to one with a weight before the index, so many copies cost one; repeated ids count as rows. An empty table
    gives an empty table. A list longer than ``block`` is dealt by hash into blocks that meet pairwise, each
    pair in its own task; tasks give back counts and one link for each vector, never the pairs.
    """
    v = F.col(embedding)
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x)) | ~F.coalesce((most > 0) & (most < float("inf")), F.lit(False)) | F.col(label).isNull()
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.when(~bad, v).alias("v"))
    rows = rows.withColumns({"h": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "g": F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1)))})
    classes = cut(
        rows.where("v is not null").groupBy("label", "h", "g").agg(F.min("id").alias("cid"), F.count("*").alias("w"), F.min_by("v", "id").alias("v"))
    )
    points = choose_pivots(classes, "v", pivots, sample, seed)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for d, at in _by_length(batch.column(2)):
                x = np.array(batch.column(2).take(pa.array(at)).to_pylist(), np.float64)
                if d in points:
                    # stable order: equally near pivots keep their number's order
                    order = np.argsort(-unit(x) @ points[d].T, axis=1, kind="stable")[:, :prefix]
                else:
                    order = np.zeros((len(at), 1), np.int64)
                near += list(zip(at, order.tolist(), strict=True))
            near.sort()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for _, n in near], pa.list_(pa.int32()))], names=["cid", "w", "v", "label", "near"])

    kind = classes.schema["v"].dataType.simpleString()
    lab = classes.schema["label"].dataType.simpleString()
    index = cut(classes.select("cid", "w", "v", "label").mapInArrow(nearest, f"cid long, w long, v {kind}, label {lab}, near array<int>"))
    lists = index.select("label", F.size("v").alias("d"), F.explode("near").alias("pivot"), "cid", "w", "v", "near")
    long_lists = lists.groupBy(F.col("label").alias("l"), F.col("d").alias("ld"), F.col("pivot").alias("lp")).agg(F.count("*").alias("n")).where(F.col("n") > block)
    placed = lists.join(small_side(long_lists), (F.col("label") == F.col("l")) & (F.col("d") == F.col("ld")) & (F.col("pivot") == F.col("lp")), "left")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("label", "d", "pivot", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cid", "w", "v", "near")
    few = min(shared, min((min(prefix, len(p)) for p in points.values()), default=1))

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        d = key[1].as_py()
        return _verify((key[0], d, key[2], key[3], key[4]), group, pivots, few if d in points else 1, threshold)

    found = cut(meets.groupBy("label", "d", "pivot", "i", "j").applyInArrow(verify, "cid long, degree long, low long"))
    degree = found.groupBy("cid").agg(F.sum("degree").alias("degree")).withColumnRenamed("cid", "d_cid")
    parts = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    info = classes.select("label", "h", "g", "cid", "w").join(degree, F.col("cid") == F.col("d_cid"), "left").join(parts, F.col("cid") == F.col("node"), "left")
    info = info.select(F.col("label").alias("i_label"), F.col("h").alias("i_h"), F.col("g").alias("i_g"), (F.coalesce("degree", F.lit(0)) + F.col("w") - 1).cast("long").alias("links"), F.coalesce("component", "cid").alias("part"))
    out = rows.select("id", "label", "h", "g").join(info, (F.col("label") == F.col("i_label")) & (F.col("h") == F.col("i_h")) & (F.col("g") == F.col("i_g")), "left")
    part = F.coalesce("part", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("id"), F.lit(True)).alias("kept"))


def _by_length(vectors: pa.Array) -> list[tuple[int, np.ndarray]]:
    n = np.array([len(x) for x in vectors], np.int64)
    return [(int(d), np.flatnonzero(n == d)) for d in np.unique(n)]


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)
