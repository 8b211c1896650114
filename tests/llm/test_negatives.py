"""Strassen products and hard negatives, held against plain versions."""

import math

import numpy as np
import pytest
from barloom.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 7), (70, 33, 129), (128, 64, 128), (200, 3, 90), (0, 4, 3), (4, 0, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**24), 2**24, (m, k)), rng.integers(-(2**24), 2**24, (k, n))
    for leaf in (1, 8, 32):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()
    big = (a.astype(object) << 50) @ (b.astype(object) << 50)
    assert (negatives.strassen(a.astype(object) << 50, b.astype(object) << 50) == big).all()


def plain(rows, positives=5, most=10, low=30, high=90):
    """Rows by (id, label, vector), repeated ones once."""
    known = {}
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[(i, label, tuple(v))] = [math.floor(256 * x) for x in v]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, av in known.items():
        if a[0] is None or a[0] % 100:
            continue
        score = {k: sum(x * y for x, y in zip(av, v, strict=False)) for k, v in known.items()}
        ranked = sorted(score, key=lambda k: (-score[k], last(k[0])))
        for p in [k for k in ranked if k[1] == a[1] and k != a][:positives]:
            window = [k for k in ranked if k[1] != a[1] and low * score[p] <= 100 * score[k] <= high * score[p]][:most]
            out += [(a[0], p[0], r, k[0], score[p], score[k]) for r, k in enumerate(window, 1)]
    return sorted(out, key=str)


def found(df, **sizes):
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "anchor_block": 3, "tile": 2}])
def test_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 3, (300, 6)) / 4.0  # many ties, negative and zero scores
    rows = [(i * 5, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, 1, [0.5] * 6) for i in range(90)]  # a large group of copies
    rows += rows[:20]  # repeated rows
    odd = [(700, 5, [1.0] * 6), (800, None, [1.0] * 6), (801, 1, None), (802, 1, [None] * 6), (803, 1, [float("nan")] * 6), (804, 2, [float("inf")] * 6), (None, 0, [0.75] * 6), (900, 1, [0.5, 0.25]), (901, 0, []), (100, 2, [0.25] * 6)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit(7) for c in ("id", "rid", "g", "h", "side", "v", "p", "k", "anchor")})
    assert found(df, **sizes) == plain(rows + odd)


def test_components_beyond_int64(spark):
    rows = [(i, i % 2, [float(10**6 * (i + 1)), 1e7 - 5e6 * (i % 2), 2.0**45 if i == 3 else 0.5]) for i in range(8)] + [(100, 0, [3e-9, 1.5e6, 0.015625])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows) != []


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)
    assert found(df) == [] and found(df.where("false")) == []


def test_query_moves_labels(spark):
    got = negatives.op12_negatives(spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
