import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    near = " ".join(f"word{i}" for i in range(200))
    rows = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \t ", "en", "a"), (3, "One two three", "en", "b"), (3, "One two three", "en", "b"), (4, long, "en", "b"), (5, near, "de", None),
        (6, near.replace("word7 ", "other "), "de", "c"), (7, near, None, "c"), (None, "no id here at all", "en", "c"), (8, "<|endoftext|> x\n\n y\té \U0001f600", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("id", "t", "n", "h", "k", "row", "line", "__pos", "size", "token", "c0", "len")})
