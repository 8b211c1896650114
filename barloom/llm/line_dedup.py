"""Line dedup: lines that occur in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, lower_ascii, table


def dedup_lines(docs: DataFrame, text: str = "text", key: list[str] | None = None, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Explodes normalised lines, hashes them, counts documents per hash, drops frequent lines, reassembles by position.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` rows hold lose all their lines. Returns ``key`` columns (default
    doc_id) with ``text`` (kept lines joined by newline), ``n_lines`` (before) and ``n_dropped``.

    Null and empty texts are one empty line. Rows count as documents: a repeated row counts once per repeat,
    and comes back once per repeat; a key column may be null. An empty table gives an empty table.

    A document's distinct hashes are counted inside its row, so the count is one aggregate with map-side
    combining and a line held by a third of all rows costs one row per task. Frequent hashes join back by
    equality: adaptive execution broadcasts them when they are measured to be small, and splits the hot
    hash when they are not. Hashes have 128 bits.
    """
    key = ["doc_id"] if key is None else key
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], lines.alias("__lines"))
    norm = lambda x: lower_ascii(F.btrim(x, F.lit(WHITE)))
    long_enough = (lambda k: F.length(k) >= min_chars) if min_chars > 1 else (lambda k: k != "") if min_chars == 1 else (lambda k: F.lit(True))
    hashed = lambda k: F.when(long_enough(k), F.struct(F.xxhash64(k).alias("h"), F.xxhash64(k, F.lit(1)).alias("g")))
    frequent = (
        rows.select(F.explode(F.array_distinct(F.transform("__lines", lambda x: norm(x)))).alias("__key"))
        .where(long_enough(F.col("__key")))
        .groupBy(hashed(F.col("__key")).alias("__hash"))
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") >= min_docs)
        .select(F.col("__hash.h").alias("__fh"), F.col("__hash.g").alias("__fg"))
    )
    keys = [f"__k{i}" for i in range(len(key))]
    # copies of a row share its identity and are told apart by their number, so each comes back as often as it came
    identity = rows.withColumns({"__id": F.xxhash64("__lines", F.lit(2)), "__row": F.monotonically_increasing_id()})
    line = identity.select(*keys, "__id", "__row", F.posexplode("__lines").alias("__pos", "__line"))
    line = line.withColumn("__hash", hashed(norm(F.col("__line")))).select(*keys, "__id", "__row", "__pos", "__line", F.col("__hash.h").alias("__h"), F.col("__hash.g").alias("__g"))
    marked = line.join(frequent, (F.col("__h") == F.col("__fh")) & (F.col("__g") == F.col("__fg")), "left")
    kept = F.when(F.col("__fh").isNull(), F.struct("__pos", "__line"))
    out = marked.groupBy(*keys, "__id", "__row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["__line"]), "\n").alias("text"),
        F.count("*").alias("n_lines"),
        F.count("__fh").alias("n_dropped"),
    )
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(key)], F.col("text").alias(text), "n_lines", "n_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.row, d.doc_id, i AS pos, list_extract(l, i) AS line,
         translate(trim(list_extract(l, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.l) + 1)) AS i)
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY row, doc_id
"""
