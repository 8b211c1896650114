"""The pipeline's stages on the smallest table, and the contract of their columns."""

import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    before = {r["doc_id"] for r in docs.collect()}
    seen = []
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, SF))
        seen.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == P.COLUMNS
        if name == "language_id":
            assert {r["doc_id"] for r in docs.collect()} == before  # every text has letters
        if name == "ngram_jaccard":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert [n for n, _ in seen] == ["language_id", "line_dedup", "ngram_jaccard", "source_mix", "packing"]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_lines(rows):
    holders = {}
    for r in rows:
        for line in {lower(x.strip(WHITE)) for x in (r["text"] or "").split("\n")}:
            holders.setdefault(line, set()).add(r["doc_id"])
    return ["\n".join(x for x in (r["text"] or "").split("\n") if not (k := lower(x.strip(WHITE))) or len(holders[k]) < 10) for r in rows]


def test_stages_against_plain_versions(spark, odd):
    """Each stage on the same odd rows: nulls, empty and long texts, repeated rows, near copies, common lines, clashing columns."""
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    common = spark.range(12).select((F.col("id") + 5000).alias("doc_id"), F.concat(F.lit("Shared line here\n \nown "), F.col("id").cast("string"), F.lit(" words of it")).alias("text"))
    docs = P.cut(docs.unionByName(common, allowMissingColumns=True))
    rows = docs.select("doc_id", "text").collect()
    stages = dict(P.STAGES)

    kept = stages["language_id"](spark, docs, SF).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in rows if any(c.isalpha() for c in r["text"] or ""))
    nameless = stages["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).select("doc_id", "text").collect()
    assert Counter(map(tuple, nameless)) == Counter(map(tuple, kept))

    made = stages["line_dedup"](spark, docs, SF).select("doc_id", "text", "n_chars").collect()
    assert Counter(map(tuple, made)) == Counter((r["doc_id"], t, len(t)) for r, t in zip(rows, plain_lines(rows), strict=True))

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    group = {i: i for i, _ in sets}
    for _ in range(4):
        for i, x in sets:
            for j, y in sets:
                if x and y and 4 * len(x) >= 3 * len(y) and 4 * len(y) >= 3 * len(x) and group[i] != group[j] and 100 * len(x & y) >= 75 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    left = stages["ngram_jaccard"](spark, docs, SF).select("doc_id").collect()
    assert Counter(r[0] for r in left) == Counter([i for i, g in group.items() if i == g] + [None])

    mixed = stages["source_mix"](spark, docs, SF)
    out = Counter(map(tuple, mixed.select("doc_id", "text").collect()))
    have = Counter(map(tuple, rows))
    assert set(out) <= set(have) and all(n <= 2 * have[k] for k, n in out.items()) and out == Counter(map(tuple, stages["source_mix"](spark, docs, SF).select("doc_id", "text").collect()))
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    got = sum(n * len(re.findall(r"[^\x20\x09-\x0D]+", k[1] or "")) for k, n in out.items())
    assert 1.2 * total < got < 1.7 * total

    packed = stages["packing"](spark, docs, SF).toPandas()
    per = packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (per.length.cumsum() - packed.sort_values(["sequence_id", "offset"]).length == packed.sort_values(["sequence_id", "offset"]).offset).all() and per.length.sum().max() <= 1024
    assert Counter(packed[packed.piece == 0].doc_id.fillna(-1)) == Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)


def test_run(spark):
    docs = P.run(spark, SF)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0 and docs.count() > 100


def test_near_duplicates_keep_every_different_text(spark):
    """An id with several texts loses none of them, also where one is a copy of a smaller id's; reruns agree."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "de", None), (2, "one two three four five six", "en", "b"), (3, text, "en", "b"), (0, text, "en", "z"), (0, text, "en", "z"), (None, text, "en", "z"), (4, None, "en", "a"), (4, "", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(0, text, "en", "z"), (1, text, "en", "a"), (1, rows[1][1], "de", None), (4, None, "en", "a"), (4, "", "en", "a"), (None, text, "en", "z")]
    for df in (docs, docs.repartition(5)):
        got = [tuple(r)[:4] for r in P.near_duplicates(spark, df, "").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_keeps_executors_small(spark, monkeypatch):
    """No Python rows are dealt out (they start a second daemon with workers in each executor); few rows go to Python at once."""
    docs = spark.createDataFrame([(i, "one two three " * (40 * i + 1)) for i in range(30)], "doc_id long, text string").cache()
    assert docs.count() == 30

    def dealt(*_, **__):
        raise AssertionError("rows of Python")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", dealt)
    packed = dict(P.STAGES)["packing"](spark, docs, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 250
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(range(30)) and sum(r["length"] for r in rows if r["doc_id"] == 0) == 5
