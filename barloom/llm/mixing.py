"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

EPS = 1e-9
ITEM = "struct<id:bigint,k:bigint,s:bigint,p:double>"
DONE = "array<struct<id:bigint,k:bigint,s:bigint,up:bigint>>"


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source, from rows (source, size, n): source, source_size, n, target.

    Sources in code point order (null last) take the weights in turn and share ``total`` times all words; a
    target stops at ``cap`` times its source's words and the excess is shared again by weight. With sources
    ordered by cap/weight the stopped ones come first, so one pass of running sums finds the final share.
    The window runs over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    per = per.withColumn("share", share).withColumn("stopped", F.col("share") > F.col("cap") / F.col("w"))
    level = F.max(F.when(~F.col("stopped"), F.col("share"))).over(everything)
    return per.select("source", "source_size", "n", F.when(F.col("stopped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def _let(fields: dict[str, Column], body) -> Column:
    """Binds values once, then evaluates body with them."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])), body), 1)


def _fold(items: Column, seed: int) -> Column:
    """One bucket: the current item and the next one move words between them until one copy count is whole."""

    def whole(p: Column) -> Column:
        return (p < EPS) | (p > 1 - EPS)

    def done(x: Column, up: Column) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["k"].alias("k"), x["s"].alias("s"), up.cast("long").alias("up")))

    def moved(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["k"].alias("k"), x["s"].alias("s"), p.alias("p"))

    def fight(acc: Column, y: Column) -> Column:
        x = acc["cur"]
        u = F.pmod(F.xxhash64(F.lit(seed), x["id"], x["k"], x["s"], y["id"], y["k"], y["s"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        first = {"a": F.least((1 - x["p"]) * x["s"], y["p"] * y["s"]), "b": F.least(x["p"] * x["s"], (1 - y["p"]) * y["s"]), "u": u}

        def resolve(t: Column) -> Column:
            rises = t["u"] * (t["a"] + t["b"]) < t["b"]
            x_whole = F.when(rises, (1 - x["p"]) * x["s"] <= y["p"] * y["s"]).otherwise(x["p"] * x["s"] <= (1 - y["p"]) * y["s"])
            shift = F.when(rises, t["a"]).otherwise(-t["b"])  # words that x gains
            return F.when(
                x_whole,
                F.struct(moved(y, y["p"] - shift / y["s"]).alias("cur"), F.concat(acc["out"], done(x, rises)).alias("out")),
            ).otherwise(F.struct(moved(x, x["p"] + shift / x["s"]).alias("cur"), F.concat(acc["out"], done(y, ~rises)).alias("out")))

        return _let(first, resolve)

    def step(acc: Column, y: Column) -> Column:
        return (
            F.when(acc["cur"]["s"].isNull(), F.struct(y.alias("cur"), acc["out"].alias("out")))
            .when(whole(acc["cur"]["p"]), F.struct(y.alias("cur"), F.concat(acc["out"], done(acc["cur"], acc["cur"]["p"] > 0.5)).alias("out")))
            .otherwise(fight(acc, y))
        )

    start = F.struct(F.lit(None).cast(ITEM).alias("cur"), F.array().cast(DONE).alias("out"))
    return F.aggregate(items, start, step)


def _base() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + EPS)).otherwise(0).cast("long")


def _repair(settled: DataFrame, goal: DataFrame) -> DataFrame:
    """Turns over, in each source, the one document whose size best makes up what the root's rounding left.

    One row for each source comes back from a combining aggregate, so no source's rows meet in a task.
    """
    at = settled.join(goal, settled.source.eqNullSafe(goal.src)).withColumn("took", (_base() + F.col("up")) * F.col("s"))
    whole = cut(at.groupBy("source", "target", "source_size", "src_n").agg(F.sum("took").alias("took"), F.sum("s").alias("open_words")))
    # words of documents that take whole copies only are counted in the target already, where no document is open
    miss = whole.select(F.col("source").alias("msrc"), (F.col("target") * F.col("open_words") / F.col("source_size") - F.col("took")).alias("miss"))
    could = settled.join(miss, settled.source.eqNullSafe(miss.msrc)).where("(miss > 0 and up = 0) or (miss < 0 and up = 1)")
    left = F.abs(F.abs(F.col("miss")) - F.col("s"))
    turn = could.where(left < F.abs("miss")).groupBy(F.col("source").alias("tsrc")).agg(F.min(F.struct(left, "id", "k", "s")).alias("t"))
    turn = turn.select("tsrc", F.col("t.id").alias("tid"), F.col("t.k").alias("tk"), F.col("t.s").alias("ts"))
    hit = settled.source.eqNullSafe(turn.tsrc) & settled.id.eqNullSafe(turn.tid) & (settled.k == turn.tk) & (settled.s == turn.ts)
    return settled.join(turn, hit, "left").select("source", "id", "k", "s", F.when(F.col("ts").isNull(), F.col("up")).otherwise(1 - F.col("up")).alias("up"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, seed: int = 7, fan_in: int = 64) -> DataFrame:
    """How many copies of each row a mix takes so that every source's words come near its target.

    Returns doc_id, copy (numbers repeated identical rows from 1), source, size, source_size, target, copies and
    taken = copies * size. A source with target t and S words wants t/S copies of each of its documents: the
    whole part is certain and the fraction is settled by pivotal rounding. Two fractional documents move words
    between them, in a random direction weighted so that expectations stay, until one of them is whole; the
    other carries the residue on. Words are conserved by every move, so a source misses its target only by
    the rounding of the one residue at the root (to the nearer side, at most half of one document); then the
    one settled document that best makes up for it turns over.

    Buckets of about ``fan_in`` documents of one source (by hash, so reruns agree and a hot source spreads
    over many tasks) fold in one aggregate each; their residues meet ``fan_in`` at a time on the next level,
    up to one root for each source. Each level is checkpointed, and shuffles a ``fan_in``-th of the rows below.

    Identical (doc_id, source, size) rows are counted first and told apart by number, so a row repeated many
    times still spreads. Null or empty text has size 0 and takes 0; a null source is a source of its own, the
    last; a null doc_id is an id like any other. An empty table gives an empty table. No document takes more
    than ceil(cap) copies of itself, and none exceeds ``cap`` times its size for a whole cap.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).alias("source"), words(text).alias("size"))
    sizes = cut(slim.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    goal = cut(targets(sizes, weights, total, cap)).withColumnsRenamed({"source": "src", "n": "src_n"})
    rows = sizes.join(goal, sizes.source.eqNullSafe(goal.src)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(want + EPS).cast("long")).withColumn("p", F.greatest(want - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("open", (F.col("size") > 0) & (F.col("p") > EPS))
    most = goal.agg(F.max("src_n")).first()[0] or 0
    buckets = F.ceil(F.col("src_n") / F.lit(fan_in)).cast("long")
    level = rows.where("open").select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "id", "k", "size"), F.greatest(buckets, F.lit(1).cast("long"))).alias("bucket"),
        F.xxhash64(F.lit(seed + 1), "id", "k", "size").alias("h"),
        F.struct("id", "k", F.col("size").alias("s"), "p").alias("item"),
    )
    settled, width, at = None, math.ceil(most / fan_in), 0
    while True:
        items = F.transform(F.array_sort(F.collect_list(F.struct("h", F.col("item.id").alias("id"), F.col("item.k").alias("k"), "item"))), lambda x: x["item"])
        folded = cut(level.groupBy("source", "bucket").agg(items.alias("items")).select("source", "bucket", _fold(F.col("items"), seed + 2 + at).alias("f")))
        out = folded.select("source", F.explode("f.out").alias("o")).select("source", "o.*")
        settled = out if settled is None else settled.unionByName(out)
        residue = folded.where("f.cur.s is not null")
        if width <= 1:
            root = residue.select("source", "f.cur.id", "f.cur.k", "f.cur.s", (F.col("f.cur.p") >= 0.5).cast("long").alias("up"))
            settled = settled.unionByName(root)
            break
        level = residue.select("source", F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket"), F.xxhash64(F.lit(seed + 1), "bucket").alias("h"), F.col("f.cur").alias("item"))
        width, at = math.ceil(width / fan_in), at + 1
    settled = _repair(settled, goal)
    plain = rows.where("not open").select("source", "id", "k", F.col("size").alias("s"), F.lit(0).cast("long").alias("up"))
    both = settled.unionByName(plain)
    res = both.join(goal, both.source.eqNullSafe(goal.src))
    copies = F.when(F.col("s") > 0, _base() + F.col("up")).otherwise(F.lit(0).cast("long"))
    return res.select(
        F.col("id").alias(doc_id), F.col("k").alias("copy"), F.col("source").alias(source), F.col("s").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("s")).alias("taken")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
