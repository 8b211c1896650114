"""Chat formatting in budgeted windows of whole turns, with a loss mask that covers each target once."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Marks around a turn of each role; any other role is written in hex inside ROLE marks.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<ROLE:(?P<hex>[0-9A-F]*)>>(?P<other>.*?)<</ROLE>>", re.DOTALL)
ESCAPED = re.compile(r"([<\[])\\|\\\\")


def escape(text: Column) -> Column:
    """Every mark begins with < or [, so a backslash behind each of these (and a doubled backslash) keeps marks out of texts."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] or "\\", text)


def _tokens(vocab: str):
    """Arrow function that appends n_tok, the tokens of the segment column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocab), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("vocab", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(s)) for s in batch.column("seg").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tok"])

    return count


def chat_windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 192, least: int = 128, vocab: str = "byte_bpe_50k.tiktoken", block: int = 128) -> DataFrame:
    """Formats conversations in windows of whole turns: conv_id, window, text, loss, fresh_from, n_turns, n_tokens.

    A running sum of turn tokens over the conversation places each turn; turns that begin in the same cell of
    ``body`` tokens make one window, so windows need no sequential cutting. ``body`` is the budget less the
    system turn, the history and the conversation's longest turn, and ``least`` at the least: windows keep to
    the budget unless single turns leave no room. A window begins with the system turn (the first turn, if
    its role is system), then repeats those turns of the window before that fit ``history`` tokens at its end.
    ``loss`` holds (start, end) code points of the assistant texts that are new in the window; repeated ones
    are outside the mask, so each target is learned once. ``fresh_from`` is where the new turns begin.

    Turns are ordered by turn (null first), role and text; repeated rows are repeated turns. A null text or
    role is empty, a null conv_id is a conversation; empty texts make turns without content. Roles other than
    system, user and assistant keep their name in the marks. An empty table gives an empty table.

    Running sums go by blocks of ``block`` turns first, so a very long conversation spreads over many tasks;
    a window's rows are bounded by its tokens.
    """
    name = F.coalesce(F.col(role), F.lit(""))
    esc = escape(F.coalesce(F.col(text), F.lit("")))
    head, tail = F.concat(F.lit("<<ROLE:"), F.hex(F.encode(name, "utf-8")), F.lit(">>")), F.lit("<</ROLE>>")
    for r, (a, b) in MARKS.items():
        head, tail = F.when(name == r, F.lit(a)).otherwise(head), F.when(name == r, F.lit(b)).otherwise(tail)
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), esc.alias("esc"))
    rows = rows.select("conv", "turn", "role", F.concat(head, "esc", tail).alias("seg"), F.length(head).alias("n_head"), F.length("esc").alias("n_esc"))
    schema = "conv {}, turn long, role string, seg string, n_head int, n_esc int, n_tok long".format(rows.schema["conv"].dataType.simpleString())
    rows = rows.mapInArrow(_tokens(vocab), schema).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))

    # running sums: of blocks, then inside each block
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("n_tok").alias("b_tok"), F.count("*").alias("b_n"), F.max("n_tok").alias("b_most"), F.min(F.struct(F.col("turn").isNotNull().alias("t0"), "turn", "role", "seg", "n_tok")).alias("b_first")
    )
    over = Window.partitionBy("conv")
    past = over.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    first = F.min("b_first").over(over)
    system = F.when(first["role"] == "system", first)
    blocks = blocks.select(
        "conv",
        "block",
        F.coalesce(F.sum("b_tok").over(past), zero).alias("tok0"),
        F.coalesce(F.sum("b_n").over(past), zero).alias("seq0"),
        F.sum("b_tok").over(over).alias("all_tok"),
        F.max("b_most").over(over).alias("most"),
        F.when(F.row_number().over(over.orderBy("block")) == 1, system["seg"]).alias("sys_seg"),
        F.coalesce(system["n_tok"], zero).alias("sys_tok"),
    )
    b = blocks.withColumnsRenamed({"conv": "b_conv", "block": "b_block"}).drop("sys_seg")
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "seg")
    rows = rows.join(b, rows.conv.eqNullSafe(b.b_conv) & (rows.block == b.b_block))
    rows = rows.withColumn("end", F.col("tok0") + F.sum("n_tok").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("seq", F.col("seq0") + F.row_number().over(inside)).withColumn("start", F.col("end") - F.col("n_tok"))
    body = F.greatest(F.lit(budget - history) - F.col("sys_tok") - F.col("most"), F.lit(least))
    rows = rows.withColumn("window", F.floor(F.col("start") / body).cast("long"))
    # a window ends where the next one's first turn starts
    spans = Window.partitionBy("conv", "window")
    rows = rows.withColumn("stop", F.max("end").over(spans)).withColumn("next", F.when(F.col("stop") < F.col("all_tok"), F.floor(F.col("stop") / body).cast("long")))
    seg = lambda part, fresh: F.struct(F.lit(part).alias("part"), F.col("seq"), F.col("seg"), (F.lit(fresh) & (F.col("role") == "assistant")).alias("loss"), "n_head", "n_esc", "n_tok", F.lit(fresh).alias("fresh"))
    is_system = (F.col("seq") == 1) & (F.col("role") == "system")
    own = F.struct("window", seg(2, True).alias("s"))
    again = F.when(F.col("next").isNotNull() & (F.col("start") >= F.col("stop") - history) & ~is_system, F.struct(F.col("next").alias("window"), seg(1, False).alias("s")))
    placed = rows.select("conv", F.explode(F.array_compact(F.array(own, again))).alias("x")).select("conv", "x.window", "x.s")
    windows = placed.groupBy("conv", "window").agg(F.array_sort(F.collect_list("s")).alias("s"))
    lead = blocks.where("sys_seg is not null").select(F.col("conv").alias("s_conv"), "sys_seg", "sys_tok")
    windows = windows.join(lead, windows.conv.eqNullSafe(lead.s_conv) & (F.col("window") > 0), "left")
    add = F.struct(F.lit(0).alias("part"), zero.alias("seq"), F.col("sys_seg").alias("seg"), F.lit(False).alias("loss"), F.lit(0).alias("n_head"), F.lit(0).alias("n_esc"), F.col("sys_tok").alias("n_tok"), F.lit(False).alias("fresh"))
    windows = windows.withColumn("s", F.when(F.col("sys_seg").isNotNull(), F.concat(F.array(add), "s")).otherwise(F.col("s")))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def mark(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["n_head"]
        spans = F.when(x["loss"], F.concat(acc["loss"], F.array(F.struct(at.alias("start"), (at + x["n_esc"]).alias("end"))))).otherwise(acc["loss"])
        return F.struct((acc["at"] + F.length(x["seg"])).alias("at"), spans.alias("loss"))

    repeats = F.filter("s", lambda x: ~x["fresh"])
    chars = lambda a: F.aggregate(a, zero, lambda n, x: n + F.length(x["seg"]))
    return windows.select(
        F.col("conv").alias(conv_id),
        "window",
        F.array_join(F.transform("s", lambda x: x["seg"]), "").alias("text"),
        F.aggregate("s", F.struct(zero.alias("at"), none.alias("loss")), mark)["loss"].alias("loss"),
        chars(repeats).alias("fresh_from"),
        (F.size("s") - F.size(repeats)).cast("long").alias("n_turns"),
        F.aggregate("s", zero, lambda n, x: n + x["n_tok"]).alias("n_tokens"),
    )


def read_windows(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Parses formatted windows back: conv_id, window, turns (role, text) that are new in it, learned (text under the mask), n_chars.

    Raises if the text does not parse as whole turns from fresh_from to its end. A window without new turns
    gives an empty list; an empty table gives an empty table.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, learned, size = [], [], []
            for text, loss, at in zip(*(batch.column(c).to_pylist() for c in ("text", "loss", "fresh_from")), strict=True):
                found = []
                while at < len(text):
                    m = TURN.match(text, at)
                    if m is None:
                        raise ValueError(f"no turn at {at}")
                    role = m.lastgroup if m["hex"] is None else bytes.fromhex(m["hex"]).decode()
                    found.append({"role": role, "text": unescape(m[m.lastgroup])})
                    at = m.end()
                turns.append(found)
                learned.append("".join(unescape(text[x["start"] : x["end"]]) for x in loss))
                size.append(len(text))
            made = [pa.array(turns, kind), pa.array(learned, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("window"), *made], names=["conv", "window", "turns", "learned", "n_chars"])

    slim = windows.select(F.col(conv_id).alias("conv"), "window", "text", "loss", "fresh_from")
    schema = "conv {}, window long, turns array<struct<role:string,text:string>>, learned string, n_chars long".format(slim.schema["conv"].dataType.simpleString())
    return slim.mapInArrow(parse, schema).withColumnRenamed("conv", conv_id)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trial).alias("text"))
    back = read_windows(chat_windows(rows.unionByName(planted)))
    part = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", part.alias("part"), F.size("turns").alias("n"), "learned", "n_chars")
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", F.col(c).alias("v")))), lambda x: x["v"]), "")
    out = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), in_order("part").alias("turns"), in_order("learned").alias("learned"), F.sum("n_chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
