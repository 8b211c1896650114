"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries of hash partitions, counted exactly in a second pass."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, tidied

#: Bits of one segment of a filter, and the most segments a filter has: 64 MB at any size of the data.
SEGMENT, SEGMENTS = 1 << 19, 1024
#: Rows of counts that a task gathers before it sums them, and sums before it hands them on.
GATHERED = 1_000_000
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
FOUND = "part int, keys binary, counts binary, lang string, phrase string, n long"

_KIND = np.zeros(256, np.uint8)  # 1 ends a word, 2 a piece too
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Text:
    """The words of a batch of texts, lower-cased: words, their text's number, and whether a word goes on from the one before in its piece.

    All delimiters are single bytes that UTF-8 uses for nothing else, so texts are cut as bytes.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        texts = texts.cast(pa.string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
        ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        stops = np.cumsum(kind == 2)[starts]
        self.follows = np.append(False, (stops[1:] == stops[:-1]) & (self.doc[1:] == self.doc[:-1]))[: len(starts)]
        at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]]))
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        langs = langs.cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[self.doc]
        self.key = mixed(hashed(self.words)[self.code] + mixed(hashed(self.langs))[self.lang])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams at each word, and whether there is one."""
        size = max(0, len(self.code) - n + 1)
        key, there = self.key[:size], np.ones(size, bool)
        for k in range(1, n):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.key[k : k + size])
            there = there & self.follows[k : k + size]
        return key, there

    def count(self, at: np.ndarray, key: np.ndarray, n: int) -> pa.Table:
        """Exact counts of the n-grams at the places ``at``."""
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        same = self.lang[at] == self.lang[at[first]][inverse]
        for k in range(n):
            same &= self.code[at + k] == self.code[at[first] + k][inverse]
        if not same.all():  # two n-grams with one hash: tell them apart by their words
            rows = np.stack([self.lang[at], *(self.code[at + k] for k in range(n))], 1)
            _, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        parts = [self.words.take(pa.array(self.code[at[first] + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return pa.table([self.langs.take(pa.array(self.lang[at[first]])), phrase, pa.array(np.bincount(inverse.ravel(), minlength=len(first)))], schema=COUNTS)

    def totals(self) -> pa.Table:
        """The number of words of each language, as counts of the empty phrase."""
        n = np.bincount(self.lang, minlength=len(self.langs))
        return pa.table([self.langs, pa.array([""] * len(n)), pa.array(n)], schema=COUNTS)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


def phrase_keys(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hashes that Text gives the n-grams, from their texts."""
    text = Text(phrase, lang)
    starts = np.flatnonzero(np.append(True, text.doc[1:] != text.doc[:-1])[: len(text.doc)])
    size = np.diff(np.append(starts, len(text.doc)))
    key = text.key[starts]
    for k in range(1, int(size.max(initial=1))):
        more = size > k
        key[more] = mixed(key[more] * np.uint64(0x9E3779B97F4A7C15) + text.key[starts[more] + k])
    return key


def shortened(keys: np.ndarray, parts: int) -> np.ndarray:
    """A key's hash partition and 32 bits of its hash: enough inside one partition, whose mass is bounded; who shares them is told apart by text."""
    return (keys >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


# -- summaries --------------------------------------------------------------------------------------------


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse.ravel(), counts, len(keys)).astype(np.int64) if counts.sum() < 1 << 53 else _exact_sums(inverse, counts, len(keys))


def _exact_sums(inverse: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, inverse.ravel(), counts)
    return out


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters; summaries of one hash partition merge into one.

    Over the capacity every counter is lowered by the first one that has no room. Each unit of ``lowered`` has
    then taken one from more than ``capacity`` counters, so ``lowered`` is at most mass / (capacity + 1), and a
    key's true count is between its counter (0 if it has none) and the counter plus ``lowered``.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lowered = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lowered: int = 0) -> None:
        self.keys, self.counts = summed(np.append(self.keys, keys), np.append(self.counts, counts))
        self.lowered += lowered
        if len(self.keys) > self.capacity:
            cut_at = len(self.keys) - self.capacity - 1
            by = int(np.partition(self.counts, cut_at)[cut_at])
            left = self.counts > by
            self.keys, self.counts = self.keys[left], self.counts[left] - by
            self.lowered += by

    def may_reach(self, least: int) -> np.ndarray:
        """Every key whose true count is ``least`` or more, and some below."""
        return self.keys[self.counts + self.lowered >= least]


def survivors(summaries: pa.Table, least: int) -> pa.Table:
    """Merges what the tasks have of one hash partition; the capacity exceeds its mass divided by ``least``."""
    high = np.uint64(summaries.column("part")[0].as_py()) << np.uint64(32)
    blobs = [(np.frombuffer(k, "<u4") | high, np.frombuffer(zlib.decompress(c), "<i8")) for k, c in zip(summaries.column("keys").to_pylist(), summaries.column("counts").to_pylist(), strict=True)]
    summary = Summary(sum(int(c.sum()) for _, c in blobs) // least + 1)
    for keys, counts in blobs:
        summary.merge(keys, counts)
    return pa.table({"key": summary.may_reach(least).view(np.int64)})


# -- filters ----------------------------------------------------------------------------------------------


class Filter:
    """Bits of key hashes in segments; never denies a key that is in it. Its size has a fixed bound: with more keys it lets more through."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8).reshape(-1, SEGMENT // 8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        segment, out = segment_of(keys, len(self.bits)), np.ones(len(keys), bool)
        for bit in bits_of(keys):
            out &= (self.bits[segment, bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def bits_of(keys: np.ndarray) -> list[np.ndarray]:
    keys = mixed(keys + np.uint64(1))
    return [(keys >> np.uint64(s)) & np.uint64(SEGMENT - 1) for s in (0, 20, 40)]


def make_filter(keys: DataFrame) -> bytes:
    """The bits of a filter of the column ``key``: segments are made by tasks of their own and come to the driver as at most 64 MB."""
    n = min(SEGMENTS, max(1, -(-keys.count() * 16 // SEGMENT)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(k.view(np.uint64), n).astype(np.int32)), batch.column(0)], names=["segment", "key"])

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(SEGMENT, bool)
        for batch in batches:
            for bit in bits_of(batch.column("key").to_numpy().view(np.uint64)):
                on[bit.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    made = keys.mapInArrow(place, "segment int, key long").groupBy("segment").applyInArrow(fill, "segment int, bits binary")
    bits = {r["segment"]: bytes(r["bits"]) for r in made.collect()}
    return b"".join(bits.get(i, bytes(SEGMENT // 8)) for i in range(n))


# -- passes -----------------------------------------------------------------------------------------------


class Gatherer:
    """Sums of what a task has counted; what exceeds the limit is handed on."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.keys, self.counts, self.rows, self.grams = [], [], 0, 0

    def add(self, counted: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(counted)
        self.rows += counted.num_rows
        if self.rows > GATHERED:
            yield from self.phrases(GATHERED // 2)

    def phrases(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if self.tables:
            total = pa.concat_tables(self.tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(COUNTS.names)
            self.tables, self.rows = [total], total.num_rows
            if total.num_rows > most:
                self.tables, self.rows = [], 0
                for batch in total.to_batches(max_chunksize=50_000):
                    none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*none, *batch.columns], names=["part", "keys", "counts", *COUNTS.names])

    def add_keys(self, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64))
        self.grams += len(keys)
        if self.grams > 4 * GATHERED:
            yield from self.summaries(parts, 2 * GATHERED)

    def summaries(self, parts: int, most: int = 0) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.grams = [keys], [counts], len(keys)
        if len(keys) <= most or not len(keys):
            return
        self.keys, self.counts, self.grams = [], [], 0
        ends = np.searchsorted(keys, np.arange(1, parts + 1, dtype=np.uint64) << np.uint64(32))  # keys are sorted, and their partition comes first
        for p, mine in enumerate(map(slice, np.append(0, ends[:-1]).tolist(), ends.tolist())):
            if mine.start < mine.stop:
                blobs = [pa.array([x], pa.binary()) for x in (keys[mine].astype("<u4").tobytes(), zlib.compress(counts[mine].astype("<i8").tobytes(), 1))]
                none = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *blobs, *none], names=["part", "keys", "counts", *COUNTS.names])


def scan(docs: DataFrame, n: int, known: bytes | None, count: bool, summarise: bool, parts: int) -> DataFrame:
    """One pass over all texts: exact counts of the n-grams that ``known`` has (all without it), and summaries of the (n+1)-grams that consist of two such."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gathered = sent.value and Filter(sent.value), Gatherer()
        for batch in batches:
            text = Text(batch.column(1), batch.column(0))
            key, there = text.grams(n)
            at = np.flatnonzero(there)
            if known is not None:
                at = at[known.has(shortened(key[at], parts))]
            if n == 1:
                yield from gathered.add(text.totals())
            if count:
                yield from gathered.add(text.count(at, key[at], n))
            if summarise:
                good = np.zeros(len(key) + 1, bool)
                good[at] = True
                longer, there = text.grams(n + 1)
                yield from gathered.add_keys(shortened(longer[there & good[: len(longer)] & good[1 : 1 + len(longer)]], parts), parts)
        yield from gathered.phrases()
        yield from gathered.summaries(parts)

    return docs.mapInArrow(tidied(run, keep=True), FOUND)


def counts_of(found: DataFrame) -> DataFrame:
    return found.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, mass: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``least`` times or more in their language: (lang, phrase, size, f); and the words of each language: (lang, n).

    Words are counted first. Then, length by length, a pass sums hashes of those n-grams whose two shorter parts may
    be frequent, by hash partitions of about ``mass`` occurrences, 4 bytes a hash; summaries merge, and what may reach ``least`` becomes a
    filter; the next pass counts what passes the filter by its text, and sums the next length on the way. The filter
    may let rarer n-grams through, never hold a frequent one back; counts are by text, so they do not depend on hashes.
    """
    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    words = cut(counts_of(scan(slim, 1, None, True, False, 1)).where((F.col("f") >= least) | (F.col("phrase") == "")))
    sizes = words.where("phrase = ''").select("lang", F.col("f").alias("n"))
    counted = [words.where("phrase <> ''").withColumn("size", F.lit(1))]
    parts = max(1, -(-int(sizes.agg(F.sum("n")).first()[0] or 0) // mass))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shortened(phrase_keys(batch.column(0), batch.column(1)), parts).view(np.int64))], names=["key"])

    known = make_filter(cut(counted[0].select("lang", "phrase").mapInArrow(keys_of, "key long")))

    def may(group: pa.Table) -> pa.Table:
        return survivors(group, least)

    for n in range(1, longest + 1):
        last = n == longest
        found = cut(scan(slim, n, known, n > 1, not last, parts))
        if n > 1:
            counted.append(counts_of(found).where(F.col("f") >= least).withColumn("size", F.lit(n)))
        if not last:
            known = make_filter(cut(found.where("part is not null").select("part", "keys", "counts").groupBy("part").applyInArrow(may, "key long")))
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return cut(out), sizes


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z) and do not cross ``.,;:!?`` or line ends. A phrase of 2 to ``longest`` words with
    a >= ``least`` occurrences is cut behind its first k words into parts with l and r occurrences; its lowest
    floor(scale * a / (l + r)) counts, ties to the smallest k. Phrases inside a longer one that has at least
    ``inside`` percent of their occurrences go. n is the number of words of the language.

    A null lang is ``und``, a null or empty text has no words, repeated rows count as often as they stand, other columns are
    ignored, and an empty table gives an empty table. Scores are computed in decimals. Ties go by a, then by the phrase's bytes.
    """
    phrases, sizes = frequent_phrases(docs, lang, text, longest, least)
    word = F.split("phrase", " ", -1)
    cand = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", word.alias("w"))
    piece = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda n: phrases.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(f"{n}_phrase"), F.col("f").alias(n))
    both = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase")))
    both = both.join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    both = both.withColumn("score", F.expr(f"cast({scale} * cast(a as decimal(28,0)) div (cast(l as decimal(37,0)) + cast(r as decimal(37,0))) as long)"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spans = cand.where("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)")))
    longer = spans.select(F.col("lang").alias("i_lang"), F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("i_phrase"), F.col("a").alias("b")).groupBy("i_lang", "i_phrase").agg(F.max("b").alias("b"))
    big = lambda c: F.col(c).cast("decimal(28,0)")
    covered = 100 * big("b") >= inside * big("a")
    kept = best.join(longer, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left").where(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = sizes.select(F.col("lang").alias("n_lang"), "n")
    return ranked.join(n, F.col("lang") == F.col("n_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS v(k)
), c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), d AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 30
), u AS MATERIALIZED (SELECT lang, phrase, a, v.j, array_to_string(w[1 : v.j], ' ') AS first, array_to_string(w[v.j + 1 :], ' ') AS rest FROM d, range(1, 4) AS v(j) WHERE v.j < d.k
), s AS (
  SELECT u.lang, u.phrase, u.a, u.j, x.f AS l, y.f AS r, CAST((2000000 * u.a::HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM u JOIN c x ON x.lang = u.lang AND x.phrase = u.first JOIN c y ON y.lang = u.lang AND y.phrase = u.rest
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), i AS (SELECT d.lang, array_to_string(d.w[o.o : o.o + m.m - 1], ' ') AS phrase, max(d.a) AS b FROM d, range(2, 4) AS m(m), range(1, 4) AS o(o) WHERE m.m < d.k AND o.o + m.m - 1 <= d.k GROUP BY ALL
)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS BIGINT) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang) n ON n.lang = b.lang
WHERE i.b IS NULL OR 100 * i.b < 80 * b.a
QUALIFY rank <= 2000
"""
