"""N-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, small_batches, small_side, table, tidied, tidy_worker

#: Odd multipliers, one for each place in a shingle (fixed values).
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (wrapping)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int, step: int = 2_000_000) -> Iterator[np.ndarray]:
    """For each whole text, the sorted distinct 64-bit hashes of its n-word shingles (all words as one, if fewer).

    Works on about ``step`` bytes of whole texts at a time, so its memory does not follow the batch.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + step, "right")))
        yield from _shingle_sets(texts.take(pa.array(np.arange(lo, hi))), n)  # a copy: some kernels misread slices
        lo = hi


def _shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    words = lists.flatten()
    at = lists.offsets.to_numpy()
    at = at - at[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    kept = np.concatenate(([0], np.cumsum(full)))[at]
    coded = words.filter(pa.array(full)).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = hashes[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    if len(w) >= n:
        size = len(w) - n + 1
        every = w[:size] * PLACES[0]
        for i in range(1, n):
            every = every + w[i : size + i] * PLACES[i]
        every = _mix(every)
    for lo, hi in zip(kept[:-1], kept[1:], strict=True):
        k = hi - lo
        if k >= n:
            s = np.sort(every[lo : hi - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif k:
            yield _mix((w[lo:hi] * PLACES[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))
        else:
            yield np.empty(0, np.uint64)


def _needed(size: int, t: int) -> int:
    """Tokens that a set must share with any set to which it is similar: t percent of its own."""
    return -(-t * size // 100)


def _links(common: int, a: int, b: int, t: int) -> bool:
    return 100 * common >= t * (a + b - common)


def _ranges(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of the hash space that each token lies in, and 32 bits that tell tokens of a range apart."""
    v = (tokens >> np.uint64(24)) * np.uint64(ranges)
    return (v >> np.uint64(40)).astype(np.int64), (v >> np.uint64(8)).astype(np.uint32)


def frequent_tokens(docs: DataFrame, text: str, n: int, one_in: int, least: int, most: int, seed: int, bucket: int = 1_000_000) -> np.ndarray:
    """The upper 32 bits of tokens in ``least`` sampled texts or more (one text in ``one_in``), sorted; ``most`` at the most.

    The sample grows with the table, so ``least`` means the same number of texts at every size. Tasks send packets
    of bits by range of the hash space, a range's packets are counted together; where more than ``most`` tokens
    qualify, the most frequent are taken, by a histogram of counts. These tokens only come last in the order
    of tokens; any list gives the same links.
    """
    few = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(one_in)) == 0)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    ranges = max(1, -(-size // (6 * one_in * bucket)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        held, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held)) >> np.uint64(32)
            held.clear()
            at = np.searchsorted(x * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
            some = [i for i in range(ranges) if at[i] < at[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary())], names=["range", "packet"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                if len(s) and (d := xxhash.xxh3_64_intdigest(s.tobytes())) not in seen:
                    seen.add(d)  # copies in one task count once
                    held.append(s)
                    size += len(s)
                if size > bucket:
                    yield out()
                    size = 0
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list] = {}
        for batch in batches:
            for r, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_range.setdefault(r, []).append(np.frombuffer(b, np.uint32))
        for parts in by_range.values():
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[c >= least].astype(np.int64)), pa.array(c[c >= least].astype(np.int64))], names=["token", "c"])

    found = cut(few.mapInArrow(tidied(send), "range int, packet binary").repartition(ranges, "range").mapInArrow(tidied(count), "token long, c long"))
    level = F.floor(F.log2("c") * 16).cast("long")
    steps = sorted(((r["level"], r["k"]) for r in found.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    from_level, total = None, 0
    for at, k in steps:
        if total + k > most:
            break
        from_level, total = at, total + k
    if from_level is None:
        return np.empty(0, np.uint32)
    # one job, 8 bytes a token; an iterator over rows would start one for each partition
    return np.sort(found.where(level >= from_level).select("token").toArrow().column(0).to_numpy().astype(np.uint32))


def _late(tokens: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens are on the list of frequent ones."""
    bits = (tokens >> np.uint64(32)).astype(np.uint32)
    return last[np.minimum(np.searchsorted(last, bits), len(last) - 1)] == bits if len(last) else np.zeros(len(tokens), bool)


def _bands(sizes: np.ndarray, t: int) -> np.ndarray:
    """Numbers of bands of set sizes; any two sizes of one band may be similar."""
    return np.floor(np.log(sizes) / np.log(100 / t)).astype(np.int32) if 0 < t < 100 else sizes.astype(np.int32)


def token_lists(described: DataFrame, hot, bucket: int, percent: int) -> DataFrame:
    """(token, cid, c, band): the classes of each prefix token that two classes or more hold; c is the first of the list.

    Tasks send packets of about ``bucket`` tokens in all, by range of the hash space; a range's packets are
    sorted together and tokens of one class go, so each token travels once, in 12 bytes. Frequent tokens (late)
    are not brought together: each lot of them stays with the packets of a task, so that no list has to meet
    in one task, and keeps tokens of one class. Each band of set sizes in a lot has a first class of its own, so that
    a passage that texts of several lengths quote has a star in each; it is the class with the largest share of
    frequent tokens, of near copies the one with the fewest changes. The band of a token that is not frequent is -1.
    """
    ranges = max(1, -(-int(described.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0]) // (8 * bucket)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, cls, sizes, size = hot.value, [], [], [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            c = np.repeat(np.array(cls, np.int64), [len(v) for v in held])
            late = _late(x, last)
            r, low = _ranges(x, ranges)
            rows = []
            order = np.flatnonzero(~late)
            order = order[np.argsort(r[order], kind="stable")]
            at = np.searchsorted(r[order], np.arange(ranges + 1))
            for i in np.flatnonzero(at[1:] > at[:-1]):
                mine = order[at[i] : at[i + 1]]
                rows.append((int(i), False, low[mine].tobytes(), c[mine].tobytes(), None, None))
            if late.any():
                whole = (r[late].astype(np.int64) << 32) | low[late].astype(np.int64)
                size = np.array([len(v) for v in held])
                alone = 1 - np.add.reduceat(late, np.cumsum(size) - size, dtype=np.int64) / size
                band = np.repeat(_bands(np.array(sizes, np.int64), percent), size)[late]
                rows.append((int(cls[0] % ranges), True, whole.tobytes(), c[late].tobytes(), np.repeat(alone, size)[late].astype(np.float32).tobytes(), band.tobytes()))
            held.clear()
            cls.clear()
            sizes.clear()
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v[j] for v in rows], k) for j, k in enumerate(kinds)], names=["range", "late", "tokens", "classes", "alone", "bands"])

        for batch in batches:
            for h, n, b in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                if b:
                    held.append(np.frombuffer(b, np.uint64))
                    cls.append(h)
                    sizes.append(n)
                    size += len(held[-1])
                if size > bucket:
                    yield out()
                    size = 0
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        lots: dict[tuple, list] = {}
        for batch in batches:
            for r, late, t, c, a, b in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                lots.setdefault((r, late), []).append((np.frombuffer(t, np.int64 if late else np.uint32), np.frombuffer(c, np.int64), np.frombuffer(a or b"", np.float32), np.frombuffer(b or b"", np.int32)))
        for (r, late), parts in lots.items():
            token, cid, alone, band = (np.concatenate([p[j] for p in parts]) for j in (0, 1, 2, 3))
            parts.clear()
            order = np.argsort(token, kind="stable")
            if not late:  # most tokens are alone: only the others are sorted by class
                s = token[order]
                same = s[1:] == s[:-1]
                order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            order = order[np.lexsort((cid[order], alone[order], band[order], token[order]) if late else (cid[order], token[order]))]
            token, cid, band = token[order].astype(np.int64), cid[order], band[order] if late else np.full(len(order), -1, np.int32)
            new = np.ones(len(token), bool)  # copies described by several tasks are one
            new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
            token, cid, band = token[new], cid[new], band[new]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
            c = cid[begin]
            if not late:
                several = ~(first & np.append(first[1:], True))
                token, cid, c, band = token[several] + (r << 32), cid[several], c[several], band[several]
            for lo in range(0, len(token), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(cid[part]), pa.array(c[part]), pa.array(band[part])], names=["token", "cid", "c", "band"])

    sent = described.where("h is not null").select("h", "n", "prefix").mapInArrow(tidied(send), "range int, late boolean, tokens binary, classes binary, alone binary, bands binary")
    return cut(sent.repartition(ranges, "range").mapInArrow(tidied(meet), "token long, cid long, c long, band int"))


def _open_groups(key: tuple, group: pa.Table, t: int) -> pa.Table:
    """One group and a block of queries: the group's token union bounds each overlap, qualifying queries are compared."""
    member = group.column("member").to_numpy(zero_copy_only=False)
    ids = group.column("cid").to_numpy()
    sets = [np.frombuffer(b, np.uint64) for b in group.column("tokens").to_pylist()]
    own = np.flatnonzero(member)
    tokens = np.concatenate([sets[i] for i in own]) if len(own) else np.empty(0, np.uint64)
    holder = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    union = np.unique(tokens)
    sizes = np.array([len(sets[i]) for i in own], np.int64)
    a, b = [], []
    for q in np.flatnonzero(~member):
        s = sets[q]
        at = np.minimum(np.searchsorted(union, s), max(len(union) - 1, 0))
        if not len(union) or int((union[at] == s).sum()) < _needed(len(s), t):
            continue
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = hi - lo
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(holder[where], minlength=len(own))
        hit = np.flatnonzero(100 * common >= t * (sizes + len(s) - common))
        if len(hit):  # the group is connected already: one link to its name joins the query to all of it
            a.append(ids[q])
            b.append(key[0].as_py())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, one_in: int = 4, frequent: int = 4, most_frequent: int = 4_000_000, bucket: int = 1_000_000, centres: int = 2, group: int = 256, group_tokens: int = 400_000, queries: int = 512, seed: int = 9) -> DataFrame:
    """Classes of texts linked by Jaccard similarity of word shingles: doc_id, n_shingles, component_id.

    Two texts link when 100 * |both| >= percent * |either| over their sets of distinct ``words``-word
    shingles (A-Z lower-cased; a shorter text is one shingle; no words, no links). component_id is the
    smallest doc_id that links reach. Exact but for collisions of 64-bit hashes.

    1. Equal sets collapse to one class (the 64-bit hash of the set), so copies cost nothing further.
    2. Tokens have one order: those in about ``one_in * frequent`` texts or more last, then by hash. Similar sets of
       sizes a and b must meet in their first a - ceil(percent a) + 1 and b - ... tokens, so only these prefixes matter;
       each travels once, by range of the hash space, and tokens that one class alone holds end there. The list of
       frequent tokens is the one thing broadcast: ``most_frequent`` entries of 4 bytes at the most, the same links whatever it holds.
    3. In each token's list the classes are held against the first one (a star, not all pairs), in those of frequent
       tokens against the first of their band of sizes. A class is compared
       with the ``centres`` it meets most often by whole sets; verified links make the groups of similar texts, in
       blocks of at most ``group`` members. This only finds groups; what it misses, steps 4 and 5 find.
    4. The token-group matrix (token, group) holds the union of each group's prefixes. A text's overlap with a
       group it is not in is counted in the matrix; if too small for any size in the group, the group stays shut. What
       has fewer tokens left in other groups than a link needs is not counted.
    5. Open groups get the text: the union of all their tokens bounds it again, then members are compared.
    6. All links found are joined to components.

    Rows that share a doc_id are one document's versions and share a class; null texts, texts without words
    and null ids keep their own id as component. Repeated rows come back as often as they came. An empty
    table gives an empty table. Long texts cost by length, once; no list or group is held whole unless it is
    within the stated block sizes, and adaptive execution splits the joins on hot tokens.
    """
    with small_batches(docs.sparkSession, 500):
        return _similar(docs, doc_id, text, words, percent, one_in, frequent, most_frequent, bucket, centres, group, group_tokens, queries, seed)


def _similar(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, one_in: int, frequent: int, most_frequent: int, bucket: int, centres: int, group: int, group_tokens: int, queries: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent_tokens(docs, text, words, one_in, frequent, most_frequent, seed))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        last, seen = hot.value, set()
        for batch in batches:
            n, h, prefix = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                h.append(_class(s))
                if not len(s) or h[-1] in seen:  # one copy in a task brings the prefix
                    prefix.append(None)
                    continue
                seen.add(h[-1])
                late = _late(s, last)
                k = len(s) - _needed(len(s), percent) + 1
                prefix.append(np.concatenate((s[~late], s[late]))[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(prefix, pa.binary())], names=["id", "n", "h", "prefix"])

    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    # rows without an id link nothing and need no prefix
    described = cut(slim.mapInArrow(tidied(describe), "id long, n long, h long, prefix binary"))
    rows = described.select("id", "n", "h")
    classes = cut(rows.where("h is not null and id is not null").groupBy(F.col("h").alias("k_cid")).agg(F.min("id").alias("k_id"), F.first("n").alias("n")))
    lists = token_lists(described, hot, bucket, percent)

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    # sets of sizes a, b share at least p(a+b)/(100+p); all but the shared prefix tokens lie behind the longer rest
    def least_overlap(a: Column, b: Column) -> Column:
        need = F.ceil((a + b) * percent / (100 + percent))
        return need - F.greatest(F.ceil(a * percent / 100), F.ceil(b * percent / 100)) + 1

    def enough(n: Column, low: Column, high: Column) -> Column:
        """What n shares with any fitting size from low to high: both ends and the own size bound every size between.

        One less for rounding, one for two tokens of a range with the same 32 bits.
        """
        small, large = F.greatest(low, F.ceil(n * percent / 100)), F.least(high, F.floor(n * 100 / percent))
        return F.when(small <= large, F.least(least_overlap(n, small), least_overlap(n, large)) - 2)

    # first classes of the lots of one frequent token and band (a lot a task) meet the smallest of them
    lots = lists.where("band >= 0").groupBy("token", "band").agg(F.collect_set("c").alias("firsts")).where("size(firsts) > 1")
    across = lots.select(F.explode("firsts").alias("cid"), F.array_min("firsts").alias("c"))
    met = lists.select("cid", "c").unionByName(across).where("cid <> c").groupBy("cid", "c").agg(F.count("*").alias("met"))
    x, y = (classes.select(F.col("k_cid").alias(f"{k}_cid"), F.col("n").alias(f"{k}_n")) for k in "xy")
    met = met.join(x, F.col("cid") == F.col("x_cid")).join(y, F.col("c") == F.col("y_cid")).where(fits(F.col("x_n"), F.col("y_n")) & (F.col("met") * 2 >= least_overlap(F.col("x_n"), F.col("y_n"))))
    best = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("met"), "c"))
    stars = cut(met.withColumn("place", best).where(F.col("place") <= centres).select("cid", "c"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The whole token sets of the given classes (w_cid, w_id), from their texts."""
        found = slim.join(small_side(wanted), F.col("id") == F.col("w_id"))

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                made, same = [], []
                for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                    # a row repeated in this task comes out once; other texts of the id do not
                    same.append(i not in seen and _class(s) == i)
                    if same[-1]:
                        seen.add(i)
                    made.append(s.tobytes() if same[-1] else b"")
                    if sum(map(len, made)) > 8_000_000:
                        yield _some(batch.column(0), made, same)
                        batch, made, same = batch.slice(len(made)), [], []
                if made:
                    yield _some(batch.column(0), made, same)

        return found.select(F.col("w_cid"), "t").mapInArrow(tidied(tokens), "s_cid long, tokens binary")

    near = stars.select("cid").union(stars.select("c")).distinct()
    ids = classes.select(F.col("k_cid").alias("w_cid"), F.col("k_id").alias("w_id"))
    sets = cut(sets_of(ids.join(near, F.col("w_cid") == F.col("cid"), "left_semi")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("s_cid").alias("x_cid"), F.col("tokens").alias("x"))
    two = sets.select(F.col("s_cid").alias("y_cid"), F.col("tokens").alias("y"))
    pairs = stars.join(one, F.col("cid") == F.col("x_cid")).join(two, F.col("c") == F.col("y_cid")).select("cid", "c", "x", "y")
    with small_batches(spark, 100):
        links = cut(pairs.mapInArrow(tidied(compare), "cid long, c long"))
    links = links.select(F.col("cid").alias("a"), F.col("c").alias("b"))
    part = cut(components(links))

    # groups: blocks of what is connected so far
    member = classes.join(part, F.col("k_cid") == F.col("node"), "left").select("k_cid", "n", F.coalesce("component", "k_cid").alias("part"))
    parts = lists.select("token", "cid").join(member, F.col("cid") == F.col("k_cid")).select("token", "cid", "n", "part")
    # a token of one part only says nothing
    several = parts.groupBy(F.col("token").alias("s_token")).agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("s_token")
    parts = parts.join(several, F.col("token") == F.col("s_token"), "left_semi")
    big = part.join(classes, F.col("node") == F.col("k_cid")).groupBy(F.col("component").alias("b_part")).agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / group_tokens)).alias("blocks")).where("blocks > 1")
    parts = parts.join(small_side(big), F.col("part") == F.col("b_part"), "left")
    # a class can share no more with another part than the tokens it has left (held)
    held = F.count("*").over(Window.partitionBy("cid"))
    parts = cut(parts.select("token", "cid", "n", "part", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1)).cast("long")).alias("block"), held.alias("held")))
    matrix = parts.groupBy(F.col("token").alias("m_token"), F.col("part").alias("m_part"), F.col("block").alias("m_block")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("held").alias("m_held"))
    bounds = parts.groupBy("part", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # a pair of parts is tried once, from the larger id
    met = parts.select("token", "cid", "n", "part", "held").join(matrix, (F.col("token") == F.col("m_token")) & (F.col("m_part") < F.col("part")) & (F.least("held", "m_held") >= enough(F.col("n"), F.col("low"), F.col("high"))))
    counted = met.groupBy("cid", "n", F.col("m_part").alias("g_part"), F.col("m_block").alias("g_block")).agg(F.count("*").alias("overlap"))
    b = bounds.withColumnsRenamed({"part": "o_part", "block": "o_block"})
    counted = counted.join(b, (F.col("g_part") == F.col("o_part")) & (F.col("g_block") == F.col("o_block")))
    opened = cut(counted.where(F.col("overlap") >= enough(F.col("n"), F.col("low"), F.col("high"))).select("cid", "g_part", "g_block"))

    inside = member.join(small_side(big), F.col("part") == F.col("b_part"), "left").select(F.col("k_cid").alias("i_cid"), F.col("part").alias("i_part"), F.pmod(F.xxhash64("k_cid"), F.coalesce("blocks", F.lit(1)).cast("long")).alias("i_block"))
    chunks = opened.groupBy(F.col("g_part").alias("c_part"), F.col("g_block").alias("c_block")).agg(F.ceil(F.count("*") / queries).cast("long").alias("chunks"))
    asked = opened.join(chunks, (F.col("g_part") == F.col("c_part")) & (F.col("g_block") == F.col("c_block"))).select("cid", "g_part", "g_block", F.pmod(F.xxhash64("cid"), "chunks").alias("chunk"), F.lit(False).alias("member"))
    members = inside.join(chunks, (F.col("i_part") == F.col("c_part")) & (F.col("i_block") == F.col("c_block"))).select(
        F.col("i_cid").alias("cid"), F.col("i_part").alias("g_part"), F.col("i_block").alias("g_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("member")
    )
    work = cut(asked.unionByName(members))
    missing = work.select("cid").distinct().join(sets, F.col("cid") == F.col("s_cid"), "left_anti")
    every = sets.unionByName(cut(sets_of(ids.join(missing, F.col("w_cid") == F.col("cid"), "left_semi"))))
    filled = work.join(every, F.col("cid") == F.col("s_cid")).select("g_part", "g_block", "chunk", "member", "cid", "tokens")
    with small_batches(spark, 100):
        late = cut(filled.groupBy("g_part", "g_block", "chunk").applyInArrow(lambda key, g: _open_groups(key, g, percent), "a long, b long"))
    whole = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
    label = classes.select("k_cid", "k_id").join(whole, F.col("k_cid") == F.col("node"), "left").select("k_cid", "k_id", F.coalesce("component", "k_cid").alias("component"))
    # classes are named by hashes, components by their smallest document
    smallest = label.groupBy(F.col("component").alias("s_component")).agg(F.min("k_id").alias("label"))
    label = label.join(smallest, F.col("component") == F.col("s_component")).select("k_cid", "label")
    out = rows.join(label, F.col("h") == F.col("k_cid"), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id"))


def _class(s: np.ndarray) -> int | None:
    """The class of a set: a 64-bit hash of it; none for the empty set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _some(ids: pa.Array, made: list[bytes], same: list[bool]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([ids.slice(0, len(made)), pa.array(made, pa.binary())], names=["s_cid", "tokens"])
    return out.filter(pa.array(same, pa.bool_()))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"), words=5, percent=75)
