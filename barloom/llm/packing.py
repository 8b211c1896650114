"""Best-fit packing: bin completion branch-and-bound over the histogram of lengths."""

from __future__ import annotations

import base64
import json
import logging
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kept_in_worker, table, tidied, tidy_worker

LOG = logging.getLogger(__name__)
#: Words that one Python worker remembers the tokens of; others are encoded each time.
REMEMBERED = 150_000
#: Texts with other white space than single spaces and single newlines are encoded in one piece.
ODD_SPACE = re.compile(r"\s\s|[^\S \n]")
#: The control string of the vocabulary (fixed value).
CONTROL = "<|endoftext|>"


class _Words(dict):
    """Token bytes of a word, with what comes before it in the text."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        out = self.encode(self.before + word)
        if len(self) < REMEMBERED:
            self[word] = out
        return out


def tokenizer(vocab: str):
    """A function from text to its ids as little-endian 32-bit bytes.

    The vocabulary's control strings in a text become their own ids, as the tokenizers library gives them. A boundary between a non-space and a space always separates tokens of this vocabulary's pattern, so the
    ids of a text are those of its words (each with the space before it) in a row, which are remembered from text to text.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocab), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(vocab, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        return np.array(enc.encode_ordinary(text), "<u4").tobytes()

    first, later, newline = _Words(encode, ""), _Words(encode, " "), encode("\n")
    control = np.array([len(ranks)], "<u4").tobytes()  # the id behind the ranks

    def ids(text: str) -> bytes:
        if CONTROL in text:
            return control.join(map(ids, text.split(CONTROL)))
        if ODD_SPACE.search(text):
            return encode(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out.extend([later[w] for w in words[1:]])
            out.append(newline)
        out.pop()
        return b"".join(out)

    return ids


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Cuts each document's ids (with ``end`` behind them) into pieces: doc_id, piece, start, length, ids_crc32.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` behind a first one that holds
    the rest. A null or empty text is the end token alone. Rows are independent.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_in_worker(f"tokenizer {vocab}", lambda: tokenizer(vocab))
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                raw = memoryview(ids(t or "") + tail)
                n, at, k = len(raw) // 4, 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *made], names=["id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return slim.mapInArrow(tidied(cut_up, keep=True), "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", doc_id)


# -- packing a histogram --------------------------------------------------------------------------------

Pattern = tuple[int, ...]
Packing = list[tuple[int, Pattern]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, a whole length at a time: equal bins are one entry with a number."""
    bins: dict[int, list[tuple[int, Pattern]]] = {}  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            have, pattern = bins[room].pop() if room is not None else (left, ())
            if room is None:
                room = capacity
            elif not bins[room]:
                del bins[room]
            fit = room // length
            full = min(have, left // fit)
            if full:
                bins.setdefault(room - fit * length, []).append((full, pattern + (length,) * fit))
                left, have = left - full * fit, have - full
            if have and 0 < left < fit:
                bins.setdefault(room - left * length, []).append((1, pattern + (length,) * left))
                left, have = 0, have - 1
            if have and pattern:
                bins.setdefault(room, []).append((have, pattern))
    return [b for group in bins.values() for b in group]


def fillings(counts: dict[int, int], room: int, allowed: int) -> Iterator[Pattern]:
    """Undominated sets of lengths that fill ``room`` but for at most ``allowed``, least waste first, then larger lengths first.

    A filling is dominated if a free length no smaller than one of its lengths, or than two together, could take that place
    in the same room, or fits into the waste. The sums that the shorter lengths can make (bits of one number for
    each length) are known beforehand, so every step leads to a filling; they come one by one, as far as they are asked for.
    """
    free = sorted(x for x, n in counts.items() if n and x <= room)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in free:
        sums, left, k = reach[-1], min(counts[x], room // x), 1
        while left:
            k = min(k, left)
            sums |= (sums << (k * x)) & mask
            left, k = left - k, 2 * k
        reach.append(sums)

    def go(i: int, left: int, chosen: Pattern) -> Iterator[Pattern]:
        if not left:
            yield chosen
            return
        for j in range(bisect_right(free, left, hi=i) - 1, -1, -1):
            x = free[j]
            for k in range(min(counts[x], left // x), 0, -1):
                if reach[j] >> (left - k * x) & 1:
                    yield from go(j, left - k * x, chosen + (x,) * k)

    def dominated(chosen: Pattern, waste: int) -> bool:
        used = Counter(chosen)
        between = lambda lo, hi: any(counts[x] > used[x] for x in free[bisect_left(free, lo) : bisect_right(free, hi)])
        if waste and (between(1, waste) or any(between(y + 1, y + waste) for y in used)):
            return True
        return len(chosen) <= 8 and any(between(p, p + waste) for p in {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]})

    for waste in range(min(allowed, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            for chosen in go(len(free), room - waste, ()):
                if not dominated(chosen, waste):
                    yield chosen


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each a, lengths over half and what lengths of a or more do not fit beside them."""
    x = np.array(sorted(counts), np.int64)
    if not len(x):
        return 0
    n = np.array([counts[v] for v in x.tolist()], np.int64)
    number, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(x * n)))
    half = np.searchsorted(x, capacity // 2, "right")
    a = np.concatenate(([0], x[:half]))
    low, high = np.searchsorted(x, a), np.maximum(half, np.searchsorted(x, capacity - a, "right"))
    alone, beside = number[-1] - number[high], number[high] - number[half]
    rest = total[half] - total[low] - (beside * capacity - (total[high] - total[half]))
    return int((alone + beside + np.maximum(0, -(-rest // capacity))).max())


def _branches(left: dict[int, int], used: int, waste: int, path: object, capacity: int, allowed: int) -> Iterator[tuple]:
    """The nodes below a node: the largest length left with each of its fillings, as often as the numbers allow."""
    largest = max(left)
    rest = dict(left)
    rest[largest] -= 1
    for filling in fillings(rest, capacity - largest, allowed):
        pattern = (largest, *filling)
        need = Counter(pattern)
        lost = capacity - sum(pattern)
        times = min(left[x] // k for x, k in need.items())
        times = times if not lost else max(1, min(times, allowed // lost))
        after = {x: n - times * need[x] for x, n in left.items() if n > times * need[x]}
        yield after, used + times, waste + times * lost, ((times, pattern), path)


def _search(node: tuple, size: int, bound: int, total: int, capacity: int, nodes: int) -> tuple[int, Packing | None]:
    """Depth first below a node for packings of fewer than ``size`` bins: the least size found and its bins below the node.

    Ends when every undominated branch is seen, the bound is met, or ``nodes`` branches are taken. What was once
    left over with as many bins is not looked at again.
    """
    best, seen = None, set()
    spare = lambda waste: (size - 1) * capacity - total - waste  # noqa: E731  what a better packing may still waste
    if not node[0]:
        return (node[1], []) if node[1] < size else (size, None)
    stack = [_branches(*node, None, capacity, max(0, spare(node[2])))] if spare(node[2]) >= 0 else []
    while stack and nodes and size > bound:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            continue
        nodes -= 1
        left, used, waste, path = branch
        if not left and used < size:
            size, best = used, []
            while path is not None:
                entry, path = path
                best.append(entry)
        elif left and spare(waste) >= 0 and used + lower_bound(left, capacity) < size:
            key = hash((used, tuple(sorted(left.items()))))
            if key not in seen:
                seen.add(key)
                stack.append(_branches(left, used, waste, path, capacity, spare(waste)))
    return size, best


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 3000, parts: int = 8, spark: SparkSession | None = None) -> tuple[Packing, int]:
    """Packs a histogram (length: number) into few bins; returns the packing and a lower bound on its size.

    Best-fit decreasing gives the first incumbent. The search then takes the largest length left, tries its
    undominated fillings, all of them as backtracking comes to them, and repeats each as often as the numbers
    allow; it drops branches whose waste or bound excludes a better packing, and ends at the bound. The first ``parts``
    nodes or so are independent residual histograms: each is searched on its own for ``nodes`` branches; with
    ``spark`` they are rows of a job. The best packing counts, so both ways give the same. Work depends on how
    many different lengths there are, not on the number of documents.
    """
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(n for n, _ in best)
    if size == bound:
        return best, bound
    front: list[tuple[dict[int, int], int, int, object]] = [(counts, 0, 0, None)]
    at = 0
    while len(front) - at < parts and at < len(front):
        if not any(f[0] for f in front[at:]):
            break
        left, used, waste, path = front[at]
        allowed = (size - 1) * capacity - total - waste
        if left and allowed >= 0:
            front += islice(_branches(left, used, waste, path, capacity, allowed), parts)
        elif not left:
            front.append(front[at])
        at += 1
    # what the first node's branches beyond ``parts`` lead to is looked at from the root, last
    front = [*front[at:], (counts, 0, 0, None)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()  # the word table of the step before
        for batch in batches:
            for i, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, used, waste = json.loads(code)
                n, bins = _search((dict(left), used, waste), size, bound, total, capacity, nodes)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([n], pa.int64()), pa.array([json.dumps(bins)])], names=["i", "n", "bins"])

    if spark is None:
        found = ((*_search(f[:3], size, bound, total, capacity, nodes), f[3]) for f in front)
    else:
        # tables of Arrow: rows of Python would start a second daemon with workers of its own in every executor, for good
        rows = pa.table({"i": pa.array(range(len(front)), pa.int64()), "node": pa.array([json.dumps([list(left.items()), used, waste]) for left, used, waste, _ in front], pa.string())})
        made = spark.createDataFrame(rows).repartition(len(front), "i").mapInArrow(task, "i long, n long, bins string").collect()
        found = [(r["n"], json.loads(r["bins"]), front[r["i"]][3]) for r in sorted(made, key=lambda r: r["i"])]
    for n, bins, path in found:
        if bins is not None and n < size:
            size, best = n, [(times, tuple(pattern)) for times, pattern in bins]
            while path is not None:
                entry, path = path
                best.append(entry)
        if size == bound:
            break
    return best, bound


def pack(pieces: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = 1024, bucket: int = 20_000, nodes: int = 3000, parts: int = 8) -> DataFrame:
    """Adds sequence_id and offset to every row: rows share sequences of ``capacity`` without gaps or overlap.

    Only the histogram of lengths (at most ``capacity`` rows) comes to the driver, which packs it with
    bin_completion (its search is a job; ``nodes`` and ``parts`` say how far it goes) and logs the bins used against
    the lower bound; the resulting patterns say which ranks of a length go where. Ranks are counted in hash buckets of about ``bucket`` rows, so a length that a third of all rows share spreads over many tasks.
    ``order`` names the columns that tell rows apart; equal rows are interchangeable. Lengths must lie in
    1..capacity (others fail the job). An empty table stays empty. Reruns over equal rows agree.
    """
    order = [c for c in pieces.columns if c != length] if order is None else order
    rows = pieces.select(F.struct(*pieces.columns).alias("row"), F.col(length).alias("len"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    rows = rows.withColumn("len", F.when(F.col("len").between(1, capacity), F.col("len")).otherwise(F.raise_error(F.lit("length out of range")).cast("long")))
    hist = {r["len"]: r["n"] for r in rows.groupBy("len").agg(F.count("*").alias("n")).collect()}
    packing, bound = bin_completion(hist, capacity, nodes, parts, pieces.sparkSession)
    used = sum(n for n, _ in packing)
    LOG.log(logging.WARNING if used > bound else logging.INFO, "packing: %d bins used, at least %d needed", used, bound)
    first, base, slots = Counter(), 0, []
    for times, pattern in sorted(packing, key=lambda p: (p[1], p[0]), reverse=True):
        at = 0
        for x in pattern:  # ranks first..first+times of this length go to these sequences, at this offset
            slots.append((x, first[x], base, at))
            first[x] += times
            at += x
        base += times
    slots.sort()
    s_len, s_rank, s_base, s_at = (np.array(v, np.int64) for v in (zip(*slots, strict=True) if slots else ([],) * 4))
    begins = np.searchsorted(s_len, np.arange(capacity + 2))

    spark = pieces.sparkSession
    number = spark.createDataFrame(pa.table({"b_len": pa.array(list(hist), pa.int64()), "n_buckets": pa.array([max(1, -(-n // bucket)) for n in hist.values()], pa.int64())}))
    rows = rows.join(F.broadcast(number), F.col("len") == F.col("b_len")).withColumn("bucket", F.pmod(F.xxhash64("len", *keys), "n_buckets")).drop("b_len", "n_buckets")
    sizes = rows.groupBy("len", "bucket").agg(F.count("*").alias("n"))
    past = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("len").alias("s_len"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    inside = Window.partitionBy("len", "bucket").orderBy(*keys)
    ranked = rows.withColumn("in_bucket", F.row_number().over(inside) - 1)
    ranked = ranked.join(sizes, (F.col("len") == F.col("s_len")) & (F.col("bucket") == F.col("s_bucket"))).select("row", "len", (F.col("before") + F.col("in_bucket")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            seq, at = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                lo, hi = begins[x], begins[x + 1]
                slot = lo + np.searchsorted(s_rank[lo:hi], rank[mine], "right") - 1
                seq[mine] = s_base[slot] + rank[mine] - s_rank[slot]
                at[mine] = s_at[slot]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq), pa.array(at)], names=["row", "sequence_id", "offset"])

    kind = ranked.schema["row"].dataType.simpleString()
    return ranked.mapInArrow(tidied(place), f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut(token_pieces(table(spark, sf_dir, "documents")))
    return pack(pieces, order=["doc_id", "piece", "start", "ids_crc32"])
