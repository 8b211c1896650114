"""Language-model scoring with a hidden Markov model trained by Baum-Welch counts from all partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .langid import remainder

#: Tokens whose forward and backward values are held at once, and tokens sorted by length at once.
CHUNK, BUFFER = 400_000, 3_000_000


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a column of texts: places in a dictionary, the dictionary, and where each text's words begin and end.

    Words are runs of characters that are not white space (space, 0x09-0x0D), A-Z lower-cased.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    found = lists.flatten()
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(found, "")  # white space at an end leaves an empty word
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[at]
    code = found.filter(full).dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    return code.indices.to_numpy(), code.dictionary, kept


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that Spark's xxhash64 gives a word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


@dataclass
class Model:
    """Start, transition and emission probabilities; symbols are the frequent words, then classes of rarer words, then the end."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


def likelihoods(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, counts: list | None = None) -> np.ndarray:
    """Natural log likelihood of each sequence by scaled forward recursion, all sequences a step at a time.

    Sequences are flat[first : first+length], longest first. With ``counts`` (start, move, emit), the
    expected counts of the backward pass are added to them.
    """
    states = len(model.start)
    out = np.zeros(len(first))
    if not len(first):
        return out
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than t
    alphas, scales = [], []
    a = np.empty((0, states))
    for t in range(steps):
        k = active[t]
        e = model.emit[flat[first[:k] + t]]
        a = (a[:k] @ model.move if t else model.start) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:k] += np.log(c)
        if counts is not None:
            alphas.append(a)
            scales.append(c)
    if counts is None:
        return out
    start, move, emit = counts
    gamma = np.empty((len(flat), states))
    moved = np.zeros((states, states))
    beta = np.ones((active[-1], states))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if t + 1 < steps:
            k1 = active[t + 1]
            be = model.emit[flat[first[:k1] + t + 1]] * beta / scales[t + 1][:, None]
            moved += alphas[t][:k1].T @ be
            beta = np.ones((k, states))
            beta[:k1] = be @ model.move.T
        gamma[first[:k] + t] = alphas[t] * beta
    start += gamma[first].sum(axis=0)
    move += moved * model.move
    for s in range(states):
        emit[:, s] += np.bincount(flat, gamma[:, s], len(emit))
    return out


def _in_batches(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, counts: list | None) -> np.ndarray:
    """Likelihoods of the sequences flat[first : first+length] in their order; work goes in chunks of like lengths."""
    order = np.argsort(-length, kind="stable")
    ends = np.cumsum(length[order])
    out, lo = np.empty(len(length)), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        mine = order[lo:hi]
        n = length[mine]
        own = np.cumsum(n) - n
        here = flat[np.repeat(first[mine] - own, n) + np.arange(n.sum())]
        out[mine] = likelihoods(model, here, own, n, counts)
        lo = hi
    return out


def _with_end(batches: list[pa.RecordBatch], column: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts of the batches, each with the end (the last symbol) behind it: flat, first, length."""
    ids = [b.column(column) for b in batches]
    n = np.concatenate([np.diff(v.offsets.to_numpy()) for v in ids]).astype(np.int64)
    word = np.concatenate([v.flatten().to_numpy() for v in ids])
    length = n + 1
    first = np.cumsum(length) - length
    flat = np.full(length.sum(), symbol[-1], np.int32)
    flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(word))] = symbol[word]
    return flat, first, length


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; each batch is summed before it shuffles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, words, _ = coded(batch.column(0))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(code, minlength=len(words)))], names=["word", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> list:
    """The most frequent words, ``most`` of them at the most, most frequent first.

    A histogram of counts on a logarithmic scale (some hundred rows) gives the count from which on words fit,
    so no task sorts or sends more than the words that are taken.
    """
    step = F.floor(F.log2("n") * 32).cast("long").alias("step")
    steps = sorted(((r["step"], r["k"]) for r in counts.groupBy(step).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for at, k in steps:
        if total + k > most:
            break
        least, total = at, total + k
    if least is None:
        return []
    return sorted(counts.where(step >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))


def baum_welch(encoded: DataFrame, model: Model, symbols, segment: int) -> tuple[Model, float]:
    """One round: expected counts of every row's ids, summed over partitions; the new model and the log likelihood.

    Sequences longer than ``segment`` count as several. Each task gives one row of sums for each symbol and
    state, whatever it reads.
    """
    states = len(model.start)
    shipped = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, symbol = Model(*shipped.value), symbols.value
        counts = [np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states))]
        total, held, n = 0.0, [], 0

        def add() -> float:
            flat, first, length = _with_end(held, 0, symbol)
            pieces = -(-length // segment)
            inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.repeat(first, pieces) + inside * segment
            size = np.minimum(np.repeat(length, pieces) - inside * segment, segment)
            held.clear()
            return _in_batches(model, flat, begin, size, counts).sum()

        for batch in batches:
            held.append(batch)
            n += len(batch.column(0).flatten())
            if n > BUFFER:
                total, n = total + add(), 0
        if held:
            total += add()
        # rows: emissions by symbol, then moves by state (-1 - state), then the start, then the likelihood
        at = [*range(len(model.emit)), *(-1 - s for s in range(states)), -1 - states, -2 - states]
        rows = np.vstack([counts[2], counts[1], counts[0][None, :], np.full((1, states), total)])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(at)[some], pa.int64()), *(pa.array(rows[some, s]) for s in range(states))], names=["at", *(f"s{s}" for s in range(states))])

    cols = [f"s{s}" for s in range(states)]
    sums = encoded.select("ids").mapInArrow(expect, "at long, " + ", ".join(f"{c} double" for c in cols))
    got = {r["at"]: np.array(r[1:]) for r in sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).collect()}
    shipped.unpersist()
    zero = np.zeros(states)
    emit = np.array([got.get(i, zero) for i in range(len(model.emit))])
    move = np.array([got.get(-1 - s, zero) for s in range(states)])
    start = got.get(-1 - states, zero)
    # a little of the mean keeps every symbol and move possible
    emit = emit + 0.02 * (emit.sum(axis=1, keepdims=True) + 1e-3) / states
    new = Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return new, float(got.get(-2 - states, zero)[0])


def score_texts(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", states: int = 8, vocabulary: int = 32_768, classes: int = 4096, head: int = 100_000, warm_docs: int = 3000, warm_rounds: int = 8, rounds: int = 4, tolerance: float = 1e-3, segment: int = 1024, seed: int = 3) -> DataFrame:
    """log10 probability of every whole text under a unigram model and a hidden Markov model learned from the rows where ``training`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words and one end.

    Word counts, sums and Baum-Welch counts cover all training rows. The latent states emit the ``vocabulary``
    most frequent words, ``classes`` classes of all rarer words (by hash, a power of two) and the end; the
    emission counts of all of these are learned. A rarer word's own probability inside its class is its smoothed
    share of the class's counts, with room for one unknown word. So the model gives a probability to every text,
    and scores are exact sums over state paths of the whole text.
    ``warm_rounds`` rounds on about ``warm_docs`` texts (chosen by hash) only find where the rounds over all
    begin; those end when the likelihood rises by less than ``tolerance`` of itself, after ``rounds`` at the latest.
    They learn from pieces of at most ``segment`` tokens.

    Texts are turned into numbers once; rounds and scoring read those. Up to ``head`` most frequent words travel to
    the tasks (a bounded table); the counts of all others are joined by word hash, so nothing that grows with the
    corpus is broadcast or collected.

    A null or empty text is the end alone; rows are independent (repeated rows repeat, ids may be null). Without
    training rows the base is uniform over the end and the unknown word. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), F.coalesce(training, F.lit(False)).alias("trains"))
    with small_batches(spark, 2000):
        counts = cut(count_words(slim.where("trains"), "t"))
    texts = slim.where("trains").count()
    v, c = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, distinct = c + texts, v + (1 if texts else 0)
    top = _head(counts, head)
    known = pa.array([r["word"] for r in top], pa.large_string())
    n_head, size = len(top), min(vocabulary, len(top))
    n_of = np.array([r["n"] for r in top], np.float64)
    class_of = (word_hash(known.to_pylist()) & (classes - 1)).astype(np.int64)
    # of each class of rarer words: counts and distinct words
    by_class = np.zeros((classes, 2))
    for r in counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(classes)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        by_class[r["k"]] = r["n"], r["words"]
    np.subtract.at(by_class, class_of[:size], np.stack([n_of[:size], np.ones(size)], axis=1))
    log_room = np.log10(by_class[:, 0] + 0.1 * (by_class[:, 1] + 1))
    base_room = tokens + 0.1 * (distinct + 1)

    words_table = spark.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids: places of head words, then n_head + class of the others, whose hashes go to tail."""
        for batch in batches:
            code, words, at = coded(batch.column(1))
            place = pc.fill_null(pc.index_in(words, value_set=words_table.value), -1).to_numpy().astype(np.int64)
            far = np.flatnonzero(place < 0)
            hashes = np.zeros(len(words), np.int64)
            hashes[far] = word_hash(words.take(pa.array(far)).to_pylist())
            ids = np.where(place < 0, n_head + (hashes & (classes - 1)), place)[code].astype(np.int32)
            late = ids >= n_head
            ends = np.concatenate(([0], np.cumsum(late)))[at].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[code][late]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["id", "trains", "ids", "tail"])

    with small_batches(spark, 2000):
        encoded = cut(slim.mapInArrow(encode, "id long, trains boolean, ids array<int>, tail array<long>").withColumn("row", F.monotonically_increasing_id()))
    learn = encoded.where("trains").select("ids", "row")

    rng = np.random.default_rng(seed)
    share = np.concatenate((n_of[:size], by_class[:, 0] + 1, [texts + 1]))
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    symbols = spark.sparkContext.broadcast(np.concatenate((np.arange(size), size + class_of[size:], size + np.arange(classes + 1))).astype(np.int32))
    if texts:
        draw = F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        few = cut(learn.where(draw * F.lit(float(texts)) < warm_docs))
        for _ in range(warm_rounds):
            model, _ = baum_welch(few, model, symbols, segment)
        before = None
        for _ in range(rounds):
            model, now = baum_welch(learn, model, symbols, segment)
            if before is not None and now - before < tolerance * abs(before):
                break
            before = now

    shipped = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, symbol = Model(*shipped.value), symbols.value
        log_count = np.concatenate((np.log10(n_of + 0.1), np.zeros(classes)))
        inside = log_count.copy()  # of a word in its class
        inside[:size] = 0
        inside[size:n_head] -= log_room[class_of[size:]]
        inside[n_head:] -= log_room

        def out(held: list) -> pa.RecordBatch:
            flat, first, length = _with_end(held, 2, symbol)
            hmm = _in_batches(model, flat, first, length, None) / math.log(10)
            word = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            ends = np.cumsum(length - 1)
            near = np.diff(np.concatenate(([0], np.cumsum(word < n_head)))[np.concatenate(([0], ends))])
            row = np.repeat(np.arange(len(length)), length - 1)
            base, rare = (np.bincount(row, x[word], len(length)).astype(np.float64) for x in (log_count, inside))
            keys = [pa.concat_arrays([b.column(j) for b in held]) for j in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(length), pa.array(near.astype(np.int64)), pa.array(base), pa.array(rare), pa.array(hmm)], names=["row", "id", "n_tokens", "n_head", "base_head", "inside", "hmm"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n > BUFFER:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    scored = encoded.select("row", "id", "ids").mapInArrow(score, "row long, id long, n_tokens long, n_head long, base_head double, inside double, hmm double")
    tail = encoded.select("row", F.explode("tail").alias("h"))
    by_hash = counts.groupBy(F.xxhash64("word").alias("wh")).agg(F.max("n").alias("c"))
    more = tail.join(by_hash, F.col("h") == F.col("wh"), "left").groupBy(F.col("row").alias("t_row")).agg(F.count("c").alias("t_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("t_log"))
    out = scored.join(more, F.col("row") == F.col("t_row"), "left")
    t_log = F.coalesce("t_log", F.lit(0.0))
    one = 1 if texts else 0
    return out.select(
        F.col("id").alias(doc_id),
        "n_tokens",
        (F.col("n_head") + one + F.coalesce("t_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_head") + t_log + F.lit(math.log10(texts + 0.1)) - F.col("n_tokens") * F.lit(math.log10(base_room))).alias("base_score"),
        (F.col("hmm") + F.col("inside") + t_log).alias("score"),
    )


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
