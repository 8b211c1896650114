"""SentencePiece encoding of merge-type vocabularies by backtracking, and decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, table, tidied

#: What the vocabulary writes for a space.
SPACE = "▁"
#: Segments, and pairs of pieces, that one Python worker remembers; others are worked out each time.
REMEMBERED = 300_000
#: Longer segments are not remembered.
SHORT = 40


def load(model: str):
    """The library's processor for a model, a path or the name of a public vocabulary: it has the pieces and decodes."""
    import os

    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if os.path.isabs(model) else public_tokenizers.path(model))


def merges(text: str, score: dict[str, float]) -> list[tuple[float, list[str]]]:
    """Plain merging: the best-scored neighbours whose union is a piece become one, the leftmost of equals first.

    The states after each merge, with its score; the first state are the characters.
    """
    parts = list(text)
    out = [(math.inf, parts)]
    while found := [(score[u], -i) for i in range(len(parts) - 1) if (u := parts[i] + parts[i + 1]) in score]:
        best, i = max(found)
        parts = [*parts[:-i], parts[-i] + parts[1 - i], *parts[2 - i :]]
        out.append((best, parts))
    return out


def runs(odd: str = "") -> re.Pattern:
    """A run of letters or of other characters (``odd`` ones too), with the spaces before it."""
    odd = re.escape(odd)
    return re.compile(f"{SPACE}*(?:[^\\W\\d_{odd}]+|(?:[^\\w{SPACE}]|[\\d_{odd}])+)|{SPACE}+")


class Memo(dict):
    """What ``make`` gives for short texts; the first ``REMEMBERED`` are kept."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= SHORT and len(self) < REMEMBERED:
            self[text] = out
        return out


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    A row of pieces is the merge result exactly if each two neighbours, merged alone, give themselves: no merge
    ever crosses their border. So the encoder takes the longest piece that fits its predecessor, goes on, and
    falls back to shorter ones; a place from which nothing led on is marked and never tried again, since
    what the stack holds before a place is the one right encoding up to there. Pieces that merging never makes
    are left out. Characters outside the vocabulary become their bytes' ids.
    """

    def __init__(self, processor) -> None:
        import ahocorasick

        plain = [i for i in range(processor.vocab_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        if any(processor.is_unused(i) for i in plain):
            raise ValueError("unused pieces are not supported")
        self.score = {processor.id_to_piece(i): processor.get_score(i) for i in plain}
        self.byte = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        single = {p for p in self.score if len(p) == 1}
        if not all(c in single for p in self.score for c in p) or not all(map(processor.is_byte, self.byte)):
            raise ValueError("the vocabulary must hold every character of its pieces, and all bytes")
        if processor.normalize("  Aﬁ  ①  ") != SPACE * 3 + "Aﬁ" + SPACE + " ①" + SPACE * 2:
            raise ValueError("only models that keep texts as they are and put a space before them are supported")
        #: How each piece comes about: the scores of its merges, with the symbol at its right and at its left end before each.
        self.made: dict[int, list[tuple[float, str, str]]] = {}
        self.text: dict[int, str] = {}
        for i in plain:
            steps = merges(p := processor.id_to_piece(i), self.score)
            if steps[-1][1] == [p]:
                self.text[i] = p
                scores = [*(s for s, _ in steps[1:]), -math.inf]
                self.made[i] = [(s, parts[-1], parts[0]) for s, (_, parts) in zip(scores, steps, strict=True)]
        self.size = {i: len(p) for i, p in self.text.items()}
        known = {p: i for i, p in self.text.items()}
        self.shorter = {i: next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1) for i, p in self.text.items()}
        self.search = ahocorasick.Automaton()
        for i, p in self.text.items():
            if len(p) > 1:
                self.search.add_word(p, (len(p), i))
        self.single = {p: i for i, p in self.text.items() if len(p) == 1}
        self.search.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known, self.words = Memo(self._segment), Memo(self._word)
        # texts can be cut where no piece has the two characters beside each other
        odd = {p[0] for p in self.score if len(runs().findall(p)) > 1}
        self.by_word = all(len(runs("".join(odd)).findall(p)) == 1 for p in self.score)
        self.segments = runs("".join(odd)) if self.by_word else re.compile("(?s).+")
        self.foreign = re.compile("([^{}])".format("".join(map(re.escape, sorted(single)))))

    def _fit(self, a: int, b: int) -> bool:
        """Merges the characters of two pieces again, side by side: False if something would merge across their border.

        Up to then each side merges as it does alone, so the better next step of the two is the next one; the
        left side's of equals, then one across the border, then the right side's.
        """
        left, right, score, i, j, out = self.made[a], self.made[b], self.score, 0, 0, True
        while True:
            (s, x, _), (t, _, y) = left[i], right[j]
            if (across := score.get(x + y)) is not None and s < across >= t:
                out = False
                break
            if s == t == -math.inf:
                break
            if s >= t:
                i += 1
            else:
                j += 1
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[a << 32 | b] = out
        return out

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a text whose characters are all in the vocabulary."""
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        longest = [*map(self.single.__getitem__, text), -1]
        for end, (length, i) in self.search.iter(text):
            longest[end - length + 1] = i  # matches come by their end, so the last one from a place is the longest
        failed, out, at, i = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            while i >= 0:
                if not failed[at + size[i]]:
                    if not out:
                        break
                    fit = fits.get(out[-1] << 32 | i)
                    if self._fit(out[-1], i) if fit is None else fit:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += size[i]
                i = longest[at]
            else:
                failed[at] = 1
                i = out.pop()
                at -= size[i]
                i = shorter[i]
        return out

    def _segment(self, text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(self.foreign.split(text)):
            if k % 2:
                ids += [self.byte[b] for b in part.encode()]
            elif part:
                ids += self.backtrack(part)
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.segments.findall(SPACE + word)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or text[0] == " " or "  " in text or SPACE in text:
            return b"".join(map(self.known.__getitem__, self.segments.findall(SPACE + text.replace(" ", SPACE))))
        return b"".join(map(self.words.__getitem__, text.split(" ")))


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Encodes whole texts with begin and end ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit, as one binary).

    The ids are those of the sentencepiece library without sampling, for BPE models that keep texts as they
    are, hold each character of their pieces and fall back to bytes; other models are refused. A null or
    empty text is the begin and end ids alone. Rows are independent: a null or repeated doc_id is a row like any
    other, other columns are ignored, and an empty table gives an empty table. Work and memory grow with the
    length of a text, also of one without white space.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            processor = load(model)
            return Encoder(processor), np.array([processor.bos_id()], "<u4").tobytes(), np.array([processor.eos_id()], "<u4").tobytes()

        encoder, begin, end = kept_in_worker(f"pieces {model}", make)
        for batch in batches:
            ids = [begin + encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return slim.mapInArrow(tidied(encode, keep=True), "id long, n_tokens long, ids binary").withColumnRenamed("id", doc_id)


def decode_ids(encoded: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Adds ``decoded``, the library's text for ``ids`` (as encode_texts gives them), to all columns; null ids give a null text.

    An empty table gives an empty table; a column ``decoded`` that is there already is replaced.
    """
    slim = encoded.drop("decoded")
    names = slim.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = kept_in_worker(f"processor {model}", lambda: load(model))
        for batch in batches:
            raw = batch.column(names.index(ids)).to_pylist()
            texts = [None if x is None else processor.decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(tidied(decode, keep=True), f"{fields}, decoded string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
