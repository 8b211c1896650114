"""Media columns: TIFF images in a binary column, one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: Bytes of one value of each field type that a directory may use here.
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


# -- codecs ---------------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, need: int | None = None) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and (need is None or len(out) < need):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    codes: dict[bytes, int] = {bytes((b,)): b for b in range(256)}
    free, width, acc, bits, out, word = 258, 9, 256, 9, bytearray(), b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    for b in data:
        longer = word + bytes((b,))
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer], free, word = free, free + 1, bytes((b,))
        if free == 4094:
            put(codes[word])
            put(256)
            codes = {bytes((x,)): x for x in range(256)}
            free, width, word = 258, 9, b""
        elif free in (512, 1024, 2048):
            width += 1
    if word:
        put(codes[word])
        if free in (511, 1023, 2047):  # the reader has as many words by now
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, need: int | None = None) -> bytes:
    out, words, width, acc, bits, last, made = [], [], 9, 0, 0, b"", 0
    for b in data:
        acc, bits = acc << 8 | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = [bytes((x,)) for x in range(256)] + [b"", b""], 9, b""
            continue
        if not words:
            raise ValueError("LZW data do not begin with a clear code")
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        made += len(word)
        if need is not None and made >= need:
            break
        if last:
            words.append(last + word[:1])
        last = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return b"".join(out)


def _unpack(data: bytes, compression: int, need: int) -> bytes:
    """The first ``need`` bytes of a strip or tile; what it would inflate to beyond is never made."""
    if compression == NONE:
        return data[:need]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need)
    if compression == LZW:
        return lzw_decode(data, need)
    if compression == PACKBITS:
        return packbits_decode(data, need)
    raise ValueError(f"compression {compression} is not supported")


# -- reading --------------------------------------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in FIELD:
            continue
        code, size = FIELD[kind]
        where = at + 10 + 12 * i
        if n * size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    """The samples of one directory, as height x width x samples."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, n, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or any(b != bits for b in tags.get(BITS, ())):
        raise ValueError(f"{tags.get(BITS)} bits a sample are not supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes = n if one(PLANAR, 1) == 2 else 1
    inside = 1 if planes > 1 else n
    if TILES in tags:
        bw, bh = one(TILE_W, 0), one(TILE_H, 0)
        offsets, counts = tags[TILES], tags[TILE_BYTES]
    else:
        bw, bh = width, min(one(ROWS, height), height)
        offsets, counts = tags[STRIPS], tags[STRIP_BYTES]
    if not (width and height and bw and bh):
        raise ValueError("the image or its blocks have no area")
    across, down = -(-width // bw), -(-height // bh)
    if min(len(offsets), len(counts)) < planes * across * down:
        raise ValueError("blocks are missing")
    out = np.zeros((height, width, n), kind.newbyteorder("="))
    for i in range(planes * across * down):
        plane, y, x = i // (across * down), i // across % down * bh, i % across * bw
        rows = bh if TILES in tags else min(bh, height - y)
        raw = _unpack(data[offsets[i] : offsets[i] + counts[i]], one(COMPRESSION, NONE), rows * bw * inside * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * bw * inside).reshape(rows, bw, inside).astype(out.dtype)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {one(PREDICTOR, 1)} is not supported")
        seen = block[: height - y, : width - x]
        out[y : y + bh, x : x + bw, plane : plane + inside] = seen
    return out


def read_pages(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """Walks the chain of image directories, whatever their order in the file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield tags, _page(data, tags, order)


# -- writing --------------------------------------------------------------------------------------------


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of the given pages (height x width or height x width x samples, 8 or 16 bits), in strips or tiles."""
    pack = {NONE: bytes, DEFLATE: zlib.compress, LZW: lzw_encode, PACKBITS: packbits_encode}[compression]
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        height, width, n = a.shape
        bh, bw = tile or (min(rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = a[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = pack(block.astype(block.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        out += b"\0" * (len(out) % 2)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * a.dtype.itemsize] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if n == 3 else 1]), SAMPLES: (3, [n]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_W: (4, [bw]), TILE_H: (4, [bh]), TILES: (4, offsets), TILE_BYTES: (4, counts)} if tile else {ROWS: (4, [bh]), STRIPS: (4, offsets), STRIP_BYTES: (4, counts)}
        entries, at = bytearray(), len(out)
        after = at + 2 + 12 * len(fields) + 4
        more = bytearray()
        for tag, (kind, values) in sorted(fields.items()):
            code, _ = FIELD[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            entries += struct.pack(order + "HHI", tag, kind, len(values))
            if len(raw) <= 4:
                entries += raw.ljust(4, b"\0")
            else:
                entries += struct.pack(order + "I", after + len(more))
                more += raw + b"\0" * (len(raw) % 2)
        struct.pack_into(order + "I", out, link, at)
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0" + more
    return bytes(out)


# -- operators ------------------------------------------------------------------------------------------


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of a page's samples, from exact counts."""
    n = np.bincount(samples.ravel(), minlength=1)
    total, at = int(n.sum()), np.arange(len(n))
    mean = float((n * at).sum()) / total
    var = float((n * at * at).sum()) / total - mean * mean
    p = n[n > 0] / total
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]} mean={mean:.4f} dev={max(var, 0.0) ** 0.5:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f}"


def tiff_pages(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """One row per page of each TIFF in ``content``: keys, page, width, height, bands, bits, compression,
    predictor, pixels (rows of samples, 16-bit ones little-endian), feature, error.

    Reads both byte orders, strips and tiles, 8- and 16-bit samples, none, PackBits, LZW and deflate data, and
    the horizontal predictor. Null or empty content, what is not a TIFF, and a damaged page give one row whose
    error says why and whose other columns but the keys are null (pages before the damage come out).
    Repeated rows give repeated pages; an empty table gives none. Work is per row: no shuffle.
    """
    fields = [df.schema[k] for k in keys]
    own = T.StructType.fromDDL("page int, width int, height int, bands int, bits int, compression int, predictor int, pixels binary, feature string, error string")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, data in enumerate(batch.column(len(keys)).to_pylist()):
                at = 0
                try:
                    if not data:
                        raise ValueError("no content")
                    for at, (tags, a) in enumerate(read_pages(data)):
                        index.append(i)
                        rows.append((at, a.shape[1], a.shape[0], a.shape[2], 8 * a.dtype.itemsize, tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0], a.astype(a.dtype.newbyteorder("<")).tobytes(), feature(a), None))
                except (ValueError, KeyError, OverflowError, MemoryError, struct.error, zlib.error) as e:  # absurd sizes in a header too
                    index.append(i)
                    rows.append((None,) * 9 + (f"{type(e).__name__}: {e}",))
            kept = batch.select(range(len(keys))).take(pa.array(index, pa.int64()))
            types = [pa.int32()] * 7 + [pa.binary(), pa.string(), pa.string()]
            made = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*(f"__k{i}" for i in range(len(keys))), *own.names])

    slim = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(content).alias("__content"))
    schema = T.StructType([T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(fields)] + own.fields)
    out = slim.mapInArrow(pages, schema)
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *own.names)


def text_to_tiff(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 64, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Stores each text's UTF-8 bytes, filled with 0 up to a positive multiple of ``width``, as a one-page TIFF.

    Returns doc_id, n_bytes (unfilled), content. A null text is empty; rows are independent, so repeated rows
    and null ids come back as they are.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode()
                full = raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")
                sizes.append(len(raw))
                files.append(write_pages([np.frombuffer(full, np.uint8).reshape(-1, width)], compression, predictor))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "content"])

    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return slim.mapInArrow(store, "id long, n_bytes long, content binary").withColumnRenamed("id", doc_id)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = text_to_tiff(table(spark, sf_dir, "documents"))
    stored = stored.select("doc_id", "n_bytes", F.length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"), "content")
    pages = tiff_pages(stored, "content", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    # a page that cannot be read back fails the query: its digest would be of nothing
    pixels = F.when(F.col("error").isNull(), F.col("pixels")).otherwise(F.raise_error(F.col("error")))
    return pages.withColumn("pixels", pixels).select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "page",
    )
