"""TIFF as table rows: walk image directories, decode strips and tiles, emit one row per page.

Baseline and common extensions: both byte orders, strips and tiles, 8 and 16 bit
chunky samples, no compression, LZW, deflate and PackBits, horizontal predictor. The
writer stores 8-bit greyscale pages with any of these.

``tiff_pages`` gives a row for each page of each file; a file that is null, empty or
broken gives one row whose ``error`` says why (sizes are held against the file's length
before anything is allocated), so no file is lost silently and none ends the job. Repeated
files give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: tags and compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4}
CLEAR, END = 256, 257
MOST_EXPANDED = 2048  #: most decoded bytes for each stored one: no codec here exceeds it (deflate reaches 1032, LZW 1365)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += head + 2
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([starts, [len(a)]]))
    long = sizes >= 3
    out, at = [], 0

    def literal(stop: int) -> None:
        nonlocal at
        while at < stop:
            n = min(128, stop - at)
            out.append(bytes([n - 1]) + data[at : at + n])
            at += n

    for start, size in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        literal(start)
        while size >= 2:
            n = min(128, size)
            out.append(bytes([257 - n, data[start]]))
            size, at = size - n, at + n
        literal(at + size)
    literal(len(data))
    return b"".join(out)


def _code_offsets() -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code after a clear code: a code is widened one entry early."""
    entries = np.arange(258, 4096 + 2)
    widths = np.where(entries < 511 + 1, 9, np.where(entries < 1023 + 1, 10, np.where(entries < 2047 + 1, 11, 12)))
    return np.concatenate([[0], np.cumsum(widths)[:-1]]), widths


_OFFSETS, _WIDTHS = _code_offsets()
_SINGLE = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    codes, table, w = [CLEAR], {}, -1
    segments = []
    for b in data:
        if w < 0:
            w = b
            continue
        key = w << 8 | b
        known = table.get(key)
        if known is not None:
            w = known
            continue
        codes.append(w)
        if len(table) == 4094 - 258:
            codes.append(CLEAR)
            segments.append(codes)
            codes, table = [], {}
        else:
            table[key] = 258 + len(table)
        w = b
    if w >= 0:
        codes.append(w)
    codes.append(END)
    segments.append(codes)
    flat = np.array([c for s in segments for c in s], dtype=np.uint32)
    widths = np.concatenate([_WIDTHS[: len(s) - 1] if i == 0 else _WIDTHS[: len(s)] for i, s in enumerate(segments)])
    widths = np.concatenate([[9], widths])
    ends = np.cumsum(widths)
    shift = (-ends) % 8
    last = (ends + 7) // 8 - 1
    value = flat << shift.astype(np.uint32)
    out = np.zeros(int(last[-1]) + 4, dtype=np.int64)
    for k in range(3):
        np.add.at(out, last - k + 2, (value >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64))
    return out[2 : 3 + int(last[-1])].astype(np.uint8).tobytes()


def lzw_decode(data: bytes) -> bytes:
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    total, bit, out = 8 * len(data), 0, []
    while bit + 9 <= total:
        n = int(np.searchsorted(_OFFSETS, total - bit))
        at, widths = bit + _OFFSETS[:n], _WIDTHS[:n]
        byte = at >> 3
        word = raw[byte] << 16 | raw[byte + 1] << 8 | raw[np.minimum(byte + 2, len(raw) - 1)]
        codes = word >> (24 - (at & 7) - widths).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            own = codes[:stop].tolist()
            table = [*_SINGLE, b"", b""]
            last = table[own[0]]
            out.append(last)
            for c in own[1:]:
                entry = table[c] if c < len(table) else last + last[:1]
                table.append(last + entry[:1])
                out.append(entry)
                last = entry
        if stop == n or codes[stop] == END:
            break
        bit = int(at[stop] + widths[stop])
    return b"".join(out)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    data = block.tobytes()
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return packbits_encode(data) if compression == PACKBITS else data


@dataclass(frozen=True)
class Scheme:
    compression: int
    predictor: int = 1
    tile: tuple[int, int] | None = None  #: (width, length), multiples of 16; strips where None
    rows: int = 48  #: rows in a strip


def write_tiff(pages: list[tuple[np.ndarray, Scheme]]) -> bytes:
    """A little-endian file of 8-bit greyscale pages."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for number, (image, s) in enumerate(pages):
        height, width = image.shape
        blocks = []
        if s.tile:
            tw, tl = s.tile
            padded = np.zeros((-(-height // tl) * tl, -(-width // tw) * tw), dtype=np.uint8)
            padded[:height, :width] = image
            blocks = [_packed(padded[y : y + tl, x : x + tw], s.compression, s.predictor) for y in range(0, padded.shape[0], tl) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [_packed(image[y : y + s.rows], s.compression, s.predictor) for y in range(0, height, s.rows)]
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [s.compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [s.predictor])]
        sizes = [len(b) for b in blocks]
        if s.tile:
            tags += [(TILE_WIDTH, 4, [s.tile[0]]), (TILE_LENGTH, 4, [s.tile[1]]), (TILE_OFFSETS, 4, sizes), (TILE_COUNTS, 4, sizes)]
        else:
            tags += [(ROWS_PER_STRIP, 4, [s.rows]), (STRIP_OFFSETS, 4, sizes), (STRIP_COUNTS, 4, sizes)]
        tags.sort()
        ifd = 2 + 12 * len(tags) + 4
        extra = sum(4 * len(v) for _, _, v in tags if len(v) > 1)
        here = len(out)
        at, starts = here + ifd + extra, []
        for n in sizes:
            starts.append(at)
            at += n
        at += at % 2
        head, tail = bytearray(struct.pack("<H", len(tags))), bytearray()
        for tag, kind, values in tags:
            values = starts if tag in (STRIP_OFFSETS, TILE_OFFSETS) else values
            if len(values) == 1:
                head += struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", values[0])
            else:
                head += struct.pack("<HHII", tag, kind, len(values), here + ifd + len(tail))
                tail += struct.pack(f"<{len(values)}I", *values)
        head += struct.pack("<I", at if number + 1 < len(pages) else 0)
        out += head + tail + b"".join(blocks)
        out += bytes(at - len(out))
    return bytes(out)


def _value(data: bytes, order: str, kind: int, count: int, at: int) -> list[int]:
    size = _SIZES.get(kind, 1)
    if size * count > len(data):
        raise ValueError("values beyond the end of the file")
    if size * count > 4:
        at = struct.unpack_from(f"{order}I", data, at)[0]
    code = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I"}.get(kind)
    if code is None:
        return []
    return list(struct.unpack_from(f"{order}{count}{code}", data, at))


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """(byte order, tags) of each image directory in chain order; a chain that loops is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directory chain loops")
        seen.add(at)
        n = struct.unpack_from(f"{order}H", data, at)[0]
        if at + 2 + 12 * n + 4 > len(data):
            raise ValueError("directory beyond the end of the file")
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            tags[tag] = _value(data, order, kind, count, at + 2 + 12 * i + 8)
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def page_samples(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    """(rows, columns, samples) of one page."""
    width, height = tags[WIDTH][0], tags[LENGTH][0]
    samples, bits = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])[0]
    compression, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample")
    if TILE_WIDTH in tags:
        bw, bl = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        starts, sizes = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bw, bl = width, min(height, tags.get(ROWS_PER_STRIP, [height])[0])
        starts, sizes = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(width, height, samples, bw, bl) < 1:
        raise ValueError("a size of zero")
    across, down = -(-width // bw), -(-height // bl)
    if len(starts) != len(sizes) or len(starts) != across * down:
        raise ValueError(f"{len(starts)} blocks for {across} x {down}")
    block_bytes = bw * bl * samples * bits // 8
    if block_bytes > MOST_EXPANDED * max(1, max(sizes)) or any(a + n > len(data) for a, n in zip(starts, sizes, strict=True)):
        raise ValueError("blocks larger than the file allows")
    out = np.zeros((height, width, samples), dtype=np.uint8 if bits == 8 else np.uint16)
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = data[start : start + size]
        if compression == LZW:
            raw = lzw_decode(raw)
        elif compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, block_bytes)
        elif compression == PACKBITS:
            raw = packbits_decode(raw)
        elif compression != NONE:
            raise ValueError(f"compression {compression}")
        y, x = i // across * bl, i % across * bw
        rows = bl if TILE_WIDTH in tags else min(bl, height - y)
        block = np.frombuffer(raw, dtype=np.dtype(np.uint8 if bits == 8 else np.uint16).newbyteorder(order), count=rows * bw * samples).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        out[y : y + rows, x : x + bw] = block[: height - y, : width - x]
    return out


def read_pages(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    for order, tags in directories(data):
        yield tags, page_samples(data, order, tags)


_PAGE = "page int, width int, height int, samples_per_pixel int, bits int, compression int, samples binary, error string"


def tiff_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each page of ``files(key, content)``: geometry, compression and decoded samples in row order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "page", "width", "height", "samples_per_pixel", "bits", "compression", "samples", "error"]
        types = [None, *[pa.int32()] * 6, pa.binary(), pa.string()]
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for i in range(batch.num_rows):
                own, rows = batch.column(0)[i].as_py(), []
                try:
                    for n, (tags, image) in enumerate(read_pages(batch.column(1)[i].as_py() or b"")):
                        rows.append((own, n, image.shape[1], image.shape[0], image.shape[2], image.dtype.itemsize * 8, tags.get(COMPRESSION, [NONE])[0], image.tobytes(), None))
                except Exception as e:  # whatever a broken file raises is its own row's error, never the job's
                    rows.append((own, len(rows), None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {_PAGE}")


UNIT, COLUMNS, PAGE_ROWS = 576, 48, 192  #: a payload is a multiple of 48 x 12 samples; a page holds up to 48 x 192

#: What successive pages of a payload are stored with; the first one's place follows from the payload.
SCHEMES = (Scheme(PACKBITS), Scheme(LZW), Scheme(DEFLATE, predictor=2, tile=(48, 48)), Scheme(DEFLATE))


def store(payload: bytes) -> bytes:
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, COLUMNS)
    first = zlib.crc32(payload)
    return write_tiff([(image[y : y + PAGE_ROWS], SCHEMES[(first + i) % len(SCHEMES)]) for i, y in enumerate(range(0, len(image), PAGE_ROWS))])


def text_media(docs: DataFrame) -> DataFrame:
    """Each text of ``docs(doc_id, text)`` stored as TIFF pages, read back page by page, with digests and features of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
            rows = []
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                payload = raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))
                media = store(payload)
                sha, tail, pages, total, kinds = hashlib.sha256(), b"", 0, 0, set()
                levels = np.zeros(256, dtype=np.int64)
                for tags, image in read_pages(media):
                    part = image.tobytes()
                    sha.update(part)
                    tail = (tail + part)[-32:]
                    levels += np.bincount(image.ravel(), minlength=256)
                    pages, total = pages + 1, total + len(part)
                    kinds.add(tags[COMPRESSION][0])
                feature = f"pages={pages};compressions={'+'.join(map(str, sorted(kinds)))};levels={int((levels > 0).sum())};sum={int((levels * np.arange(256)).sum())}"
                rows.append((len(raw), total, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
