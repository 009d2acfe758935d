"""op7 against a plain reader of its own, and features against loops over the payload."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from moorline.llm import tiff


def plain_packbits(data):
    out, i = bytearray(), 0
    while i < len(data):
        head = struct.unpack_from("b", data, i)[0]
        if head >= 0:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head == -128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (1 - head)
            i += 2
    return bytes(out)


def plain_lzw(data):
    """One code at a time, most significant bit first; codes widen one entry early."""
    value, left, bits, table, last, out = 0, 0, 9, None, None, bytearray()
    feed = iter(data)
    while True:
        while left < bits:
            value, left = value << 8 | next(feed), left + 8
        left -= bits
        code, value = value >> left, value & ((1 << left) - 1)
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            return bytes(out)
        if last is None:
            entry = table[code]
        else:
            assert code <= len(table)
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def plain_pages(data):
    """(compression, samples) of each page of a little-endian 8-bit greyscale file, sample by sample."""
    assert data[:4] == b"II*\0"
    at = struct.unpack_from("<I", data, 4)[0]
    while at:
        tags = {}
        for i in range(struct.unpack_from("<H", data, at)[0]):
            here = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from("<HHI", data, here)
            code, size = {3: ("H", 2), 4: ("I", 4)}[kind]
            where = here + 8 if size * count <= 4 else struct.unpack_from("<I", data, here + 8)[0]
            tags[tag] = struct.unpack_from(f"<{count}{code}", data, where)
        assert list(tags) == sorted(tags) and tags[258] == (8,) and tags[277] == (1,)
        (width,), (height,), (kind,) = tags[256], tags[257], tags[259]
        tiled = 322 in tags
        bw, bl = (tags[322][0], tags[323][0]) if tiled else (width, tags[278][0])
        page = [[None] * width for _ in range(height)]
        blocks = list(zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])), strict=True))
        for n, (start, size) in enumerate(blocks):
            raw = data[start : start + size]
            raw = {1: bytes, 5: plain_lzw, 8: zlib.decompress, 32773: plain_packbits}[kind](raw)
            across = -(-width // bw)
            top, side = n // across * bl, n % across * bw
            for y in range(len(raw) // bw):
                level = 0
                for x in range(bw):
                    level = (level + raw[y * bw + x]) % 256 if tags[317] == (2,) else raw[y * bw + x]
                    if top + y < height and side + x < width:
                        assert page[top + y][side + x] is None
                        page[top + y][side + x] = level
        yield kind, bytes(v for row in page for v in row)
        at = struct.unpack_from("<I", data, at + 2 + 12 * len(tags))[0]


@pytest.mark.parametrize("scheme", [tiff.Scheme(c, p, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (None, (32, 16))], ids=str)
def test_plain_reader_reads_what_is_written(scheme):
    image = np.minimum(np.random.default_rng(1).integers(0, 1 << 9, (130, 53)), 255).astype(np.uint8)
    ((kind, samples),) = plain_pages(tiff.write_tiff([(image, scheme)]))
    assert (kind, samples) == (scheme.compression, image.tobytes())


def check(row, raw):
    size = max(1, -(-len(raw) // 576)) * 576
    payload = raw + b"\xff" * (size - len(raw))
    media = tiff.store(payload)
    pages = list(plain_pages(media))
    assert b"".join(samples for _, samples in pages) == payload
    assert len(pages) == -(-size // (48 * 192)) and all(len(samples) == 48 * 192 for _, samples in pages[:-1])
    kinds = sorted({kind for kind, _ in pages})
    feature = f"pages={len(pages)};compressions={'+'.join(map(str, kinds))};levels={len(set(payload))};sum={sum(payload)}"
    assert (row.media_bytes, row.media_sha256, row.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    return kinds


def test_media_and_features_by_hand(spark, docs):
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in tiff.text_media(docs).collect():
        check(r, text[r.doc_id])


def test_media_of_awkward_texts(spark):
    """Null, empty, exact multiples, a text of several pages of every codec, one of a single repeated letter."""
    texts = [None, "", "x" * 575, "x" * 576, "x" * 577, "é" * 20_000, "".join(f"{i} " for i in range(12_000)), "a" * 100_000, "x" * 577]
    rows = {r.doc_id: r for r in tiff.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    used = {i: check(r, (texts[i] or "").encode()) for i, r in rows.items()}
    assert used[6] == [tiff.LZW, tiff.DEFLATE] + [tiff.PACKBITS]
    assert rows[0][1:] == rows[1][1:] and rows[4][1:] == rows[8][1:]
