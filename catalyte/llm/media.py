"""Baseline JPEG media columns.

``decode`` parses the markers of a baseline JPEG, Huffman-decodes its scan and
returns the quantised coefficients; ``luminance_thumbnail`` rebuilds the
DC-only luminance image (one pixel for each 8x8 block) in numpy.

``encode_payload`` stores arbitrary bytes losslessly as the format's unit, the
quantised coefficient: 64 bytes are one block, in zigzag order. Its Huffman
tables give the size class s a code of 9 - s bits, so code and amplitude bits
always add up to 9: such scans, whoever wrote them, are decoded without a loop
(``_decode_even``); all others go through the bit-by-bit decoder.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, texts_of

BLOCK = 64
#: Quantisation: 8 for DC, so that a DC step is one grey level; 1 for AC.
QUANT = bytes([8] + [1] * 63)
TOTAL = 9


# --------------------------------------------------------------------------
# Huffman tables


def huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical (length, code, symbol) of a DHT segment."""
    out, code, at = [], 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _extend(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _table(sizes: list[int]) -> tuple[bytes, bytes]:
    """Code lengths TOTAL - size for each size class."""
    ordered = sorted(sizes, reverse=True)
    return bytes(sum(TOTAL - s == n for s in ordered) for n in range(1, 17)), bytes(ordered)


DC_TABLE, AC_TABLE = _table(list(range(9))), _table(list(range(1, 9)))


def _words(table: tuple[bytes, bytes]) -> dict[int, int]:
    """Amplitude -> the 9 bits that stand for it."""
    out = {}
    for length, code, size in huffman_codes(*table):
        for bits in range(1 << size):
            out[_extend(bits, size)] = code << size | bits
    return out


def _bit_rows(words: list[int]) -> np.ndarray:
    return np.array([[w >> (TOTAL - 1 - k) & 1 for k in range(TOTAL)] for w in words], np.uint8)


_dc, _ac = _words(DC_TABLE), _words(AC_TABLE)
#: Bits of a DC difference (-255 .. 255) and of the AC value of a byte: AC values
#: are never zero (-128 .. -1 and 1 .. 128), so there are no runs.
DC_BITS = _bit_rows([_dc[d] for d in range(-255, 256)])
AC_BITS = _bit_rows([_ac[b - 128 if b < 128 else b - 127] for b in range(256)])


# --------------------------------------------------------------------------
# encoding


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode_payload(payload: bytes) -> bytes:
    """A baseline greyscale JPEG that holds ``payload`` (a positive multiple of
    64 bytes). The grid is as square as can be; blocks after the payload hold
    zero bytes, and an APP11 segment says where it ends."""
    n = len(payload) // BLOCK
    across = int(np.ceil(np.sqrt(n)))
    down = -(-n // across)
    data = np.zeros((across * down, BLOCK), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    scan = []
    dc = data[:, 0].astype(np.int16) - 128
    diffs = np.diff(dc, prepend=np.int16(0)) + 255
    for at in range(0, len(data), 1 << 14):
        bits = AC_BITS[data[at : at + (1 << 14)]]
        bits[:, 0] = DC_BITS[diffs[at : at + (1 << 14)]]
        scan.append(np.packbits(bits.reshape(-1)).tobytes())
    frame = bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xEB, b"TEXT\0" + len(payload).to_bytes(8, "big")),
            _segment(0xDB, b"\0" + QUANT),
            _segment(0xC0, frame),
            _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]),
            _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            b"".join(scan).replace(b"\xff", b"\xff\x00"),
            b"\xff\xd9",
        ]
    )


# --------------------------------------------------------------------------
# decoding


class Jpeg:
    """Parsed markers of one baseline JPEG."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.app: dict[int, bytes] = {}
        self.restart, self.components, at = 0, [], 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("not 8-bit samples")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif 0xE0 <= marker <= 0xEF:
                self.app[marker] = body
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])}
                break
        end = data.rfind(b"\xff\xd9")
        self.scan = data[at : end if end >= at else len(data)]

    def decode(self) -> list[np.ndarray]:
        """Quantised coefficients of each component: (blocks down, blocks
        across, 64), zigzag order."""
        even = self._decode_even()
        return [even] if even is not None else self._decode_any()

    def _even_table(self, key: int) -> np.ndarray | None:
        """Value of each 9-bit word, if code and amplitude always take 9 bits
        and no symbol has a run."""
        values = np.full(1 << TOTAL, 1 << 14, np.int32)
        for length, code, symbol in huffman_codes(*self.huffman[key]):
            if symbol >> 4 or length + symbol != TOTAL or (key & 0x10 and not symbol):
                return None
            for bits in range(1 << symbol):
                values[code << symbol | bits] = _extend(bits, symbol)
        return values

    def _decode_even(self) -> np.ndarray | None:
        if len(self.components) != 1 or self.restart:
            return None
        dc, ac = (self._even_table(k) for k in self.tables[self.components[0][0]])
        if dc is None or ac is None:
            return None
        across, down = -(-self.width // 8), -(-self.height // 8)
        raw = np.frombuffer(self.scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        n, step = across * down, 1 << 14
        if len(raw) != n * BLOCK * TOTAL // 8:
            raise ValueError("the scan has another length")
        out = np.empty((n, BLOCK), np.int16)
        for at in range(0, n, step):
            bits = np.unpackbits(raw[at * 72 : (at + step) * 72]).reshape(-1, BLOCK, TOTAL)
            words = np.zeros(bits.shape[:2], np.int32)
            for k in range(TOTAL):
                words = words << 1 | bits[:, :, k]
            part = ac[words]
            part[:, 0] = dc[words[:, 0]]
            if (part >= 1 << 14).any():
                raise ValueError("no such code")
            out[at : at + step] = part
        out[:, 0] = np.cumsum(out[:, 0], dtype=np.int64)
        return out.reshape(down, across, BLOCK)

    def _decode_any(self) -> list[np.ndarray]:
        """Any baseline scan: interleaved components, sampling factors, runs,
        restart intervals."""
        codes = {k: {(n, c): s for n, c, s in huffman_codes(*t)} for k, t in self.huffman.items()}
        if not self.components or not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in self.components):
            raise ValueError("sampling factors out of range")
        if self.width * self.height // 64 > 4 * len(self.scan):
            raise ValueError("the scan is too short")  # a block takes two bits at least
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        mcu_w, mcu_h = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        single = len(self.components) == 1
        shapes = []
        for _, h, v, _ in self.components:
            if single:
                shapes.append((-(-self.height // 8), -(-self.width // 8)))
            else:
                shapes.append((mcu_h * v, mcu_w * h))
        out = [np.zeros((*s, BLOCK), np.int16) for s in shapes]
        chunks, begin, data = [], 0, self.scan
        k = data.find(b"\xff")
        while k >= 0:
            if 0xD0 <= data[k + 1] <= 0xD7:
                chunks.append(data[begin:k])
                begin = k + 2
            k = data.find(b"\xff", k + 2)
        chunks.append(data[begin:])
        chunk, at, bits, last = 0, 0, None, [0] * len(self.components)

        def load():
            return np.unpackbits(np.frombuffer(chunks[chunk].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()

        bits = load()

        def symbol(key: int) -> int:
            nonlocal at
            code, table = 0, codes[key]
            for n in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        def amplitude(size: int) -> int:
            nonlocal at
            value = 0
            for b in bits[at : at + size]:
                value = value << 1 | b
            at += size
            return _extend(value, size)

        units = shapes[0][0] * shapes[0][1] if single else mcu_w * mcu_h
        for unit in range(units):
            if self.restart and unit and unit % self.restart == 0:
                chunk, at, last = chunk + 1, 0, [0] * len(self.components)
                bits = load()
            for k, (name, h, v, _) in enumerate(self.components):
                dc, ac = self.tables[name]
                for part in range(1 if single else h * v):
                    if single:
                        y, x = divmod(unit, shapes[0][1])
                    else:
                        y, x = unit // mcu_w * v + part // h, unit % mcu_w * h + part % h
                    last[k] += amplitude(symbol(dc))
                    block = out[k][y, x]
                    block[0], i = last[k], 1
                    while i < BLOCK:
                        s = symbol(ac)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i] = amplitude(s & 15)
                        i += 1
        return out

    def luminance_thumbnail(self, coefficients: list[np.ndarray]) -> np.ndarray:
        """One grey level for each luminance block, from its DC term alone."""
        step = int(self.quant[self.components[0][3]][0])
        return np.clip(np.round(coefficients[0][:, :, 0].astype(np.float64) * step / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(image: np.ndarray) -> str:
    """Average hash: 64 cells, each brighter than the mean or not."""
    rows = np.array_split(np.arange(image.shape[0]), 8) if image.shape[0] >= 8 else [[min(k * image.shape[0] // 8, image.shape[0] - 1)] for k in range(8)]
    cols = np.array_split(np.arange(image.shape[1]), 8) if image.shape[1] >= 8 else [[min(k * image.shape[1] // 8, image.shape[1] - 1)] for k in range(8)]
    wide = image.astype(np.int64)
    cells = np.array([[wide[r[0] : r[-1] + 1, c[0] : c[-1] + 1].mean() for c in cols] for r in rows])
    return np.packbits(cells.reshape(-1) > cells.mean()).tobytes().hex()


def payload_of(image: Jpeg, coefficients: list[np.ndarray]) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    body = image.app.get(0xEB, b"")
    if body[:5] != b"TEXT\0":
        raise ValueError("no payload")
    values = coefficients[0].reshape(-1, BLOCK).astype(np.int16)
    data = np.where(values < 0, values + 128, values + 127)
    data[:, 0] = values[:, 0] + 128
    return data.astype(np.uint8).tobytes()[: int.from_bytes(body[5:13], "big")]


# --------------------------------------------------------------------------
# columns


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a JPEG column."""

    bound_batches(docs.sparkSession)

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                raws = [t.encode() for t in texts_of(batch.column("text"))]
                media = [encode_payload(r + bytes(-len(r) % BLOCK if r else BLOCK)) for r in raws]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Reads a media column back: width, height, thumbnail and its hash, and
    the digests of payload and file. A null or undecodable image gives nulls."""

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        try:
            image = Jpeg(data)
            coefficients = image.decode()
            payload = payload_of(image, coefficients)
            small = image.luminance_thumbnail(coefficients)
            print_of = thumbnail_hash(small)
        except (ValueError, LookupError, ArithmeticError):
            return (None, None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None)
        return (
            image.width,
            image.height,
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-BLOCK:]),
            len(data),
            hashlib.sha256(data).hexdigest(),
            f"{image.width}x{image.height}:{print_of}:{zlib.crc32(small.tobytes()):08x}",
        )

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(features(m.as_py()) for m in batch.column("media")), strict=True)
                found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *found], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs`` as a baseline JPEG and describes what is
    read back from it. Null and empty texts are one block of zero bytes;
    repeated rows stay; an empty table gives no rows; columns other than doc_id
    and text are ignored. The media column is computed where it is read: written
    out it would take 1.9 times the input, of which the budget allows 1.5;
    ``with_media(docs).write`` keeps it."""
    return media_features(with_media(docs))
