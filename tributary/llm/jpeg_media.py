"""Bytes kept in progressive JPEG files, and the decoding of such files to RGB tensors.

A payload fills the 8x8 blocks of a 4:2:0 image, first the luma plane, then both chroma planes
(unused blocks hold zeros). Byte b becomes a coefficient whose magnitude has eight bits: b - 255
below 128, else b, and for the DC the pair (b >> 1, b & 1) around the point transform. The
format's unit is the quantised coefficient, so storage is lossless. Each plane is written in
four scans: DC without its last bit, that bit, AC 1-63 without the last bit, that bit
(successive approximation over two spectral bands). The Huffman tables give the only symbols
that occur a one-bit code, so every coefficient has a fixed width and both directions run as
array operations.

The decoder walks the markers, reads any table, accumulates the scans into coefficient arrays,
inverse-transforms in numpy, upsamples chroma and converts to RGB. Scans whose codes all have
the width written here are read as arrays; scans of other files go through a bit reader.

Defined results: a null or empty text is 64 zero bytes; texts of any length work (the grid has
up to 4095 x 4095 units of six blocks); a truncated or foreign file raises ValueError; null ids
and repeated rows keep a row each, with equal values; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.bytestext import encode
from tributary.llm.store import documents

# Fixed values of the JPEG standard: the zigzag order.
ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)
PLANES = ((1, 2), (2, 1), (3, 1))  # id and sampling factor of Y, Cb, Cr
BAND = (1, 63)
UNIT = 64
_k = np.arange(8)
_basis = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)
IDCT = np.einsum("xu,yv->uvxy", _basis, _basis).reshape(64, 64)[:, :].astype(np.float32)


def pad(data: bytes) -> bytes:
    """data with zero bytes appended, to a positive multiple of 64."""
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, 1] + [0] * 15 + [symbol]))


def _scan(plane: int, slot: int, band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, plane, slot << 4 | slot, *band, high << 4 | low])) + data


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of units of six blocks that hold n_blocks."""
    units = max(1, -(-n_blocks // 6))
    columns = -(-units // 4095)
    return columns, -(-units // columns)


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes."""
    columns, rows = grid(len(payload) // UNIT)
    units = columns * rows
    comment = struct.pack(">Q", len(payload))
    out = [b"\xff\xd8", _segment(0xFE, comment)]
    out.append(_segment(0xDB, bytes([0]) + bytes([1] * 64)))
    frame = b"".join(bytes([i, f << 4 | f, 0]) for i, f in PLANES)
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + frame))
    out += [_table(0, 0, 7), _table(1, 0, 7), _table(1, 1, 0)]
    values = np.zeros(units * 6 * UNIT, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, UNIT)
    at = 0
    for plane, factor in PLANES:
        n = units * factor * factor
        part = values[at : at + n]
        at += n
        dc = np.empty((n, 3), np.uint8)
        dc[:, 0], dc[:, 1], dc[:, 2] = part[:, 0] >> 1, 0xFF, 0xD0 + np.arange(n) % 8
        out += [_segment(0xDD, b"\0\1"), _scan(plane, 0, (0, 0), 0, 1, dc.tobytes()[:-2]), _segment(0xDD, b"\0\0")]
        out.append(_scan(plane, 0, (0, 0), 1, 0, _fill(part[:, 0] & 1)))
        out.append(_scan(plane, 0, BAND, 0, 1, (part[:, 1:] >> 1).tobytes()))
        bits = (part & 1) ^ (part < 128)
        bits[:, 0] = 0  # the code of the end of a band, before the block's correction bits
        out.append(_scan(plane, 1, BAND, 1, 0, _fill(bits)))
    return b"".join([*out, b"\xff\xd9"])


def _fill(bits: np.ndarray) -> bytes:
    """Packed bits, padded with ones, with the zero byte that follows 0xFF in a scan."""
    flat = bits.ravel()
    flat = np.concatenate([flat, np.ones(-len(flat) % 8, flat.dtype)])
    return np.packbits(flat.astype(bool)).tobytes().replace(b"\xff", b"\xff\0")


class _Bits:
    """Bits of a scan segment, for files whose codes vary in width."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value * 2 + bit
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return value

    def symbol(self, codes: dict) -> int:
        code = length = 0
        while (length, code) not in codes:
            code, length = code * 2 + self.take(1), length + 1
            if length > 16:
                raise ValueError("no such code")
        return codes[length, code]

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _codes(lengths: bytes, symbols: bytes) -> dict:
    codes, code, at = {}, 0, 0
    for length, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            codes[length, code] = symbol
            code += 1
        code, at = code * 2, at + count
    return codes


def _read_any(segments: list[bytes], blocks: list, band, high: int, low: int, dc: list[dict], ac: dict | None, restart: int) -> None:
    """One scan by the bit reader. blocks: (component index, coefficients of a block) in scan order, grouped by unit."""
    unit = 0
    for data in segments:
        bits, last, run = _Bits(data), {}, 0
        for group in blocks[unit : unit + restart] if restart else blocks[unit:]:
            for part, block in group:
                if band[0] == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        last[part] = last.get(part, 0) + bits.signed(bits.symbol(dc[part]))
                        block[0] = last[part] << low
                elif not high:
                    k = band[0]
                    if run:
                        run -= 1
                        continue
                    while k <= band[1]:
                        skip, size = divmod(bits.symbol(ac), 16)
                        if size:
                            k += skip
                            block[k] = bits.signed(size) * (1 << low)
                            k += 1
                        elif skip == 15:
                            k += 16
                        else:
                            run = (1 << skip) - 1 + (bits.take(skip) if skip else 0)
                            break
                else:
                    k, step = band[0], 1 << low
                    while k <= band[1] and not run:
                        skip, size = divmod(bits.symbol(ac), 16)
                        value = (step if bits.take(1) else -step) if size else 0
                        if not size and skip < 15:
                            run = (1 << skip) + (bits.take(skip) if skip else 0)
                            break
                        while k <= band[1]:
                            if block[k]:
                                block[k] += np.sign(block[k]) * step * bits.take(1)
                            elif skip:
                                skip -= 1
                            else:
                                block[k] = value
                                k += 1
                                break
                            k += 1
                    if run:
                        for j in range(k, band[1] + 1):
                            if block[j]:
                                block[j] += np.sign(block[j]) * step * bits.take(1)
                        run -= 1
        unit += restart or len(blocks)


def _read_fixed(data: bytes, plane: np.ndarray, band, high: int, low: int, restart: int) -> bool:
    """A scan of the layout that store() writes, as arrays; False if it has another layout."""
    n = len(plane)
    if band == (0, 0) and not high and low == 1 and restart == 1 and len(data) == 3 * n - 2:
        x = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(n, 3)[:, 0].astype(np.int16)
        plane[:, 0] = np.where(x < 64, x - 127, x) * 2
    elif band == (0, 0) and high and low == 0 and not restart:
        plane[:, 0] |= np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[:n]
    elif band == BAND and not high and low == 1 and len(data) == 63 * n:
        x = np.frombuffer(data, np.uint8).reshape(n, 63).astype(np.int16)
        if (x > 127).any():
            return False
        plane[:, 1:] = np.where(x < 64, x - 127, x) * 2
    elif band == BAND and high and low == 0 and len(flat := data.replace(b"\xff\0", b"\xff")) == 8 * n and (plane[:, 1:] != 0).all():
        bits = np.unpackbits(np.frombuffer(flat, np.uint8)).reshape(n, 64)
        if bits[:, 0].any():
            return False
        plane[:, 1:] += np.where(plane[:, 1:] < 0, -1, 1).astype(np.int16) * bits[:, 1:]
    else:
        return False
    return True


def _segments(data: bytes, at: int) -> tuple[int, bytes]:
    """Where the scan that begins at `at` ends, and its bytes with restart markers."""
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("the file ends early")
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        else:
            return end, data[at:end]


def coefficients(data: bytes) -> dict:
    """Size, comment and, by plane, sampling factors, quantisation and coefficients in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, restart, quant, huff, image = 2, 0, {}, {}, {"comment": b"", "planes": []}
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image["comment"] = body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            top = (max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts))
            units = (-(-width // (8 * top[0])), -(-height // (8 * top[1])))
            image |= {"width": width, "height": height, "top": top, "units": units}
            for p in parts:
                h, v = p[1] >> 4, p[1] & 15
                own = (-(-width * h // (8 * top[0])), -(-height * v // (8 * top[1])))
                image["planes"].append({"id": p[0], "h": h, "v": v, "q": p[2], "own": own, "stride": units[0] * h, "c": np.zeros((units[0] * h * units[1] * v, 64), np.int16)})
        elif marker == 0xDA:
            n = body[0]
            chosen = [(next(i for i, p in enumerate(image["planes"]) if p["id"] == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(n)]
            band, (high, low) = (body[1 + 2 * n], body[2 + 2 * n]), divmod(body[3 + 2 * n], 16)
            end, scan = _segments(data, at)
            at = end
            plane = image["planes"][chosen[0][0]]
            whole = n == 1 and plane["own"] == (plane["stride"], len(plane["c"]) // plane["stride"])
            table = huff.get((16 if band[0] else 0) | (chosen[0][1] & 15 if band[0] else chosen[0][1] >> 4))
            ours = table in ({(1, 0): 7}, {(1, 0): 0}) or band == (0, 0) and high
            if not (whole and ours and _read_fixed(scan, plane["c"], band, high, low, restart)):
                _read_any(_split(scan), _order(image, chosen), band, high, low, {i: huff.get(t >> 4) for i, t in chosen}, table, restart)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive file with Huffman codes")
    for p in image["planes"]:
        p["quant"] = quant[p["q"]]
    return image


def _split(scan: bytes) -> list[bytes]:
    out, begin, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if scan[at + 1]:
            out.append(scan[begin:at])
            begin = at + 2
        at = scan.find(b"\xff", at + 2)
    return [*out, scan[begin:]]


def _order(image: dict, chosen: list) -> list:
    """Blocks in the order of a scan: by row of one plane, or by unit of several."""
    if len(chosen) == 1:
        p = image["planes"][chosen[0][0]]
        return [[(chosen[0][0], p["c"][y * p["stride"] + x])] for y in range(p["own"][1]) for x in range(p["own"][0])]
    columns, rows = image["units"]
    return [
        [(i, p["c"][(y * p["v"] + v) * p["stride"] + x * p["h"] + h]) for i, p in ((i, image["planes"][i]) for i, _ in chosen) for v in range(p["v"]) for h in range(p["h"])]
        for y in range(rows)
        for x in range(columns)
    ]


def restore(data: bytes) -> bytes:
    """The payload that store() put into a file."""
    return _payload(coefficients(data))


def _payload(image: dict) -> bytes:
    out = []
    for p in image["planes"]:
        c = p["c"]
        values = np.where(c < 0, c + 255, c).astype(np.uint8)
        dc = c[:, 0] >> 1
        values[:, 0] = np.where(dc < 0, dc + 127, dc) << 1 | (c[:, 0] & 1)
        out.append(values)
    return np.concatenate(out).tobytes()[: struct.unpack(">Q", image["comment"])[0]]


def samples(plane: dict) -> np.ndarray:
    """The plane's 8-bit samples, from its coefficients."""
    natural = np.empty((len(plane["c"]), 64), np.float32)
    natural[:, ZIGZAG] = plane["c"] * plane["quant"]
    pixels = np.clip(np.rint(natural @ IDCT + 128), 0, 255).astype(np.uint8)
    rows = len(pixels) // plane["stride"]
    return pixels.reshape(rows, plane["stride"], 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, plane["stride"] * 8)


def rgb(image: dict) -> np.ndarray:
    """A height x width x 3 tensor of 8-bit samples, chroma upsampled by repetition."""
    full = []
    for p in image["planes"]:
        s = samples(p)
        up = s.repeat(image["top"][1] // p["v"], axis=0).repeat(image["top"][0] // p["h"], axis=1)
        full.append(up[: image["height"], : image["width"]].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for channel, value in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):  # BT.601, times 2^16
        out[:, :, channel] = np.clip((value + 32768) >> 16, 0, 255)
    return out


def features(tensor: np.ndarray) -> str:
    """Size, mean of each channel and mean contrast between neighbouring rows, as whole numbers of thousandths."""
    n = tensor.shape[0] * tensor.shape[1]
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // n
    steps = int(np.abs(np.diff(tensor[:, :, 1].astype(np.int16), axis=0)).sum(dtype=np.int64)) * 1000 // n
    return f"{tensor.shape[1]}x{tensor.shape[0]}:" + ",".join(map(str, means)) + f":{steps}"


def _row(doc_id, data: bytes) -> tuple:
    media = store(pad(data))
    image = coefficients(media)
    payload = _payload(image)
    return (
        doc_id,
        len(data),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-UNIT:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        features(rgb(image)),
    )


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored file of every row of docs (doc_id, text)."""

    def stored(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.iloc[i : i + 64]
                yield pd.DataFrame({"doc_id": part["doc_id"], "media": [store(pad(x)) for x in encode(part["text"])]})

    return docs.select("doc_id", "text").mapInPandas(stored, "doc_id long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and the RGB bytes of every row of media (doc_id, media)."""

    def decoded(batches):
        for batch in batches:
            for doc_id, data in zip(batch["doc_id"], batch["media"], strict=True):
                t = rgb(coefficients(data))
                yield pd.DataFrame({"doc_id": [doc_id], "height": [t.shape[0]], "width": [t.shape[1]], "rgb": [t.tobytes()]})

    return media.select("doc_id", "media").mapInPandas(decoded, "doc_id long, height int, width int, rgb binary")


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def digests(batches):
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            yield pd.DataFrame([_row(i, x) for i, x in zip(ids, encode(batch["text"]), strict=True)], columns=names)

    return documents(spark, sf_dir).select("doc_id", "text").mapInPandas(digests, COLUMNS)


QUERIES = {"op8_jpeg_media": op8_jpeg_media}
ORACLE: dict[str, str] = {}  # a file format has no SQL; see the round-trip tests
