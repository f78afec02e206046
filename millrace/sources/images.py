"""Perceptual hashes of images. Of the formats, PNG is decoded here (8 bits a channel, not interlaced); whatever can't be decoded has no hash."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.session import ship

#: The signature of the format and its channels by colour type; weights of red, green and blue in brightness.
SIGNATURE, CHANNELS, BRIGHTNESS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, (0.299, 0.587, 0.114)
SIDE, KEPT = 32, 8


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The bytes of the rows, with the format's row filters undone."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        kind, row = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            row += above
        elif kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step])
        elif kind in (3, 4):
            for x in range(stride):
                left, corner = (row[x - step], above[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    row[x] += (left + above[x]) // 2
                else:
                    near = [abs(above[x] - corner), abs(left - corner), abs(left + above[x] - 2 * corner)]
                    row[x] += (left, above[x], corner)[int(np.argmin(near))]
                row[x] &= 255
        elif kind:
            raise ValueError("unknown row filter")
        above = row & 255
        out[y] = above
    return out


def brightness(raw: bytes) -> np.ndarray:
    """The brightness of an image's pixels, 0 to 255."""
    if raw[:8] != SIGNATURE:
        raise ValueError("unknown format")
    at, data, palette = 8, b"", None
    while at + 8 <= len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    if bits != 8 or interlaced:
        raise ValueError("unknown layout")
    n = CHANNELS[colour]
    pixels = _unfiltered(zlib.decompress(data), height, width * n, n).reshape(height, width, n)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    return (pixels[:, :, :3] @ np.array(BRIGHTNESS)) if pixels.shape[2] >= 3 else pixels[:, :, 0].astype(float)


def _resized(x: np.ndarray, side: int) -> np.ndarray:
    """Means over side x side cells, which share the pixels at their borders by area."""

    def weights(n: int) -> np.ndarray:
        low, high = np.arange(side)[:, None] * n / side, (np.arange(side)[:, None] + 1) * n / side
        at = np.arange(n)[None, :]
        w = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(x.shape[0]) @ x @ weights(x.shape[1]).T


def perceptual_hash(raw: bytes | None) -> str | None:
    """64 bits in hexadecimal: which of the lowest frequencies of the brightness are above their median. Null where the image can't be read."""
    try:
        small = _resized(brightness(raw or b""), SIDE)
    except (ValueError, KeyError, IndexError, TypeError, UnboundLocalError, zlib.error, struct.error):
        return None
    k = np.arange(SIDE)
    cosines = np.cos(np.pi * (2 * k[None, :] + 1) * k[:KEPT, None] / (2 * SIDE))
    low = cosines @ small @ cosines.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def phash(content: Column) -> Column:
    """The perceptual hash of each image."""
    ship()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(perceptual_hash)

    return run(content)
