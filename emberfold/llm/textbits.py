"""Vectorised helpers over the UTF-8 bytes of many texts; used inside tasks only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes, and texts, that are turned into arrays at a time.
PIECE = 1 << 20
TEXTS = 512


def grouped(texts: Iterable[bytes], overlap: int = 0, most: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about ``most`` bytes and at most TEXTS parts; long texts are cut, with ``overlap`` bytes shared."""
    out: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            part = text[at : at + most + overlap]
            out.append((i, at, part))
            size += len(part)
            if size >= most or len(out) >= TEXTS:
                yield out
                out, size = [], 0
            at += most
            if at + overlap >= len(text) or at >= len(text):
                break
    if out:
        yield out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_counts(texts: list[bytes], n: int, bins: int, lut: np.ndarray | None = None) -> np.ndarray:
    """(texts, bins) float32: how often each hashed ``n``-byte gram is in each whole text; ``lut`` maps bytes first."""
    out = np.zeros((len(texts), bins), np.float32)
    for group in grouped(texts, n - 1):
        lens = np.array([len(p) for _, _, p in group])
        raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        if len(raw) < n:
            continue
        x = (raw if lut is None else lut[raw]).astype(np.uint32)
        code = np.zeros(len(x) - n + 1, np.uint32)
        for j in range(n):
            code = code * np.uint32(257) + x[j : len(x) - n + 1 + j]
        code = code * np.uint32(2654435761)
        code = (code ^ (code >> np.uint32(15))) % np.uint32(bins)
        first = np.repeat(np.arange(len(group)), lens)
        ends = np.repeat(np.cumsum(lens), lens)
        good = np.arange(len(code)) + n <= ends[: len(code)]
        flat = first[: len(code)][good].astype(np.int64) * bins + code[good]
        part = np.bincount(flat, minlength=len(group) * bins).reshape(len(group), bins)
        np.add.at(out, [i for i, _, _ in group], part.astype(np.float32))
    return out


def whole(texts: Iterable[bytes], most: int = PIECE) -> Iterator[list[int]]:
    """Numbers of texts in groups of about ``most`` bytes; a long text is a group of its own."""
    out: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if out and size + len(t) > most or len(out) >= TEXTS:
            yield out
            out, size = [], 0
        out.append(i)
        size += len(t)
    if out:
        yield out


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n, PIECE + (1 << 12))
            steps = np.full(most, BASE, np.uint64), np.full(most, BASE_INVERSE, np.uint64)
            steps[0][0] = steps[1][0] = 1
            self.up, self.down = np.cumprod(steps[0]), np.cumprod(steps[1])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers; ``piece_hash`` reads the hash of any stretch from them."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def piece_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, stop), equal for equal content wherever it stands."""
    _, down = POWERS.get(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])
