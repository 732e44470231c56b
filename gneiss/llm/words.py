"""Words and word hashes shared by the operators that work on word windows.

A word is a maximal run of bytes other than space and the controls 0x09-0x0D of the UTF-8 text, which is exactly
what ``bytes.split()`` without arguments yields. Words are hashed many texts at a time, without making them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)
M3 = np.uint64(0x165667B19E3779F9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * M1
    h ^= h >> np.uint64(29)
    h *= M2
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n + n // 2, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers(int(M1))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * M3)
LOWER = VALUE.copy()
LOWER[65:91] = VALUE[97:123]


def hash_words(data: np.ndarray, values: np.ndarray = VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of the words of a byte array that begins and ends with a space. A word's hash is
    a polynomial in the values of its bytes, as a difference of prefix sums, mixed with its length."""
    space = IS_SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    up, down = POWERS(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up, out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def grams(h: np.ndarray, k: int, salt: np.uint64 = M1) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; none if it is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= salt
        out += h[j : j + n]
    return mix(out)


class Chunk:
    """Rows whose texts are hashed together. ``h``: word hashes end to end; ``of``: the row of each word;
    ``start``, ``size``: each row's first word and number of words."""

    def __init__(self, rows: list[tuple], texts: list[bytes | None], values: np.ndarray = VALUE):
        self.rows, self.texts = rows, texts
        sizes = np.array([len(t or b"") + 1 for t in texts])
        data = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
        self.begin, self.end, self.h = hash_words(data, values)
        self.offset = np.cumsum(sizes) - sizes + 1  # of each text in the data
        self.data = data
        self.start = np.searchsorted(self.begin, self.offset)
        self.size = np.diff(np.append(self.start, len(self.h)))
        self.of = np.repeat(np.arange(len(rows)), self.size)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def small(batches, most: int = 512):
    """Cuts record batches down to ``most`` rows, so that what is held for one batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, values: np.ndarray = VALUE, at_once: int = 400_000) -> Iterator[Chunk]:
    """Rows in chunks of about ``at_once`` bytes of text (or one longer text); rows without the text column."""
    rows, texts, n = [], [], 0
    for b in small(batches):
        more = [b.column(k).to_pylist() for k in range(b.num_columns) if k != text]
        for t, *row in zip(as_bytes(b.column(text)), *more, strict=True):
            rows.append(tuple(row))
            texts.append(t)
            n += len(t or b"") + 1
            if n >= at_once:
                yield Chunk(rows, texts, values)
                rows, texts, n = [], [], 0
    if rows:
        yield Chunk(rows, texts, values)
