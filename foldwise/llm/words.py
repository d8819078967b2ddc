"""Word kernels: numpy over the UTF-8 bytes of many texts at once, and small codecs for packed columns."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard

from foldwise.session import ship_package

U64 = np.uint64
SPREAD = U64(0x9E3779B97F4A7C15)
STEP = 0x100000001B3
CHUNK_BYTES = (1 << 20) - 4096

#: Words are maximal runs of the bytes marked here.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def session_limits(spark) -> None:
    """Arrow batches of bounded size: texts may be long, and a batch lies in memory whole."""
    ship_package(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20)),
    ):
        spark.conf.set(key, value)


def utf8(text, lower: bool = False) -> bytes:
    """Bytes of a text (null: none); only A-Z are lower-cased."""
    data = b"" if text is None or text != text else text.encode()
    return data.lower() if lower else data


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(size + 1, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(STEP), table(pow(STEP, -1, 1 << 64))


#: Spans up to this many bytes are read eight bytes at a time by numpy, longer ones one by one.
SHORT_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class Pieces:
    """Byte spans of one buffer, read eight bytes at a time."""

    def __init__(self, data: bytes):
        self.data = data
        self.eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))

    def names(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span. A bijection of state and piece takes in one piece after the other."""
        size = end - start
        out = mix(size.astype(U64) * SPREAD + U64(seed))
        alive = np.flatnonzero((size > 0) & (size <= SHORT_BYTES))
        at, left = start[alive], size[alive]
        while len(alive):
            out[alive] = mix(out[alive] ^ (self.eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
            more = left > 8
            alive, at, left = alive[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > SHORT_BYTES).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[start[i] : end[i]], seed)
        return out

    def equal(self, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> bool:
        """Whether each span of the first list holds the bytes of the one at its place in the second."""
        size = end - start
        if not np.array_equal(size, end2 - start2):
            return False
        alive = np.flatnonzero((size <= SHORT_BYTES) & (start != start2))
        a, b, left = start[alive], start2[alive], size[alive]
        while len(a):
            if ((self.eight[a] ^ self.eight[b]) & _FIRST_BYTES[np.minimum(left, 8)]).any():
                return False
            more = left > 8
            a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
        return all(
            self.data[start[i] : end[i]] == self.data[start2[i] : end2[i]] for i in np.flatnonzero((size > SHORT_BYTES) & (start != start2)).tolist()
        )


@dataclass
class Words:
    """The words of several texts, in order: byte spans in ``data``, and where each text's words begin."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @functools.cached_property
    def last(self) -> np.ndarray:
        """For each word, one past the last word of its text."""
        return self.first[1:][self.text_of]

    @functools.cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.data)

    @functools.cached_property
    def names(self) -> np.ndarray:
        """A 64-bit name of each word, from its bytes alone."""
        return self.pieces.names(self.start, self.end)

    @functools.cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct word, which distinct word each word is). Names bring words together, bytes decide."""
        _, at, which = np.unique(self.names, return_index=True, return_inverse=True)
        if not self.pieces.equal(self.start, self.end, self.start[at][which], self.end[at][which]):
            table: dict[bytes, int] = {}
            which = np.array([table.setdefault(self.word(i), len(table)) for i in range(len(self))], np.int64)
            at = np.unique(which, return_index=True)[1]
        return at, which

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def split_words(texts: list[bytes], marks: np.ndarray) -> Words:
    data = b"\n".join(texts) + b"\n"
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = marks[np.frombuffer(data, np.uint8)]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return Words(data, start, end, np.searchsorted(start, begin))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(from, to) of consecutive texts that hold about ``limit`` bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def gram_names(names: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Name of the k words from each position on; none for the last k - 1 positions."""
    n = max(0, len(names) - k + 1)
    out = np.full(n, seed + k, U64)
    for j in range(k):
        out *= U64(0xA24BAED4963EE407)
        out += names[j : n + j]
    return mix(out)


def pack(values: np.ndarray, level: int = 3) -> bytes:
    """Integers as compressed byte planes: high planes of small values cost next to nothing."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    head = bytes(raw.dtype.str, "ascii").ljust(4)
    return head + zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(bytes(data[:4]).decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data[4:])), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    values = unpack(data)
    return np.cumsum(values, dtype=values.dtype)


def squeeze(data: bytes, level: int = 9) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data))
