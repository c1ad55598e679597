"""Words of many texts at once: byte tables and running sums over a batch in place of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are joined into stretches of at least one text and about this many bytes.
STRETCH = 1 << 18

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)  # odd, so its powers can be inverted modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower-cased bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, STRETCH * 2)
        up, down = np.full(size, _STEP), np.full(size, U(pow(int(_STEP), -1, 2**64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers stirred, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a stretch of texts.

    raw, data: bytes as they are and lower-cased; starts, ends: of each word in them; hashes: 64 bits of each word;
    first: index of each text's first word, with the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data]
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = word_bytes[self.data]
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        cut = offsets[:-1][offsets[:-1] < n]
        begins[cut] = inside[cut]
        self.starts = np.flatnonzero(begins)
        stops = inside[:n] & ~inside[1:]
        before = offsets[1:][offsets[1:] > 0] - 1
        stops[before] = inside[before]
        self.ends = np.flatnonzero(stops) + 1
        up, down = _power(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data] * up, out=sums[1:])
        length = (self.ends - self.starts).astype(U)
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + length * _STEP)
        self.first = np.searchsorted(self.starts, offsets)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each k consecutive words."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mixed(out + U(k))


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in portions of at most ``rows``, which bounds what a task holds at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def stretches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for stretches of the texts of an Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
