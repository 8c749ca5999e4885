"""Hashes of words and word n-grams, computed for a whole block of texts at once.

Words are found on the UTF-8 bytes of an Arrow string column. A word's hash is a polynomial in its bytes modulo 2**64,
read off one running sum over the block, and then mixed; an n-gram's hash combines those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = bytes([0x20, *range(0x09, 0x0E)])
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_ORDERS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def byte_classes(separators: bytes = WHITE) -> np.ndarray:
    """A table of the 256 bytes: 0 for a separator, A-Z in lower case, anything else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 1
    table[list(separators)] = 0
    return table


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = np.full(size, base, dtype=np.uint64)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint64)
        if size > 4 * BLOCK_BYTES:
            return made
        have = _powers[kind] = made
    return have


def text_blocks(column, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `size` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word in order, first word of each text plus the total, byte position of each word's start)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    mapped = table[data]
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[mapped] * _power_table("up", _BASE, n)[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table("down", _INVERSE, n)[starts]
    hashes = mix(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    return hashes, np.searchsorted(starts, offsets), starts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one run of words, in order; none if it is shorter."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        total += words[j:j + m] * _ORDERS[j]
    return mix(total)


def shingle_sets(column, n: int, table: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text. A text of fewer words has its whole sequence as its only one."""
    table = byte_classes() if table is None else table
    for _, _, data, offsets in text_blocks(column):
        hashes, firsts, _ = word_hashes(data, offsets, table)
        grams = gram_hashes(hashes, n)
        for a, b in zip(firsts[:-1], firsts[1:]):
            if b - a >= n:
                found = np.sort(grams[a:b - n + 1])
                keep = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield gram_hashes(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
