"""Texts as byte arrays inside tasks: word and line boundaries, and hashes of spans, for whole Arrow batches at once.

Everything here works on one slice of rows at a time (SLICE_BYTES of text, or a single row where that is longer), so
memory follows the longest text and not the partition. Span hashes are polynomials modulo 2**64 over mixed values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_WHITE = np.array([x not in WHITE for x in range(256)])
ALNUM = np.array([x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A for x in range(256)])
LOWER = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and where each row begins; null counts as empty."""
    wide = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cut record batches into slices of about `most` bytes of the column, never inside a row."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(array) else []
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of True that stay inside one row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge |= cut
    return np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hash of values[s:e] for many spans from one prefix sum."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
        self.base = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """values are 64-bit words, already well mixed."""
        n = len(values)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of(self.table[data], starts, ends)


def gram_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i:i+k] for every i (also across rows: callers mask)."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j: j + n]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (one longer than data)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
