"""Words, word hashes and window hashes of Arrow text columns, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps those bytes for
themselves, so byte positions are enough. Hashes are 64 bits: a window that occurs once meets
another window among n by chance with probability n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes worked on at once; one longer text is worked on alone.
SLICE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = {"bytes": 0x9E6C63D0876A9A47, "words": 0xC2B2AE3D27D4EB4F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i from 0 to n."""
    if kind not in _powers or len(_powers[kind][0]) <= n:
        size, base = max(n + 1, 1 << 18), BASE[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=U)
            a[0] = 1
            both.append(np.cumprod(a, dtype=U))
        _powers[kind] = tuple(both)
    return _powers[kind]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A hash of values[start:end] for each pair; it depends on the values and their order alone."""
    up, down = powers(kind, len(values))
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


class Words:
    """Words of the texts of one slice. doc_at[i]:doc_at[i + 1] are the words of text i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.data = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.offsets = offsets - first if len(offsets) else np.zeros(1, np.int64)
        if column.null_count:  # a null may keep bytes in the buffer
            keep = ~np.asarray(column.is_null(), dtype=bool)
            lengths = np.diff(self.offsets)
            if lengths[~keep].any():
                self.data = self.data[np.repeat(keep, lengths)]
            self.offsets = np.concatenate([[0], np.cumsum(np.where(keep, lengths, 0))])
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        gap = np.ones(n + 1, dtype=bool)
        gap[:n] = SEPARATOR[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        word = ~gap
        self.starts = np.flatnonzero(word & (np.concatenate([[True], gap[:-1]]) | cut))
        self.ends = np.flatnonzero(np.concatenate([[False], word[:-1]]) & (gap | cut))
        self.doc_at = np.searchsorted(self.starts, self.offsets)
        self.hashes = range_hashes(BYTE_VALUES[self.data], self.starts, self.ends, "bytes")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of n words within one text."""
        total = len(self.hashes)
        ends = np.repeat(self.doc_at[1:], np.diff(self.doc_at))
        at = np.flatnonzero(np.arange(total) + n <= ends)
        return at, range_hashes(self.hashes, at, at + n, "words")


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of at most ``most`` text bytes (or one row)."""
    sizes = np.nan_to_num(np.asarray(pyarrow.compute.binary_length(batch.column(text)).cast(pa.float64()).to_numpy(zero_copy_only=False)), nan=0.0)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unblob(b: bytes | None, dtype=U) -> np.ndarray:
    return np.frombuffer(b or b"", dtype=dtype)
