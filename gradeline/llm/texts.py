"""Vectorised views of text columns for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A"):ord("Z") + 1] += 32

#: An odd multiplier with an inverse modulo 2**64, and one random 64-bit value for every byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes each; a longer text stands alone."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row starts (one more entry for the end); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, width, len(column) + 1, column.offset * width.itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def lowered(octets: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _ASCII_LOWER[octets]


def word_spans(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word ``[^\\x20\\x09-\\x0D]+``."""
    solid = ~_IS_SPACE[octets]
    before = np.zeros(len(solid) + 1, bool)
    before[1:] = solid
    before[offsets] = False
    after = np.zeros(len(solid) + 1, bool)
    after[:-1] = solid
    after[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all their bits depend on all input bits."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def span_hashes(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each byte span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.full(len(octets), _BASE, np.uint64))
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[octets] * powers, out=sums[1:])
    back = np.multiply.accumulate(np.full(len(octets), _INVERSE, np.uint64))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours; the run that starts at i stands at i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k:k + n] * _PLACES[k]
    return mixed(total + np.uint64(size))


def code_points(octets: np.ndarray) -> np.ndarray:
    """Unicode code points of UTF-8 bytes."""
    return np.frombuffer(octets.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def starts_of_points(octets: np.ndarray) -> np.ndarray:
    """True for every byte that starts a code point."""
    return (octets & 0xC0) != 0x80
