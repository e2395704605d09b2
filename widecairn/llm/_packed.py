"""Arrays as compressed bytes, for rows that carry many numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> bytes:
    """Compressed: the first bytes of all numbers, then the second and so on."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    plain = pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 numbers by their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def part_bounds(keys: np.ndarray, parts: int) -> list[int]:
    """Where each of ``parts`` equal ranges of 64-bit numbers begins in the ascending keys, and the end."""
    return [0, *np.searchsorted(keys, np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)).tolist(), len(keys)]
