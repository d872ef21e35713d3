"""Number arrays as compressed binary values, for rows that carry many small records."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, numbers by byte planes (whose high ones are mostly zeros)."""
    head = np.array([len(arrays), *[len(a) for a in arrays], *[a.dtype.itemsize for a in arrays]], np.int64)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for size, width in zip(head[:n].tolist(), head[n:].tolist()):
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(size))
        at += size * width
    return out


def slim(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the fewest bytes that hold them all."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each length n, joined."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
