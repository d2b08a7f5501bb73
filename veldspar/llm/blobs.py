"""Columns as compressed blobs, for rows that are many and small: a blob for each task and partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def put(*arrays: np.ndarray) -> bytes:
    """Columns as one blob: bytes of one significance together, so that small numbers cost what they hold."""
    out = []
    for a in arrays:
        flat = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        packed = pa.compress(flat.tobytes(), codec="zstd", asbytes=True) if len(a) else b""
        out.append(a.dtype.char.encode() + len(a).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed)
    return b"".join(out)


def take(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = np.dtype(blob[at : at + 1].decode()), int.from_bytes(blob[at + 1 : at + 9], "little"), int.from_bytes(blob[at + 9 : at + 17], "little")
        at += 17
        raw = pa.decompress(blob[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def runs(part: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """The order by partition and history, and (partition, slice) of that order."""
    order = np.lexsort((h, part))
    edges = np.flatnonzero(np.diff(part[order])) + 1
    bounds = [0, *edges.tolist(), len(order)] if len(order) else [0]
    return order, ((int(part[order[a]]), slice(a, b)) for a, b in zip(bounds, bounds[1:], strict=False))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal first column together; rows come sorted by it."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[0] != now and rows:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows
