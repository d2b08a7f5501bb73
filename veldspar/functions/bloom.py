"""Bloom filters: plain and counting, built per partition and merged."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bloom:
    """m = ceil(-n ln p / ln(2)^2) bits, k = ceil(m / n ln 2) hashes."""

    def __init__(self, expected: int, rate: float = 0.01, cells: np.ndarray | None = None):
        self.expected, self.rate = max(1, expected), rate
        self.m = max(1, math.ceil(-self.expected * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, math.ceil(self.m / self.expected * math.log(2)))
        self.cells = np.zeros(self.m, np.uint8) if cells is None else cells

    def _at(self, item: str | bytes) -> np.ndarray:
        raw = item.encode() if isinstance(item, str) else item
        a, b = (_signed(xxhash.xxh64_intdigest(x, 42)) % self.m for x in (raw, raw + b"\x01"))
        return np.array([(a + i * b) % self.m for i in range(self.k)])

    def positions(self, item: Column) -> Column:
        """The cells of a string or binary column, as an array: the same ones as for a value here."""
        raw = item.cast("binary")
        a, b = (F.pmod(F.xxhash64(x), F.lit(self.m)) for x in (raw, F.concat(raw, F.lit(b"\x01"))))
        return F.array(*[F.pmod(a + i * b, F.lit(self.m)) for i in range(self.k)])

    def has(self, item: Column) -> Column:
        """Whether a column's values may be in the filter: hashes by the engine, bits looked up in Arrow batches."""
        bits = np.packbits(self.cells > 0)

        @F.pandas_udf("boolean")
        def look(at: pd.Series) -> pd.Series:
            cells = np.stack(at.to_numpy()) if len(at) else np.zeros((0, 1), np.int64)
            return pd.Series(((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(1))

        return F.when(item.isNull(), F.lit(None).cast("boolean")).otherwise(look(F.coalesce(self.positions(item), F.array(F.lit(0).cast("long")))))

    def add(self, items: Iterable[str | bytes]) -> Bloom:
        for x in items:
            self.cells[self._at(x)] = 1
        return self

    def __contains__(self, item: str | bytes) -> bool:
        return bool(self.cells[self._at(item)].all())

    def merge(self, other: Bloom) -> Bloom:
        if (self.m, self.k) != (other.m, other.k):
            raise ValueError("filters of different sizes")
        return type(self)(self.expected, self.rate, np.maximum(self.cells, other.cells))

    def to_bytes(self) -> bytes:
        return np.packbits(self.cells).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, expected: int, rate: float = 0.01) -> Bloom:
        made = cls(expected, rate)
        made.cells = np.unpackbits(np.frombuffer(raw, np.uint8))[: made.m].copy()
        return made


class CountingBloom(Bloom):
    """Cells count to 15 and stay there; a saturated cell is never lowered."""

    def add(self, items: Iterable[str | bytes]) -> CountingBloom:
        for x in items:
            at = self._at(x)
            self.cells[at] = np.minimum(self.cells[at] + 1, 15)
        return self

    def remove(self, item: str | bytes) -> bool:
        if item not in self:
            return False
        at = self._at(item)
        self.cells[at] -= ((self.cells[at] > 0) & (self.cells[at] < 15)).astype(np.uint8)
        return True


def build(df: DataFrame, column: str, expected: int, rate: float = 0.01) -> Bloom:
    """A filter over all rows but nulls: cells are hashed and gathered to bitmaps of 4 KB by the engine, of which m / 32768 come to the driver."""
    made = Bloom(expected, rate)
    cells = df.where(F.col(column).isNotNull()).select(F.explode(made.positions(F.col(column).cast("string"))).alias("cell"))
    bitmaps = cells.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    for r in bitmaps.collect():
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        made.cells[found + (r["bucket"] - 1) * 32768] = 1
    return made


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
