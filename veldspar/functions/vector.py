"""Vector expressions over array<float|double> columns: JVM-side, no UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "dotproduct": "dot", "inner": "dot", "manhattan": "manhattan", "l1": "manhattan"}


def metric_name(name: str) -> str:
    """The metric an alias stands for; unknown names mean cosine."""
    return ALIASES.get(name.lower(), "cosine")


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _products(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _differences(a: Column, b: Column) -> Column:
    """Single-precision differences, widened."""
    return F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")).cast("double"))


def _paired(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if lengths differ, a vector is empty or has magnitude 0."""
    norms = F.sqrt(_products(a, a) * _products(b, b))
    return _paired(a, b, F.when((F.size(a) > 0) & (norms > 0), _products(a, b) / norms))


def euclidean(a: Column, b: Column) -> Column:
    return _paired(a, b, F.sqrt(_sum(F.transform(_differences(a, b), lambda d: d * d))))


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, _products(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _paired(a, b, _sum(F.transform(_differences(a, b), F.abs)))


def score_and_distance(a: Column, b: Column, metric: str) -> tuple[Column, Column]:
    name = metric_name(metric)
    if name == "cosine":
        s = cosine_similarity(a, b)
        return s, 1 - s
    if name == "dot":
        s = dot(a, b)
        return s, -s
    d = euclidean(a, b) if name == "euclidean" else manhattan(a, b)
    return 1 / (1 + d), d


def normalize(v: Column) -> Column:
    """Unit length in single precision; a zero vector stays."""
    length = F.sqrt(_products(v, v))
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v.cast("array<float>"))


def quantize(v: Column) -> Column:
    """struct(codes array<int> 0..255, low float, high float); a constant vector is all 128, an empty one empty."""
    low, high = F.array_min(v).cast("float"), F.array_max(v).cast("float")
    code = F.transform(v, lambda x: F.when(high == low, F.lit(128)).otherwise(F.round((x.cast("float") - low) / (high - low) * 255).cast("int")))
    return F.struct(code.alias("codes"), F.coalesce(low, F.lit(0).cast("float")).alias("low"), F.coalesce(high, F.lit(0).cast("float")).alias("high"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (q["low"] + (c / 255.0) * (q["high"] - q["low"])).cast("float"))
