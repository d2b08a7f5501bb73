"""The condition API: a conjunction of simple predicates.

Its null rules are its own: ``=`` and ``!=`` treat null as a value (``!=`` keeps nulls, ``= None`` finds them); ordered
comparisons drop nulls. SQL text keeps SQL's rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDERED = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None

    def expression(self) -> Column:
        col, op = F.col(self.column), self.operator.upper()
        if op == "=":
            return col.eqNullSafe(F.lit(self.value))
        if op in ("!=", "<>"):
            return ~col.eqNullSafe(F.lit(self.value))
        if op in _ORDERED:
            return _ORDERED[op](col, F.lit(self.value))
        if op in ("LIKE", "NOT LIKE"):
            found = col.like(self.value)
            return found if op == "LIKE" else ~found
        if op in ("IN", "NOT IN"):
            values = list(self.value)
            found = F.coalesce(col.isin(*[v for v in values if v is not None]), F.lit(False))
            found = found | col.isNull() if None in values else found
            return found if op == "IN" else ~found
        if op == "IS NULL":
            return col.isNull()
        if op == "IS NOT NULL":
            return col.isNotNull()
        raise ValueError(f"unknown operator {self.operator}")


def where(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    all_of = [c.expression() for c in conditions]
    return df.where(reduce(Column.__and__, all_of)) if all_of else df


def where_present(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    """The rules of filtered vector search: as ``where``, but a missing property passes IS NULL only."""
    conditions = list(conditions)
    kept = where(df, conditions)
    for c in conditions:
        if c.operator.upper() in ("=", "!=", "<>"):
            kept = kept.where(F.col(c.column).isNotNull())
    return kept
