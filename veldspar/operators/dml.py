"""Changes as new snapshots: every function returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators.predicates import Condition


def _mask(conditions: Sequence[Condition]):
    found = F.lit(True)
    for c in conditions:
        found = found & F.coalesce(c.expression(), F.lit(False))
    return found


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, values: Mapping[str, object], conditions: Sequence[Condition] = ()) -> DataFrame:
    """Sets columns, also new ones, of rows that fit all conditions; none means every row."""
    hit = _mask(conditions)
    kinds = dict(table.dtypes)
    new = {c: F.when(hit, F.lit(v).cast(kinds[c]) if c in kinds else F.lit(v)).otherwise(F.col(c) if c in kinds else F.lit(None)) for c, v in values.items()}
    return table.withColumns(new)


def delete(table: DataFrame, conditions: Sequence[Condition] = ()) -> DataFrame:
    return table.where(~_mask(conditions))


def delete_nodes(nodes: DataFrame, edges: DataFrame, conditions: Sequence[Condition] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the fitting nodes and the edges at them."""
    gone = nodes.where(_mask(conditions)).select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(~_mask(conditions)), left.select(*edges.columns)
