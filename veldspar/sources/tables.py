"""Sources: tables, files, and the canonical nodes and edges."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Primary key of each table, for node ids "<type>:<key>".
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, by the header."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files as documents."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def id_of(kind: str, *keys: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def nodes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A typed node table: ``id``, ``type`` and the properties."""
    df = read(spark, sf_dir, kind)
    return df.select(id_of(kind, *KEYS[kind]).alias("id"), F.lit(kind).alias("type"), *df.columns)


def untyped(typed: DataFrame) -> DataFrame:
    """Canonical schemaless nodes: id, node_type, properties as variant."""
    rest = [c for c in typed.columns if c not in ("id", "type")]
    return typed.select("id", F.col("type").alias("node_type"), F.parse_json(F.to_json(F.struct(*rest))).alias("properties"))


def key_of(ref: str, df: DataFrame) -> Column | None:
    """The condition on the key columns of the typed node table ``df`` that the reference ``type:key`` asks for: it reaches the scan,
    where a computed id can't. None where the reference or the table doesn't tell; false where the key can't be one."""
    kind, *values = ref.split(":")
    names = KEYS.get(kind, ())
    kinds = dict(df.dtypes)
    if not names or len(names) != len(values) or not set(names) <= set(kinds):
        return None
    found = F.lit(True)
    for name, value in zip(names, values, strict=True):
        if kinds[name] == "string":
            found = found & (F.col(name) == value)
        elif re.fullmatch(r"-?(0|[1-9][0-9]{0,17})", value):
            found = found & (F.col(name) == int(value))
        else:
            return F.lit(False)
    return found


def keys_in(refs: Sequence[str], kind: str, names: Sequence[str], df: DataFrame) -> Column:
    """The condition that the key columns ``names`` of ``df`` are those of one of the references of type ``kind``."""
    values = [r.split(":")[1:] for r in refs if r.split(":")[0] == kind]
    values = [v for v in values if len(v) == len(names)]
    kinds = dict(df.dtypes)
    if not all(kinds[n] == "string" for n in names):
        values = [[int(x) for x in v] for v in values if all(re.fullmatch(r"-?[0-9]{1,18}", x) for x in v)]
    if not values:
        return F.lit(False)
    if len(names) == 1:
        return F.col(names[0]).isin(*[v[0] for v in values])
    found = F.lit(False)
    for v in values:
        one = F.lit(True)
        for n, x in zip(names, v, strict=True):
            one = one & (F.col(n) == x)
        found = found | one
    return found


def edges(spark: SparkSession, sf_dir: str, src: Sequence[str] | None = None, dst: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """src, dst, edge_type: in_region, in_nation (customers, suppliers), placed, next_turn.

    ``src``, ``dst`` and ``types`` keep the edges of these ends and types; they become conditions on key columns, and tables
    that have no such edge aren't read.
    """
    nation, customer, supplier, orders = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    talk = talk.alias("a").join(talk.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    talk = talk.select("a.conv_id", "a.turn", F.col("b.conv_id").alias("next_conv"), F.col("b.turn").alias("next_turn"))
    made = [
        (nation, "nation", ("n_nationkey",), "region", ("n_regionkey",), "in_region"),
        (customer, "customer", ("c_custkey",), "nation", ("c_nationkey",), "in_nation"),
        (supplier, "supplier", ("s_suppkey",), "nation", ("s_nationkey",), "in_nation"),
        (orders, "customer", ("o_custkey",), "orders", ("o_orderkey",), "placed"),
        (talk, "conversations", ("conv_id", "turn"), "conversations", ("next_conv", "next_turn"), "next_turn"),
    ]
    out = spark.createDataFrame([], "src string, dst string, edge_type string") if types is not None or src is not None or dst is not None else None
    for df, src_kind, src_keys, dst_kind, dst_keys, kind in made:
        if types is not None and kind not in types:
            continue
        for refs, end, names in ((src, src_kind, src_keys), (dst, dst_kind, dst_keys)):
            if refs is not None:
                df = df.where(keys_in(refs, end, names, df))
        one = df.select(id_of(src_kind, *src_keys).alias("src"), id_of(dst_kind, *dst_keys).alias("dst"), F.lit(kind).alias("edge_type"))
        out = one if out is None else out.union(one)
    return out


def node_ids(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """id, type of every node that the edges can touch; without ``once`` a node may come several times, and nothing is shuffled."""
    out = None
    for kind in ("region", "nation", "customer", "supplier", "orders", "conversations"):
        one = nodes(spark, sf_dir, kind).select("id", "type")
        out = one if out is None else out.union(one)
    return out.distinct() if once else out


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type of the nodes of every type."""
    out = None
    for kind in KEYS:
        one = nodes(spark, sf_dir, kind).select("id", "type")
        out = one if out is None else out.union(one)
    return out.distinct()
