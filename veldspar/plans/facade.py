"""A database-like object over DataFrames. Changes replace its snapshots; nothing is written until ``save``."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators import dml, fulltext, graph, relational, stats, vectors
from veldspar.operators.predicates import Condition
from veldspar.plans import schema, statements
from veldspar.sources import sinks

#: Changes of a type after which its snapshot is written.
SETTLE = 40
EDGES = "id string, src string, dst string, edge_type string"
ID = "id"


def _type(saved: dict | None) -> schema.FieldType | None:
    return saved and schema.FieldType(saved["kind"], tuple(saved["values"]), _type(saved["inner"]))


class Database:
    def __init__(self, spark: SparkSession, name: str = "db"):
        self.spark, self.name, self.schema = spark, name, schema.Registry()
        self.types: dict[str, DataFrame] = {}
        self.edges = spark.createDataFrame([], EDGES)
        self.indexes: set[tuple[str, str]] = set()
        self.fulltext: set[tuple[str, str]] = set()
        self._stored: dict[tuple[str, str], fulltext.StoredIndex] = {}
        self._changes: dict[str, int] = {}

    # tables
    def register(self, kind: str, df: DataFrame) -> None:
        """A typed node table with ``id``; it is a view of its type's name as well. Stored indexes of the type are built anew when next used."""
        df = df if "type" in df.columns else df.withColumn("type", F.lit(kind))
        self.types[kind] = df
        for key in [k for k in self._stored if k[0] == kind]:
            del self._stored[key]
        df.createOrReplaceTempView(kind)

    def _changed(self, kind: str, df: DataFrame) -> None:
        """A new snapshot; after some changes it is written, so that plans don't grow with their number."""
        self._changes[kind] = self._changes.get(kind, 0) + 1
        self.register(kind, graph.kept(df, "snapshot") if self._changes[kind] % SETTLE == 0 else df)

    def _changed_edges(self, edges: DataFrame) -> None:
        self._changes[""] = self._changes.get("", 0) + 1
        self.edges = graph.kept(edges, "edges") if self._changes[""] % SETTLE == 0 else edges

    def register_edges(self, edges: DataFrame) -> None:
        """Edges with src, dst, edge_type and any properties."""
        self.edges = edges if ID in edges.columns else edges.withColumn(ID, F.expr("uuid()"))

    def save(self, path: str) -> None:
        """Node tables, edges, and the name, types, schemas and indexes as one row of JSON."""
        for kind, df in self.types.items():
            df.write.mode("overwrite").parquet(f"{path}/nodes/{kind}")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        schemas = [asdict(x) for x in self.schema.schemas.values()]
        links = [[r.kind, r.source, r.target] for r in self.schema.relations]
        about = {"name": self.name, "types": sorted(self.types), "indexes": sorted(self.indexes), "fulltext": sorted(self.fulltext), "schemas": schemas, "relations": links}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def open(cls, spark: SparkSession, path: str, kinds: Iterable[str] | None = None, name: str | None = None) -> Database:
        """What ``save`` wrote; ``kinds`` keeps some of the types."""
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        made = cls(spark, name or about["name"])
        for kind in about["types"] if kinds is None else kinds:
            made.register(kind, spark.read.parquet(f"{path}/nodes/{kind}"))
        made.edges = spark.read.parquet(f"{path}/edges")
        made.indexes, made.fulltext = ({tuple(x) for x in about[n] if x[0] in made.types} for n in ("indexes", "fulltext"))
        for x in about["schemas"]:
            made.schema.schemas[x["name"]] = schema.Schema(x["name"], tuple(schema.Field(**{**f, "type": _type(f["type"])}) for f in x["fields"]), x["version"])
        for kind, source, target in about["relations"]:
            made.schema.link(source, target, kind)
        return made

    @property
    def nodes(self) -> DataFrame:
        """id, type of all nodes."""
        out = self.spark.createDataFrame([], "id string, type string")
        for df in self.types.values():
            out = out.unionByName(df.select("id", "type"))
        return out

    # rows
    def insert(self, kind: str, properties: Mapping[str, object] | str) -> str:
        """Properties as a mapping, or as the text of a JSON object; other JSON values are kept as ``value``."""
        found = json.loads(properties) if isinstance(properties, str) else properties
        return self.insert_batch(kind, [found if isinstance(found, Mapping) else {"value": found}])[0]

    def insert_batch(self, kind: str, rows: Sequence[Mapping[str, object]]) -> list[str]:
        ids = [str(uuid.uuid4()) for _ in rows]
        if not rows:
            return ids
        frame = self.spark.createDataFrame([{"id": i, "type": kind, **r} for i, r in zip(ids, rows, strict=True)])
        self._changed(kind, dml.insert(self.types[kind], frame) if kind in self.types else frame)
        return ids

    insert_dict = insert

    def insert_with_embedding(self, kind: str, properties: Mapping[str, object], vector: Sequence[float], field: str = "embedding") -> str:
        return self.insert(kind, {**properties, field: [float(x) for x in vector]})

    def get(self, ref: str) -> dict | None:
        """The node's properties; None if there is none. A reference that can be no id is an error."""
        found = self._find(ref)
        return found[1] if found else None

    def _find(self, ref: str) -> tuple[str, dict] | None:
        for kind, df in self.types.items():
            found = relational.get(df, ref).head(1)
            if found:
                return kind, found[0].asDict()
        if not re.search(r"[:/]", ref):
            try:
                uuid.UUID(ref)
            except ValueError:
                raise ValueError(f"not an id: {ref}") from None
        return None

    get_node_with_embedding = get

    def get_by_type(self, kind: str, limit: int | None = None) -> DataFrame:
        df = self.types[kind]
        return df if limit is None else df.orderBy("id").limit(limit)

    def update(self, ref: str, values: Mapping[str, object]) -> None:
        """Sets properties of a node, also new ones; an unknown id is an error."""
        kind, found = self._find(ref) or (None, None)
        if kind is None:
            raise KeyError(ref)
        self._changed(kind, dml.update(self.types[kind], values, [Condition("id", "=", found["id"])]))

    def delete(self, ref: str) -> bool:
        """A node, and the edges at it; whether there was one."""
        kind, found = self._find(ref) or (None, None)
        if kind is None:
            return False
        nodes, edges = dml.delete_nodes(self.types[kind], self.edges, [Condition("id", "=", found["id"])])
        self._changed_edges(edges)
        self._changed(kind, nodes)
        return True

    # edges
    def create_edge(self, src: str, dst: str, edge_type: str, properties: Mapping[str, object] | None = None) -> str:
        return self.create_edges_batch([(src, dst, edge_type, properties or {})])[0]

    def create_edges_batch(self, rows: Sequence[tuple]) -> list[str]:
        """Edges from (src, dst, type) or (src, dst, type, properties); properties are columns, null where an edge has none."""
        ids = [str(uuid.uuid4()) for _ in rows]
        if not rows:
            return ids
        frame = self.spark.createDataFrame([(i, *r[:3]) for i, r in zip(ids, rows, strict=True)], EDGES)
        more = [{"id": i, **r[3]} for i, r in zip(ids, rows, strict=True) if len(r) > 3 and r[3]]
        if more:
            frame = frame.join(self.spark.createDataFrame(more), "id", "left")
        self._changed_edges(self.edges.unionByName(frame, allowMissingColumns=True))
        return ids

    def get_edge(self, ref: str) -> dict | None:
        found = self.edges.where(F.col("id") == ref).head(1)
        return found[0].asDict() if found else None

    def get_edges_from(self, ref: str, edge_type: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("src") == ref)
        return found.where(F.col("edge_type") == edge_type) if edge_type else found

    def get_edges_to(self, ref: str) -> DataFrame:
        return self.edges.where(F.col("dst") == ref)

    def get_edges_by_type(self, edge_type: str) -> DataFrame:
        return self.edges.where(F.col("edge_type") == edge_type)

    def delete_edge(self, ref: str) -> None:
        self._changed_edges(self.edges.where(F.col("id") != ref))

    # queries
    def query(self, statement: str, limit: int | None = None) -> DataFrame:
        """Own statements, changes of registered tables, or Spark SQL. ``limit`` is a further limit of the rows of Spark SQL's queries."""
        found = statements.parse(statement)
        if isinstance(found, statements.VectorSearch):
            rows = self.types[found.table]
            rows = rows.where(found.expression) if found.expression else rows
            return vectors.search(rows, found.field, found.query, found.limit, found.metric, found.conditions)
        if isinstance(found, statements.TextSearch):
            return self.fulltext_search(found.table, found.field, found.query, found.limit)
        if isinstance(found, statements.Index):
            return self._index(found)
        if isinstance(found, statements.Insert):
            return self._insert(found)
        if isinstance(found, statements.Update):
            return self._update(found)
        if isinstance(found, statements.Delete):
            return self._delete(found.table, found.where)
        out = self.spark.sql(found)
        return out if limit is None else out.limit(limit)

    def result(self, statement: str, limit: int | None = None) -> str:
        """A query's JSON envelope: columns, rows, rows_affected, execution_time_ms; for results of bounded size."""
        began = time.time()
        return sinks.envelope(self.query(statement, limit), began)

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    def _insert(self, found: statements.Insert) -> DataFrame:
        """Rows of VALUES or of a query; columns without a name are col0, col1, ..."""
        rows = self.spark.sql(f"SELECT * FROM {found.rows}" if found.literal else found.rows)
        names = found.columns or [f"col{i}" if found.literal else c for i, c in enumerate(rows.columns)]
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(names)} columns, but rows of {len(rows.columns)} values")
        rows = rows.toDF(*names)
        if found.table in self.types:
            kinds = dict(self.types[found.table].dtypes)
            rows = rows.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in names])
        if "id" not in names:
            rows = rows.withColumn("id", F.expr("uuid()"))
        rows = graph.kept(rows.withColumn("type", F.lit(found.table)), "inserted")  # written, so that ids stay what they are
        n = rows.count()
        self._changed(found.table, dml.insert(self.types[found.table], rows) if found.table in self.types else rows)
        return self._affected(n)

    def _delete(self, kind: str, text: str | None) -> DataFrame:
        df, hit = self.types[kind], F.coalesce(F.expr(text), F.lit(False)) if text else F.lit(True)
        gone = df.where(hit).select("id")
        n = gone.count()
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns)
        self._changed_edges(edges)
        self._changed(kind, df.where(~hit))
        return self._affected(n)

    def _update(self, found: statements.Update) -> DataFrame:
        """Right-hand sides are Spark SQL over the old row."""
        df, hit = self.types[found.table], F.coalesce(F.expr(found.where), F.lit(False)) if found.where else F.lit(True)
        n = df.where(hit).count()
        self._changed(found.table, df.withColumns({c: F.when(hit, F.expr(v)).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in found.changes}))
        return self._affected(n)

    def _index(self, found: statements.Index) -> DataFrame:
        key, names = (found.table, found.field), self.fulltext if found.fulltext else self.indexes
        if found.action == "DROP":
            names.discard(key)
            return self._affected(0)
        return self._affected(self._new_index(key, names))

    def _new_index(self, key: tuple[str, str], names: set) -> int:
        if key in names:
            return 0
        names.add(key)
        df = self.types[key[0]]
        return self._index_of(*key).documents() if names is self.fulltext else df.where(F.col(key[1]).isNotNull()).count()

    def _index_of(self, kind: str, field: str) -> fulltext.StoredIndex:
        if (kind, field) not in self._stored:
            self._stored[kind, field] = fulltext.StoredIndex(self.types[kind], field)
        return self._stored[kind, field]

    def create_index(self, kind: str, field: str) -> int:
        """Registers an index; lookups are filters that reach the scan, so there is nothing to keep up to date."""
        return self._new_index((kind, field), self.indexes)

    def drop_index(self, kind: str, field: str) -> None:
        self.indexes.discard((kind, field))

    def list_indexes(self) -> list[tuple[str, str]]:
        return sorted(self.indexes)

    def index_lookup(self, kind: str, field: str, value: object) -> DataFrame | None:
        return self.types[kind].where(F.col(field) == F.lit(value)) if (kind, field) in self.indexes else None

    def create_fulltext_index(self, kind: str, field: str) -> int:
        return self._new_index((kind, field), self.fulltext)

    def list_fulltext_indexes(self) -> list[tuple[str, str]]:
        return sorted(self.fulltext)

    def fulltext_search(self, kind: str, field: str, query: str, limit: int = 10) -> DataFrame:
        if (kind, field) not in self.fulltext:
            raise ValueError(f"no full-text index on {kind}({field})")
        return self._index_of(kind, field).search(query, limit)

    def similarity_search(self, vector: Sequence[float], kind: str, field: str = "embedding", k: int = 10, metric: str = "cosine") -> DataFrame:
        return vectors.search(self.types[kind], field, vector, k, metric)

    def similarity_search_radius(self, vector: Sequence[float], kind: str, most: float, field: str = "embedding", metric: str = "cosine") -> DataFrame:
        return vectors.search_radius(self.types[kind], field, vector, most, metric)

    def rebuild_vector_index(self, kind: str, field: str, dim: int) -> vectors.HyperplaneIndex:
        return vectors.HyperplaneIndex(self.types[kind], field, dim)

    # graph
    def traverse(self, start: str, max_depth: int, edge_types: Sequence[str] | None = None) -> graph.Traversal:
        return graph.traverse(self.spark, self.nodes, self.edges, [start], max_depth, edge_types)

    def shortest_path(self, start: str, end: str, max_depth: int = 10) -> list[str] | None:
        return graph.shortest_path(self.spark, self.edges, start, end, max_depth)

    def connected_components(self, kind: str | None = None) -> DataFrame:
        return graph.components(self.nodes, self.edges, kind)

    def view_kv(self, kind: str) -> DataFrame:
        return relational.key_values(self.types[kind])

    def view_graph(self, kind: str) -> DataFrame:
        return graph.graph_view(self.edges, self.types[kind])

    def status(self) -> DataFrame:
        return stats.status(self.nodes, self.edges)
