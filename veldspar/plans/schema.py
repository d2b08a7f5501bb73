"""Schemas of node types: field language, validation, relations and migrations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of field types, their SQL names, and Spark types.
NAMES = {
    "string": "string text varchar", "int": "int integer bigint i64", "float": "float double decimal f64", "bool": "bool boolean",
    "datetime": "datetime timestamp date", "json": "json jsonb object", "bytes": "bytes binary blob", "uuid": "uuid id",
}
SQL = {
    "string": "TEXT", "int": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "json": "JSONB", "bytes": "BYTEA",
    "uuid": "UUID", "enum": "TEXT", "array": "JSONB", "reference": "UUID",
}
SPARK = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType(), "json": T.StringType(), "bytes": T.BinaryType(), "uuid": T.StringType(), "enum": T.StringType(), "reference": T.StringType()}


@dataclass(frozen=True)
class FieldType:
    kind: str
    values: tuple[str, ...] = ()
    inner: FieldType | None = None

    @classmethod
    def parse(cls, text: str) -> FieldType:
        """Unknown names are strings; enum(a, b), array<t> and ref:type take what they hold."""
        low = text.strip().lower()
        if m := re.fullmatch(r"enum\((.*)\)", text.strip(), re.I | re.S):
            return cls("enum", tuple(v.strip() for v in m[1].split(",")))
        if m := re.fullmatch(r"array<(.*)>", text.strip(), re.I | re.S):
            return cls("array", inner=cls.parse(m[1]))
        if low.startswith(("ref:", "reference:")):
            return cls("reference", (text.strip().split(":")[1],))
        return cls(next((k for k, names in NAMES.items() if low in names.split()), "string"))

    def sql(self) -> str:
        return SQL[self.kind]

    def spark(self) -> T.DataType:
        return T.ArrayType(self.inner.spark()) if self.kind == "array" else SPARK[self.kind]


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    nullable: bool = True
    unique: bool = False
    indexed: bool = False
    default: object = None
    description: str = ""


def fields(text: str) -> tuple[Field, ...]:
    """``name:type:modifier, ...``; commas inside brackets and the colon of ref: stay with their type."""
    out = []
    for part in re.split(r",(?![^(<]*[)>])", text):
        bits = [b.strip() for b in part.strip().split(":")]
        if not bits[0]:
            continue
        if len(bits) > 2 and bits[1].lower() in ("ref", "reference"):
            bits[1:3] = [":".join(bits[1:3])]
        marks = {b.lower() for b in bits[2:]}
        out.append(Field(bits[0], FieldType.parse(bits[1]) if len(bits) > 1 else FieldType("string"), not marks & {"required", "notnull"}, "unique" in marks, bool(marks & {"indexed", "index", "unique"})))
    return tuple(out)


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    version: int = 1

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark(), f.nullable) for f in self.fields])

    def sql(self) -> str:
        rows = ["id UUID PRIMARY KEY", *(f"{f.name} {f.type.sql()}" + " NOT NULL" * (not f.nullable) + " UNIQUE" * f.unique for f in self.fields)]
        return f"CREATE TABLE {self.name} ({', '.join(rows)})"

    def problems(self, df: DataFrame) -> DataFrame:
        """``df`` with ``problem``: what is wrong with a row (missing required fields, values outside an enum), for rows where something is."""
        found: list[Column] = []
        for f in self.fields:
            there = f.name in df.columns
            if not f.nullable:
                found.append(F.when(F.col(f.name).isNull() if there else F.lit(True), F.lit(f"missing {f.name}")))
            if there and f.type.kind == "enum":
                found.append(F.when(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.type.values), F.lit(f"{f.name} outside its values")))
            if there and f.type.kind in ("int", "float", "bool", "datetime") and dict(df.dtypes)[f.name] == "string":
                found.append(F.when(F.col(f.name).isNotNull() & F.expr(f"try_cast(`{f.name}` as {f.type.spark().simpleString()})").isNull(), F.lit(f"{f.name} is no {f.type.kind}")))
        return df.withColumn("problem", F.coalesce(*found) if found else F.lit(None).cast("string")).where("problem is not null")


@dataclass(frozen=True)
class Relation:
    kind: str
    source: str
    target: str

    @property
    def edge_type(self) -> str:
        return f"{self.source}_{self.target}"


@dataclass
class Registry:
    schemas: dict[str, Schema] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)

    def create(self, name: str, text: str) -> Schema:
        if name in self.schemas:
            raise ValueError(f"{name} exists")
        self.schemas[name] = Schema(name, fields(text))
        return self.schemas[name]

    def link(self, source: str, target: str, kind: str) -> Relation:
        if kind not in ("has_one", "has_many", "belongs_to", "many_to_many"):
            raise ValueError(f"unknown relation {kind}")
        self.relations.append(Relation(kind, source, target))
        return self.relations[-1]

    def drop(self, name: str, force: bool = False) -> None:
        if not force and any(name in (r.source, r.target) for r in self.relations):
            raise ValueError(f"{name} is linked")
        self.schemas.pop(name)

    def migrate(self, new: Schema) -> list[str]:
        old = self.schemas[new.name]
        steps = migration(old, new)
        self.schemas[new.name] = replace(new, version=old.version + 1)
        return steps


def migration(old: Schema, new: Schema) -> list[str]:
    """SQL statements from the old schema to the new one."""
    steps = [f"ALTER TABLE {old.name} RENAME TO {new.name}"] if old.name != new.name else []
    was, now = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    for f in new.fields:
        if f.name not in was:
            steps.append(f"ALTER TABLE {new.name} ADD COLUMN {f.name} {f.type.sql()}" + " NOT NULL" * (not f.nullable) + (f" DEFAULT {f.default}" if f.default is not None else ""))
        elif was[f.name].type != f.type:
            steps.append(f"ALTER TABLE {new.name} ALTER COLUMN {f.name} TYPE {f.type.sql()}")
    steps += [f"ALTER TABLE {new.name} DROP COLUMN {n}" for n in was if n not in now]
    for f in new.fields:
        if f.indexed and not (f.name in was and was[f.name].indexed):
            steps.append(f"CREATE {'UNIQUE ' * f.unique}INDEX {new.name}_{f.name}_idx ON {new.name} ({f.name})")
    steps += [f"DROP INDEX IF EXISTS {new.name}_{f.name}_idx" for f in old.fields if f.indexed and f.name in now and not now[f.name].indexed]
    return steps


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` cast to the schema's types, missing columns null."""
    return reduce(lambda d, f: d.withColumn(f.name, (F.col(f.name) if f.name in d.columns else F.lit(f.default)).cast(f.type.spark())), schema.fields, df)
