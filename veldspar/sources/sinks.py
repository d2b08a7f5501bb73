"""Sinks: text table, JSON, CSV, similarity rows, and graph drawings."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS = 50, 1000


def show_table(df: DataFrame, width: int = WIDTH, rows: int = ROWS) -> str:
    """At most ``rows`` rows as text, floats with 4 places, cells cut to ``width``."""
    shown = [df.columns] + [[f"{v:.4f}" if isinstance(v, float) else "NULL" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
    shown = [[c if len(c) <= width else c[: width - 3] + "..." for c in r] for r in shown]
    sizes = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
    lines = [" | ".join(c.ljust(n) for c, n in zip(r, sizes, strict=True)).rstrip() for r in shown]
    return "\n".join([lines[0], "-+-".join("-" * n for n in sizes), *lines[1:]])


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def envelope(df: DataFrame, began: float | None = None) -> str:
    """{columns, rows, rows_affected, execution_time_ms} of a result of bounded size; a change's result has no rows but their number."""
    began = time.time() if began is None else began
    if df.columns == ["rows_affected"]:
        columns, rows, affected = [], [], df.first()[0]
    else:
        columns, affected = df.columns, 0
        rows = [list(json.loads(r["value"]).values()) for r in json_rows(df).collect()]
    return json.dumps({"columns": columns, "rows": rows, "rows_affected": affected, "execution_time_ms": int(1000 * (time.time() - began))}, ensure_ascii=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def similarity_rows(df: DataFrame) -> DataFrame:
    return df.select("rank", F.col("id").alias("node_id"), F.format_string("%.6f", "score").alias("score"), F.format_string("%.6f", "distance").alias("distance"))


def dot(edges: DataFrame) -> DataFrame:
    """One Graphviz line for each edge."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "edge_type").alias("line"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One Mermaid line for each edge, with the first 8 characters of ids."""
    return edges.select(F.format_string("    %s -->|%s| %s", F.substring("src", 1, 8), "edge_type", F.substring("dst", 1, 8)).alias("line"))


def tree(nodes: DataFrame, edges: DataFrame, roots: int = 10, depth: int = 5, most: int = 100, others: int = 20) -> str:
    """A drawing of a bounded part: the first roots without in-edges and what hangs under them, then other nodes."""
    top = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").orderBy("id").limit(roots)
    first = [(r["id"], r["label"]) for r in top.collect()]
    kids: dict[str, list[tuple[str, str]]] = {}
    found, level = {i for i, _ in first}, [i for i, _ in first]
    for _ in range(depth):  # a job for each level, for at most as many nodes as can be drawn
        if not level:
            break
        out = edges.where(F.col("src").isin(*level[:most])).join(nodes.withColumnRenamed("id", "dst"), "dst").orderBy("src", "dst").limit(most * most)
        level = []
        for r in out.select("src", "dst", "label").collect():
            kids.setdefault(r["src"], []).append((r["dst"], r["label"]))
            if r["dst"] not in found:
                found.add(r["dst"])
                level.append(r["dst"])
    lines, done = [], set()

    def below(at: str, label: str, depth_left: int) -> None:
        if at in done or len(done) >= most:
            return
        done.add(at)
        lines.append("  " * (depth - depth_left) + label)
        for kid, name in kids.get(at, []) if depth_left else []:
            below(kid, name, depth_left - 1)

    for at, label in first:
        below(at, label, depth)
    for r in nodes.orderBy("id").limit(most + others).collect():
        if r["id"] not in done and others:
            others -= 1
            lines.append(r["label"])
    return "\n".join(lines)
