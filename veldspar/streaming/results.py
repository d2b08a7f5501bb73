"""Results in batches, and node tables as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


class ResultStream:
    """Rows of a result one by one or in batches; a partition at a time is held."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator[Row]:
        return self._rows

    def next(self) -> Row | None:
        return next(self._rows, None)

    def batches(self, size: int) -> Iterator[list[Row]]:
        now: list[Row] = []
        for r in self._rows:
            now.append(r)
            if len(now) == size:
                yield now
                now = []
        if now:
            yield now

    def collect(self, most: int) -> list[Row]:
        return [r for _, r in zip(range(most), self._rows, strict=False)]


def node_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Nodes that arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to a Parquet table, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
