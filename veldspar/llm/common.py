"""What several operators of this subpackage share: words, hashes, shared tables, clash-free columns."""

from __future__ import annotations

import collections
import contextlib
import ctypes
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a folder of the warehouse, or of /tmp in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    return found.rstrip("/")


#: While a table is written: shuffle files of the job go when it ends, and workers get texts and blobs in small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_LOCK, _WRITERS, _BEFORE = threading.Lock(), collections.Counter(), {}


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The session's values for writing: the first of several threads sets them, the last one resets them."""
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        _WRITERS[session] += 1
        if _WRITERS[session] == 1:
            _BEFORE[session] = {k: spark.conf.get(k, None) for k in _WRITING}
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[session] -= 1
            if not _WRITERS[session]:
                for k, v in _BEFORE.pop(session).items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: this cuts lineage and survives lost executors.

    What is written is not shuffled again, so the job's shuffle files go when it ends. ``drop`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def drop(*stored: DataFrame | None) -> None:
    """Deletes tables that ``store`` wrote, once whatever was made of them is stored itself."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = 10_000, least: int = 65_536) -> DataFrame:
    """``big.join(small, keys, how)`` with the rows of hot keys dealt out over several tasks.

    Hot keys hold over 1 / ``most`` of the rows of ``big`` and over ``least`` rows, so there are at most ``most`` of them: they
    are broadcast, and their rows of ``small`` repeated once for each share. ``big`` is read twice: give a stored table.
    """
    total = big.count()
    share = max(least, total // most)
    if total <= share:
        return big.join(small, keys, how)
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    hot = store(hot.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_k")), "hot-keys")
    if hot.isEmpty():
        drop(hot)
        return big.join(small, keys, how)
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_k")).cast("int"), F.lit(0))).drop("_k")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1))).drop("_k")
    return left.join(right, [*keys, "_s"], how).drop("_s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int = 5) -> Column:
    """crc32 of the key's text, modulo ``modulus``; a null key counts as remainder 0 (held out of op1 and op6)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus), F.lit(0)).cast("int")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes; bytes.split() parts exactly at x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As ``words`` with A-Z in lower case; bytes.lower() leaves every other letter alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BLOCK = 1 << 17


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(2 * _BLOCK - 1, x)]) for x in (_STEP, _BACK))


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word in the bytes ``raw``, A-Z in lower case: sums of byte values times powers by place, stirred."""
    starts, h, _ = hashed_parts(raw, _WHITE)
    return starts, h


def hashed_parts(raw: np.ndarray, white: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(start, hash) of each word between the bytes that ``white`` marks; and for each of ``lengths``, which words are as long, with the hashes of so many first bytes.

    Running sums over blocks, of which a word takes the difference at its ends, scaled back by the power of its start.
    """
    inside = ~white[raw]
    turn = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = turn[::2], turn[1::2]
    h, heads = np.empty(len(starts), np.uint64), [np.zeros(len(starts), np.uint64) for _ in lengths]
    power, back = _powers()
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(raw), _BLOCK)), len(starts)])
    for i, j in zip(cuts, cuts[1:], strict=False):
        low, high = starts[i], ends[j - 1]
        if high - low > len(power):  # a very long word ends the block
            power_of, back_of = (np.cumprod(np.r_[np.uint64(1), np.full(high - low - 1, x)]) for x in (_STEP, _BACK))
        else:
            power_of, back_of = power, back
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw[low:high]] * power_of[: high - low], out=total[1:])
        first, scale = total[starts[i:j] - low], back_of[starts[i:j] - low]
        h[i:j] = (total[ends[i:j] - low] - first) * scale
        for n, head in zip(lengths, heads, strict=True):
            head[i:j] = (total[np.minimum(starts[i:j] + n, ends[i:j]) - low] - first) * scale
    size = ends - starts
    stirred = [_stirred(h, size), *(_stirred(head, n << 32) for n, head in zip(lengths, heads, strict=True))]
    return starts, stirred[0], [(np.flatnonzero(size >= n), head[size >= n]) for n, head in zip(lengths, stirred[1:], strict=True)]


def _stirred(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(salt).astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def slices(batch: pa.RecordBatch, text: int, most_rows: int = 2048, most_chars: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts an Arrow batch so that each piece has few characters (one text alone may have more)."""
    start = chars = 0
    found: list[str | None] = []
    for i in range(batch.num_rows):
        value = batch.column(text)[i].as_py()
        n = len(value) if value else 0
        if found and (len(found) >= most_rows or chars + n > most_chars):
            yield batch.slice(start, i - start), found
            start, chars, found = i, 0, []
        chars += n
        found.append(value)
    if found:
        yield batch.slice(start), found


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker, which lives on, gives its free memory back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def annotate(docs: DataFrame, fn: Callable[[list[str | None]], list], fields: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds ``fields`` (DDL), which ``fn`` makes from a list of whole texts; other columns pass through as Arrow, nulls and all.

    Without ``keep_text`` the text column goes. Input columns of the names in ``fields`` are replaced.
    If ``fields`` ends in ``_keep boolean``, rows where it is false go, and the column with them.
    """
    made = T.StructType.fromDDL(fields)
    names = set(made.names)
    chosen = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names - {text_col}])
    text = chosen.columns.index(text_col)
    choose = made.names[-1] == "_keep"
    kept = [f for f in chosen.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(kept + [f for f in made.fields if f.name != "_keep"])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    kinds = list(to_arrow_schema(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                columns = [c for i, c in enumerate(part.columns) if keep_text or i != text]
                new = [v if isinstance(v, pa.Array) else pa.array(v, k.type, from_pandas=False) for v, k in zip(fn(texts), kinds, strict=True)]
                mask = new.pop() if choose else None
                out = pa.RecordBatch.from_arrays([*columns, *new], schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, [*columns, *new], strict=True)]))
                yield out.filter(mask) if choose else out

    return chosen.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``each`` training rows of either label, the first ids by hash: a bounded sample.

    Training rows are those whose crc32 remainder modulo 5 is not 0. Null ids, labels and texts are left out;
    an id labelled twice counts once, with its larger label; of several rows of an id the one with the least text (by
    its 64-bit hash, then itself) counts.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col) != 0)).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    known = docs.where(F.col(text_col).isNotNull()).select(id_col).distinct()
    one = store(one.join(known, id_col, "left_semi"), "labels")
    parts = [one.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(each) for y in (0, 1)]
    chosen = spark.createDataFrame([tuple(r) for p in parts for r in p.collect()], one.schema)  # 2 * each short rows at most
    drop(one)
    return one_of_each(docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col).where(F.col(text_col).isNotNull()), id_col, text_col)


def one_of_each(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` (id, text and columns that follow from the id) with one row of each id: that of the least text by hash, then itself.

    A grouped minimum, combined before the shuffle: an id that is repeated a thousand times sends one text a task.
    """
    rest = [c for c in rows.columns if c not in (id_col, text_col)]
    least = F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")))
    return rows.groupBy(id_col, *rest).agg(least.alias("_least")).select(F.col(id_col), F.col("_least.t").alias(text_col), *rest)
