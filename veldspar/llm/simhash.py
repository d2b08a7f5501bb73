"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of radius + 1 bits; each non-zero vector v of that length gives a
table whose mask holds the bits with an odd inner product with v. Up to ``radius`` differing bits have vectors that
leave some v orthogonal to all of them, so the pair agrees on that table's mask: every linked pair meets in some of
the 2^(radius + 1) - 1 tables.

Only distinct fingerprints enter the tables. A bucket is compared in numpy blocks and yields a spanning forest of
its links, never all pairs. A bucket with many members is dealt out as pairs of chunks over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import annotate, drop, fresh, lower_words, spread_join, store, table
from veldspar.llm.components import components
from veldspar.llm.shingle_links import joined

CHUNK = 1024


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: each set if over half the XXH64 (seed 42) of the ``width``-word shingles have it set; no words: 0."""
    found = lower_words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - width + 1)
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    for at in range(0, n, 65536):
        hashes = np.fromiter((h(joined[i:j], 42) for i, j in zip(a[at : at + 65536], b[at : at + 65536], strict=True)), np.uint64, len(a[at : at + 65536]))
        total += _bit_sums(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


_LANE = np.uint64(0x0101010101010101)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set; eight bits at a time, up to 255 hashes a lane."""
    out = np.zeros((8, 8), np.int64)
    pad = -len(hashes) % 255
    rows = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255) if len(hashes) > 255 else hashes[None, :]
    for shift in range(8):
        lanes = ((rows >> np.uint64(shift)) & _LANE).sum(1, dtype=np.uint64)
        out[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def masks(radius: int = 3, bits: int = 64) -> list[int]:
    """One mask a table: bit i has the vector i mod (2^(radius+1) - 1) + 1."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``a`` and ``b`` (or inside ``a``), by blocks of Hamming distances."""
    whole = a if same else np.concatenate([a, b])
    parent = np.arange(len(whole))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for s in range(0, len(a), 256):
        left = a[s : s + 256]
        for t in range(s if same else 0, len(b), CHUNK):
            right = b[t : t + CHUNK]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            i, j = i + s, j + t + (0 if same else len(a))
            if same:
                i, j = i[i < j], j[i < j]
            # most pairs of a dense block are joined already: look only at those whose roots differ
            roots = np.fromiter(map(root, range(len(whole))), np.int64, len(whole)) if len(i) > len(whole) else None
            if roots is not None:
                keep = roots[i] != roots[j]
                _, one = np.unique(np.minimum(roots[i], roots[j])[keep] * len(whole) + np.maximum(roots[i], roots[j])[keep], return_index=True)
                i, j = i[keep][one], j[keep][one]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    out.append((int(whole[x]), int(whole[y])))
    return out


def links(prints: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning links of every bucket of the distinct fingerprints ``prints`` (f long): exact in components.

    Buckets of over ``chunk`` members are dealt out: members go to chunks by hash, and each pair of chunks is a
    bucket of its own, so a member is copied once for every chunk and no task holds the whole bucket.
    """
    table_masks = F.array(*[F.lit(_signed(m)) for m in masks(radius)])
    keyed = prints.select("f", F.posexplode(table_masks).alias("t", "mask")).select("f", "t", F.col("f").bitwiseAND(F.col("mask")).alias("key"))
    counts = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = store(counts, "buckets")
    large = counts.where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    members = store(keyed.join(counts, ["t", "key"]), "members")
    small = members.where(F.col("n") <= chunk).select("t", "key", F.lit(0).alias("p"), F.lit(0).alias("side"), "f")
    dealt = members.where(F.col("n") > chunk).select("t", "key", "f").join(large, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("f"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high = F.least("c", "o"), F.greatest("c", "o")
    dealt = dealt.select("t", "key", (low * F.col("k") + high + 1).alias("p"), F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"), "f")
    groups = small.unionByName(dealt).withColumn("g", F.xxhash64("t", "key", "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "t", "key", "p", "side", "f")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])) + 1
            if not len(cut):
                rest = cols
                continue
            yield from _emit([c[: cut[-1]] for c in cols], cut[:-1], radius)
            rest = [c[cut[-1] :] for c in cols]
        if rest is not None:
            yield from _emit(rest, np.zeros(0, np.int64), radius)

    dealt_out = groups.repartition("g").sortWithinPartitions("g", "t", "key", "p", "side", "f")
    return dealt_out.mapInArrow(run, "a long, b long").distinct()


def _emit(cols: list[np.ndarray], cut: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    bounds, out = [0, *cut.tolist(), len(cols[0])], []
    f, side = cols[5].view(np.uint64), cols[4]
    for x, y in zip(bounds, bounds[1:], strict=False):
        if y - x == 2 and side[x] == side[x + 1]:
            if int(f[x] ^ f[x + 1]).bit_count() <= radius:
                out.append((int(f[x]), int(f[x + 1])))
            continue
        s = side[x:y]
        one, two = f[x:y][s == 0], f[x:y][s == 1]
        out += _forest(one, two, radius, False) if len(two) else _forest(one, one, radius, True)
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])


def hexed(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fingerprint_bits`` long."""
    return annotate(docs, lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)], "fingerprint_bits long", text_col)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``: components of fingerprints linked at ``radius`` bits or fewer.

    component_id is the smallest doc_id that is reachable. Null and empty texts have fingerprint 0, linked like any
    other; null ids get a row but are nobody's component_id unless alone with their like; repeated rows get a row each;
    an empty table gives an empty result. Other columns are ignored.
    """
    marked = store(fingerprints(docs.select("doc_id", "text"), width), "fingerprints").withColumnRenamed("fingerprint_bits", "f")
    prints = store(marked.groupBy("f").agg(F.min("doc_id").alias("least")), "prints")
    own = prints.join(_roots(prints.select("f"), radius), "f", "left").withColumn("root", F.coalesce("root", "f"))
    firsts = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(own.join(firsts, "root").select("f", "component_id"), "named")
    drop(prints)
    return spread_join(marked, named, ["f"]).select("doc_id", hexed(F.col("f")).alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """(f, root) of the fingerprints that have a link."""
    return components(links(prints, radius)).withColumnRenamed("node", "f")


def with_component(docs: DataFrame, name: str, radius: int = 3, width: int = 3, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with ``name``: the least fingerprint reachable, the same for all rows of a near-duplicate group."""
    bits, f = fresh(docs, "_bits"), fresh(docs, "_f")
    marked = store(annotate(docs, lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)], f"`{bits}` long", text_col, keep_text=True), "fingerprints")
    found = store(_roots(marked.select(F.col(bits).alias("f")).distinct(), radius).select(F.col("f").alias(bits), F.col("root").alias(f)), "roots")
    out = spread_join(marked, found, [bits], "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.coalesce(f, bits).alias(name))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, radius: int = 3, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: that of its smallest doc_id.

    Groups are SimHash components, joined further by every pair of documents whose sets of ``width``-word shingles
    have a Jaccard similarity of ``percent`` % or more. Rows that share an id are documents of their own, in the order of
    their texts: those that differ stay. Rows without an id cannot be named and stay as they are; null and
    empty texts are one group; an empty table stays empty.
    """
    named, own = docs.where(F.col("doc_id").isNotNull()), fresh(docs, "_own")
    kept = _numbered(named, own)
    rows = named.withColumn(own, F.col("doc_id")) if kept is None else kept
    alike = rows.select(F.col(own).alias("doc_id"), "text")
    found = joined(alike, near_duplicates(alike, radius, width).select("doc_id", "component_id"), width, percent)
    later = store(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(own)).distinct(), "later")
    out = rows.join(later, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def _numbered(docs: DataFrame, own: str) -> DataFrame | None:
    """``docs`` sorted by ranges of (id, text) with ``own``, a number in that order, if an id comes several times; else None."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.isEmpty():
        return None
    salt = fresh(docs, "_salt")
    sorted_ = docs.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(F.col("doc_id"), F.col("text"), F.col(salt))
    return store(sorted_.sortWithinPartitions("doc_id", "text", salt).drop(salt).withColumn(own, F.monotonically_increasing_id()), "numbered")
