"""The links that SimHash at a few bits cannot promise: documents whose sets of word shingles are similar.

Two texts with a Jaccard similarity of 0.8 differ in up to 14 of a fingerprint's 64 bits; covering tables for that
radius would be 32,767. So the near-duplicate stage takes SimHash's components as given and adds, exactly, the links
between different components:

1. One pass gives every document's set key, and shingle counts by hashed place (a table of fixed size).
   Documents with equal sets are linked to the first of them, which stands for all.
2. Each set is ordered by rarity; the shingles of its prefix are sent with position, size and a 64-bit parity
   signature. Documents that share one and lie in different components are compared by size, by position and by the
   signature's lower bound of the symmetric difference.
3. First each document's closest earlier candidate is verified on the whole sets, which joins most groups; then, with
   the components so found, every candidate pair that still lies in two components.

A shingle so frequent that its group would be large is dealt out as pairs of chunks over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.blobs import groups, put, runs, take
from veldspar.llm.common import drop, hashed_words, slices, spread_join, store
from veldspar.llm.components import components
from veldspar.llm.line_dedup import Sets, needed, prefix_length, scrambled, sets_of
from veldspar.llm.rarity import Ranks, Sums, parts_for, ranks, total_of

CHUNK = 4096
ROWS = 200_000
#: Shingles of all documents for each partition of prefixes.
SHINGLES_A_PART = 3_000_000
_M1 = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(docs: list[int], texts: list[str | None], width: int) -> Sets:
    """The distinct ``width``-word shingles of each text with a word (fewer words: the whole sequence is one)."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    starts, h = hashed_words(np.frombuffer(b"\n".join(raws), np.uint8))
    at = np.searchsorted(np.cumsum(sizes), starts, side="right")
    m = np.bincount(at, minlength=len(raws))
    ends, place = np.cumsum(m)[at], np.arange(len(at))
    begins = np.flatnonzero((place + width <= ends) | (place == (np.cumsum(m) - m)[at]))
    value = np.zeros(len(begins), np.uint64)
    for k in range(width):
        inside = begins + k < ends[begins]
        word = h[np.minimum(begins + k, max(0, len(h) - 1))]
        value = np.where(inside, scrambled((value ^ word) * _M1 + np.uint64(k + 1)), value)
    at, size, value = sets_of(at[begins], value)
    return Sets(np.array(docs, np.int64)[at], np.zeros(len(at), np.int64), size, value)


_KEYS = "k1 long, k2 long, doc long, n long, slice int, blob binary"


def _keys(width: int):
    """A row for each document with a word (n: its shingles), then the task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names = Sums(), ["k1", "k2", "doc", "n", "slice", "blob"]

        def counts(all_of: bool) -> pa.RecordBatch:
            found = sums.rows(all_of)
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(found), pa.int64()) for _ in range(4)), pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary())], names=names)

        for batch in batches:
            for part, texts in slices(batch, 1, 2048, 2_000_000):
                own = shingle_sets(part.column(0).to_pylist(), texts, width)
                k1, k2 = own.keys()
                sums.add(own.hashes)
                columns = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(own.doc), pa.array(own.size.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(k1), pa.int32()), pa.nulls(len(k1), pa.binary())], names=names)
                yield counts(False)
        yield counts(True)

    return run


def _prefixes(own: Sets, component: np.ndarray, rarity: Ranks, percent: int, chunk: int) -> list[np.ndarray]:
    """Prefix shingles: group, side, document, component, size, position, signature."""
    owner = np.repeat(np.arange(len(own.size)), own.size)
    bit = np.uint64(1) << ((own.hashes >> np.uint64(40)) % np.uint64(64))
    parity = np.bitwise_xor.reduceat(bit, own.starts) if len(bit) else np.zeros(0, np.uint64)
    rank = rarity.of(own.hashes)
    order = np.lexsort((own.hashes, rank, owner))
    pos = np.arange(len(order)) - own.starts[owner]
    chosen = pos < prefix_length(own.size, percent)[owner]
    word, often, who, pos = own.hashes[order][chosen], rarity.own(rank[order][chosen]), owner[chosen], pos[chosen]
    k = np.maximum(1, -(-often // chunk))
    mine = (scrambled(own.doc.astype(np.uint64) * _M1)[who] % k.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(word)), k)
    other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
    part = mine[again]
    pair = np.minimum(part, other) * k[again] + np.maximum(part, other)
    group = np.where(k[again] == 1, word[again], scrambled(word[again] + pair.astype(np.uint64) * _M1))
    w = who[again]
    return [group, (part > other).astype(np.uint8), own.doc[w], component[w], own.size[w], pos[again], parity[w]]


def _send(rarity: Ranks, percent: int, width: int, parts: int, chunk: int):
    def dealt(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([h[i] for h in held]) for i in range(7)]
        columns[4:6] = [c.astype(np.int32 if max(columns[4].max(), columns[5].max()) < 2**31 else np.int64) for c in columns[4:6]]
        order, found = runs(columns[0] % np.uint64(parts), columns[0])
        out = [(b, put(*(c[order[s]] for c in columns))) for b, s in found]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["b", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, max(ROWS, min(256 * parts, 1_500_000))
        for batch in batches:
            for part, texts in slices(batch, 1, 2048, 2_000_000):
                # sets of the batch's rows by row number first, so that rows of one id stay apart
                own = shingle_sets(list(range(part.num_rows)), texts, width)
                if not len(own.doc):
                    continue
                row, ids, comps = own.doc, part.column(0).to_numpy(), part.column(2).to_numpy()
                own.doc = ids[row]
                held.append(_prefixes(own, comps[row], rarity, percent, chunk))
                n += len(held[-1][0])
                if n > most:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    return run


def _closest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((y, far, x))
    order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
    return x[order], y[order], far[order]


def _distinct(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((y, x))
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]] if len(order) else order
    return x[order], y[order], far[order]


def _compare(percent: int, closest: bool):
    """Candidates (x, y earlier, far) of different components among the documents of each group; ``closest``: one for each x."""
    cut = _closest if closest else _distinct

    def near(c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        _, _, doc, comp, n, pos, sig = c
        fine = comp[i] != comp[j]
        i, j = i[fine], j[fine]
        need = needed(n[i], n[j], percent)
        far = np.bitwise_count(sig[i] ^ sig[j]).astype(np.int64)
        fine = (need <= np.minimum(n[i] - pos[i], n[j] - pos[j])) & (far <= n[i] + n[j] - 2 * need) & (doc[i] != doc[j])
        i, j = i[fine], j[fine]
        return np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j]), far[fine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            parts = [take(r[1]) for r in rows]
            c = [np.concatenate([p[i] for p in parts]) for i in range(7)]
            del parts, rows
            order = np.argsort(c[0], kind="stable")
            c = [x[order] for x in c]
            first = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
            size = np.diff(np.r_[first, len(order)])
            keep = np.repeat(size > 1, size)  # most shingles of a prefix are in one document only
            c = [x[keep] for x in c]
            size = size[size > 1]
            first = np.cumsum(size) - size
            c[4:6] = [x.astype(np.int64) for x in c[4:6]]
            dealt = np.add.reduceat(c[1].astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
            gid, found = np.repeat(np.arange(len(first)), size), [(np.zeros(0, np.int64),) * 3]
            small = np.flatnonzero(np.repeat((size <= 64) & ~dealt, size))
            for d in range(1, 64):
                small = small[small + d < len(gid)]
                small = small[gid[small] == gid[small + d]]
                if not len(small):
                    break
                found.append(near(c, small, small + d))
            for g in np.flatnonzero((size > 64) | dealt):
                one = two = np.arange(first[g], first[g] + size[g])
                if dealt[g]:
                    one, two = one[c[1][one] == 0], two[c[1][two] == 1]
                for s in range(0, len(one), 256):
                    for t in range(0 if dealt[g] else s, len(two), 2048):
                        i, j = (a.ravel() for a in np.meshgrid(one[s : s + 256], two[t : t + 2048], indexing="ij"))
                        if not dealt[g]:
                            i, j = i[i < j], j[i < j]
                        found.append(cut(*near(c, i, j)))
                        if len(found) > 64:
                            found = [cut(*(np.concatenate([f[k] for f in found]) for k in range(3)))]
            x, y, far = cut(*(np.concatenate([f[k] for f in found]) for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(far)], names=["x", "y", "far"])

    return run


def _verified(pairs: DataFrame, own: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): the pairs whose whole sets are similar; a document has a set for each of its rows."""
    wanted = pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1, 2048, 2_000_000):
                s = shingle_sets(list(range(part.num_rows)), texts, width)
                found = pa.ListArray.from_arrays(pa.array(np.r_[s.starts, len(s.hashes)].astype(np.int32)), pa.array(s.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[s.doc]), found], names=["doc", "words"])

    sets = store(own.select("doc", "text").join(wanted, "doc", "left_semi").mapInArrow(run, "doc long, words array<long>"), "shingles", "none")
    both = spread_join(pairs, sets.selectExpr("doc y", "words yw"), ["y"]).join(sets.selectExpr("doc x", "words xw"), "x")
    common = F.size(F.array_intersect("xw", "yw"))
    both = both.where(100 * common >= percent * (F.size("xw") + F.size("yw") - common)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = store(both, "similar")
    drop(sets)
    return found


def joined(docs: DataFrame, found: DataFrame, width: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, component_id) of the documents that are in a group: ``found`` (doc_id, component_id), extended by every link
    between documents whose sets of ``width``-word shingles (A-Z in lower case) have a Jaccard similarity of ``percent`` % or more.

    component_id is the smallest doc_id that is reachable; documents alone in their group may be missing. Rows that share
    an id count as one document that has the links of each row. Rows without an id, and null and empty texts, have
    no links of their own; an empty table gives an empty result.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    first = store(texts.mapInArrow(_keys(width), _KEYS), "shingle-keys")
    keys = first.where(F.col("slice").isNull()).select("k1", "k2", "doc", "n")
    total = total_of(first, "n")
    rarity = ranks(first.where(F.col("slice").isNotNull()), total)
    equal = store(keys.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "shingle-classes")
    same = spread_join(keys.drop("n"), equal.where("n > 1").drop("n"), ["k1", "k2"]).select(F.col("doc").alias("a"), F.col("least").alias("b"))
    known = found.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("a"), F.col("component_id").cast("long").alias("b"))
    links = store(known.union(same).where("a <> b").distinct(), "known-links")
    own = store(texts.join(equal.select(F.col("least").alias("doc")).distinct(), "doc", "left_semi"), "shingle-texts")
    drop(first, equal)
    parts = parts_for(docs, total, SHINGLES_A_PART)
    for closest in (True, False):
        now = components(links).select(F.col("node").alias("doc"), F.col("root").alias("component"))
        rows = own.join(now, "doc", "left").select("doc", "text", F.coalesce("component", "doc").alias("component"))
        sent = rows.mapInArrow(_send(rarity, percent, width, parts, chunk), "b int, blob binary")
        pairs = sent.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_compare(percent, closest), "x long, y long, far long")
        pairs = store(pairs.groupBy("x").agg(F.min_by("y", F.struct("far", "y")).alias("y")) if closest else pairs.select("x", "y").distinct(), "pairs")
        similar, before = _verified(pairs, own, percent, width), links
        links = store(before.union(similar).distinct(), "links")
        drop(pairs, similar, before)
    drop(own)
    return components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
