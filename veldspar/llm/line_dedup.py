"""Line dedup: an exact set-similarity self-join of lines.

A line is the set of its distinct words (A-Z in lower case). A later line goes if an earlier one, in the order of
(doc_id, line), has a Jaccard similarity of 0.8 or more with it; whether that one stays itself makes no difference.

1. Texts are parsed once: the word sets of lines, as hashes, are stored as column blobs, with word counts by place.
2. Each set is ordered by rarity (count, then hash: any order common to all is exact, a rare-first one is fast). The words
   of its prefix are sent with position, size, set key and a 128-bit parity signature, in which what two sets share cancels.
3. Among lines that share a prefix word, equal sets leave the earliest of them; the rest are compared in numpy blocks: size
   filter, signature's lower bound of the symmetric difference, positional filter. The closest earlier lines of
   each become candidates.
4. Candidates are verified on their whole sets. Lines that are still there although they had further candidates
   are compared with all of them in a last round, so nothing is missed.

A word so frequent that its group would be large is dealt out as pairs of chunks over several tasks; a set that many lines
share is sent once by each task, and settled by one pass over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.blobs import groups, put, runs, take
from veldspar.llm.common import drop, fresh, hashed_words, lean, slices, spread_join, store, table
from veldspar.llm.rarity import Marks, Ranks, Sums, marks, parts_for, ranks, total_of

CHUNK = 8192
NEAREST = 2
ROWS = 120_000
#: Words of all lines for each partition of prefixes, of which there are about a fifth as many.
WORDS_A_PART = 1_500_000
#: Words are told apart by so many bits of their hashes, and groups by so many of theirs (two groups in one lose nothing).
WORD_BITS = 48
_MASK = np.uint64((1 << WORD_BITS) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b with a Jaccard similarity of ``percent`` % or more."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """A set of n words can only be similar to one that shares a word among its so many first."""
    return n - -(-percent * n // 100) + 1


def smallest(percent: int) -> int:
    """A set of fewer words can only be similar to equal ones: one of n + 1 words that holds it is the closest."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


@dataclass
class Sets:
    """Word sets of the lines of some documents: the sorted hashes of line i at starts[i] up to starts[i] + size[i]."""

    doc: np.ndarray
    line: np.ndarray
    size: np.ndarray
    hashes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, in whatever order its words come."""
        if not len(self.size):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        mixed = scrambled(self.hashes)
        return np.add.reduceat(mixed, self.starts), np.bitwise_xor.reduceat(scrambled(mixed + _M1), self.starts)

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit signatures: each word turns one bit, so that two signatures differ in at most as many bits as the sets in words."""
        bit = np.uint64(1) << ((self.hashes >> np.uint64(40)) & np.uint64(63))
        high = (self.hashes >> np.uint64(46)) & np.uint64(1) == 1
        first = np.where(high, bit, np.uint64(0))
        return np.bitwise_xor.reduceat(first, self.starts), np.bitwise_xor.reduceat(bit ^ first, self.starts)

    def only(self, keep: np.ndarray) -> Sets:
        return Sets(self.doc[keep], self.line[keep], self.size[keep], self.hashes[np.repeat(keep, self.size)])


def sets_of(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners with a value, their numbers of distinct values, the distinct values by owner in order)."""
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16) if not len(owner) or owner.max() < 2**16 else owner[order], kind="stable")]
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return owner[first], np.diff(np.r_[first, len(owner)]), values


def _sets(part: pa.RecordBatch, texts: list[str | None]) -> Sets:
    """Sets of the lines with a word of rows (doc, text, at: number of the first line)."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lines = np.array([r.count(b"\n") + 1 for r in raws], np.int64)
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    starts, hashes = hashed_words(raw)
    at = np.searchsorted(np.flatnonzero(raw == 10), starts)  # the line of each word, counted through all texts
    at, size, hashes = sets_of(at, hashes & _MASK)
    row = np.repeat(np.arange(len(raws)), lines)[at]
    line = at - (np.cumsum(lines) - lines - part.column(2).to_numpy())[row]
    return Sets(part.column(0).to_numpy()[row], line, size, hashes)


_PARSED = "n long, meta binary, hashes binary, slice int, blob binary"


_KINDS = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "binary": pa.binary()}


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; workers have no session that could parse the schema."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], names=list(names))


def _narrow(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes()


def _wide(raw: pa.Buffer) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BITS // 8)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, : WORD_BITS // 8] = few
    return out.view(np.uint64).ravel()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sets (n words, meta: documents, lines and sizes; hashes), and of the task's word counts (slice, blob)."""
    sums = Sums()
    for batch in batches:
        for part, texts in slices(batch, 1, 2048, 1_000_000):
            own = _sets(part, texts)
            sums.add(own.hashes)
            rows = [(len(own.hashes), put(own.doc, own.line, own.size), _narrow(own.hashes), None, None)] if len(own.doc) else []
            yield _table(_PARSED, rows + [(None, None, None, *r) for r in sums.rows()])
    yield _table(_PARSED, [(None, None, None, *r) for r in sums.rows(True)])


def _stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
    for batch in batches:
        for meta, hashes in zip(batch.column(0), batch.column(1), strict=True):
            yield Sets(*take(meta.as_py()), _wide(hashes.as_buffer()))


def _second_pass(order: Ranks, percent: int, parts: int, asking: tuple[Marks, Marks] | None = None):
    """Blobs (b, kind, blob): kind 0, prefix words (group, side, document, line, size, position, signature, key, asks); kind 1, lines whose set the task had earlier.

    With ``asking`` (marks of words and of lines), only words that an asking line has are sent, and marked lines ask; else all do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, gone, n = {}, [], [], 0
        most = max(ROWS, min(256 * parts, 600_000))  # so that blobs stay of a useful size
        for own in _stored_sets(batches):
            if asking is not None:
                own = own.only(np.bitwise_or.reduceat(asking[0].has(own.hashes), own.starts)) if len(own.size) else own
            rows, late = _prefixes(own, order, percent, known, asking)
            if len(known) > 50_000:
                known.clear()
            held += rows
            gone += late
            n += sum(len(r[0]) for r in rows)
            if n > most:
                yield _dealt(held, gone if asking is None else [], parts)
                held, gone, n = [], [], 0
        if held or gone:
            yield _dealt(held, gone if asking is None else [], parts)

    return run


def _prefixes(own: Sets, order: Ranks, percent: int, known: dict, asking: tuple | None) -> tuple[list, list]:
    """(columns of the prefix words, (document, line) of those whose set came earlier in this task)."""
    if not len(own.size):
        return [], []
    key, _ = own.keys()
    keep = np.ones(len(key), bool)
    for i, (k, *at) in enumerate(zip(key.tolist(), own.doc.tolist(), own.line.tolist(), strict=True)):
        first = known.setdefault(k, at)
        if first is not at:
            if first < at:
                keep[i] = False
            else:
                known[k] = at
    late = [(own.doc[~keep], own.line[~keep])] if not keep.all() else []
    own, key = own.only(keep), key[keep]
    if not len(own.size):
        return [], late
    s1, s2 = own.parity()
    ask = np.ones(len(key), bool) if asking is None else asking[1].has(_line_key(own.doc, own.line))
    tiny = own.size < smallest(percent)
    out = []
    if tiny.any() and asking is None:  # similar to equal sets only: the set itself is the group
        t = np.flatnonzero(tiny)
        zero = np.zeros(len(t), np.int64)
        out.append([scrambled(key[t] ^ _M1), zero.astype(np.uint8), own.doc[t], own.line[t], own.size[t], zero, s1[t], s2[t], key[t], ask[t].astype(np.uint8)])
    if tiny.all():
        return out, late
    own, key, s1, s2, ask = own.only(~tiny), key[~tiny], s1[~tiny], s2[~tiny], ask[~tiny]
    owner = np.repeat(np.arange(len(own.size)), own.size)
    rank = order.of(own.hashes)
    code = rank.astype(np.uint64) << np.uint64(WORD_BITS) | own.hashes  # a word's place in the order of rarity
    sort = np.argsort(code)
    sort = sort[np.argsort(owner[sort].astype(np.uint16) if len(own.size) < 2**16 else owner[sort], kind="stable")]
    pos = np.arange(len(sort)) - own.starts[owner]
    sort, who, pos = (x[pos < prefix_length(own.size, percent)[owner]] for x in (sort, owner, pos))
    if asking is not None:
        sent = asking[0].has(own.hashes[sort])
        sort, who, pos = sort[sent], who[sent], pos[sent]
    k = np.maximum(1, -(-order.own(rank[sort]) // CHUNK))
    word = scrambled(code[sort])
    mine = (scrambled(key ^ _M2)[who] % k.astype(np.uint64)).astype(np.int64)  # by set, so that equal sets meet
    again = np.repeat(np.arange(len(word)), k)
    other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
    chunk = mine[again]
    pair = np.minimum(chunk, other) * k[again] + np.maximum(chunk, other)
    group = np.where(k[again] == 1, word[again], scrambled(word[again] + pair.astype(np.uint64) * _M1))
    w = who[again]
    out.append([group, (chunk > other).astype(np.uint8), own.doc[w], own.line[w], own.size[w], pos[again], s1[w], s2[w], key[w], ask[w].astype(np.uint8)])
    return out, late


_DEALT = "b int, kind byte, blob binary"


def _dealt(held: list[list[np.ndarray]], gone: list[tuple], parts: int) -> pa.RecordBatch:
    out = []
    if held:
        columns = [np.concatenate([h[i] for h in held]) for i in range(10)]
        small = np.int32 if max(c.max() for c in columns[3:6]) < 2**31 else np.int64
        columns[3:6] = [c.astype(small) for c in columns[3:6]]
        columns[0] &= _MASK
        columns[8] = columns[8].astype(np.uint32)
        order, found = runs(columns[0] % np.uint64(parts), columns[0])
        for b, s in found:
            group, *rest = (c[order[s]] for c in columns)
            out.append((b, 0, put(np.diff(group, prepend=np.uint64(0)), *rest)))
    if gone:
        doc, line = (np.concatenate([g[i] for g in gone]) for i in (0, 1))
        out.append((int(_line_key(doc[:1], line[:1])[0] % np.uint64(parts)), 1, put(doc, line)))
    return _table(_DEALT, out)


_PAIRS = "xd long, xl int, yd long, yl int, more boolean"


def _compare(percent: int, limit: int | None):
    """Candidates (x, y earlier) among the lines of each group; more: a line had over ``limit``. Without y: lines that go for sure.

    Groups of up to 64 are compared all at once, by distance in the order of sizes; larger ones in blocks of like sizes.
    """
    pairs = _Pairs(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            gone = [tuple(take(r[2])) for r in rows if r[1] == 1]
            parts = [[np.cumsum(group), *rest] for group, *rest in (take(r[2]) for r in rows if r[1] == 0)]
            del rows
            i = j = np.zeros(0, np.int64)
            c, more = [i] * 10, np.zeros(0, bool)
            if parts:
                c = [np.concatenate([p[k] for p in parts]) for k in range(10)]
                del parts
                c = _shared(c, np.argsort(c[0], kind="stable"))
                c[3:6] = [x.astype(np.int64) for x in c[3:6]]
                order = np.lexsort((c[3], c[2], c[8], c[4], c[0]))
                c = [x[order] for x in c]
                # equal sets: all but the first line go, and need no further comparison
                again = np.zeros(len(c[0]), bool)
                again[1:] = (c[0][1:] == c[0][:-1]) & (c[4][1:] == c[4][:-1]) & (c[8][1:] == c[8][:-1])
                if limit is not None:
                    gone.append((c[2][again], c[3][again]))
                c = _shared([x[~again] for x in c])
                i, j, more = pairs.all_of(c, limit)
            yield _pairs_out(c[2][i], c[3][i], c[2][j], c[3][j], more)
            if gone:
                doc, line = (np.concatenate([g[k] for g in gone]) for k in (0, 1))
                yield _pairs_out(doc, line, None, None, np.zeros(len(doc), bool))

    return run


def _pairs_out(xd, xl, yd, yl, more) -> pa.RecordBatch:
    columns = [pa.array(xd, pa.int64()), pa.array(xl.astype(np.int32)), pa.nulls(len(xd), pa.int64()) if yd is None else pa.array(yd, pa.int64()), pa.nulls(len(xd), pa.int32()) if yl is None else pa.array(yl.astype(np.int32)), pa.array(more)]
    return pa.RecordBatch.from_arrays(columns, names=["xd", "xl", "yd", "yl", "more"])


def _shared(c: list[np.ndarray], order: np.ndarray | None = None) -> list[np.ndarray]:
    """The columns in ``order``, without rows that are alone in their group; groups lie together."""
    group = c[0] if order is None else c[0][order]
    same = group[1:] == group[:-1]
    keep = np.r_[False, same] | np.r_[same, False] if len(group) else np.zeros(0, bool)
    return [x[keep] if order is None else x[order[keep]] for x in c]


@dataclass
class _Pairs:
    """Comparison of the rows of groups; columns: group, side, document, line, size, position, signature, key, asks."""

    percent: int

    def fitting(self, c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs that pass all filters, later line first, with the lower bound of their difference."""
        _, _, doc, line, n, pos, s1, s2, _, ask = c
        need = needed(n[i], n[j], self.percent)
        far = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
        fine = (far <= n[i] + n[j] - 2 * need) & (need <= np.minimum(n[i] - pos[i], n[j] - pos[j]))
        i, j, far = i[fine], j[fine], far[fine]
        later = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
        i, j = np.where(later, i, j), np.where(later, j, i)
        fine = (ask[i] > 0) & ((doc[i] != doc[j]) | (line[i] != line[j]))
        return i[fine], j[fine], far[fine]

    def all_of(self, c: list[np.ndarray], limit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(c[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        n, percent = c[4], self.percent
        first = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
        size = np.diff(np.r_[first, len(n)])
        dealt = np.add.reduceat(c[1].astype(np.int64), first) > 0
        gid, found = np.repeat(np.arange(len(first)), size), []
        small = np.flatnonzero(np.repeat((size <= 64) & ~dealt, size))
        for d in range(1, 64):  # sizes rise inside a group: once a row's partner is too large, later ones are
            small = small[small + d < len(gid)]
            small = small[(gid[small] == gid[small + d]) & (percent * n[small + d] <= 100 * n[small])]
            if not len(small):
                break
            found.append(self.fitting(c, small, small + d))
        for g in np.flatnonzero((size > 64) | dealt):
            one = two = np.arange(first[g], first[g] + size[g])
            if dealt[g]:
                one, two = one[c[1][one] == 0], two[c[1][two] == 1]
            kept = []
            for pair in self.blocks(c, one, two, dealt[g]):
                kept.append(_nearest(*self.fitting(c, *pair), c, None if limit is None else limit + 1)[:3])  # one more shows that there are more
                if len(kept) > 256:
                    kept = [_nearest(*(np.concatenate([f[k] for f in kept]) for k in range(3)), c, None if limit is None else limit + 1)[:3]]
            found += kept
        i, j, far = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        i, j, _, more = _nearest(i, j, far, c, limit)
        return i, j, more

    def blocks(self, c: list[np.ndarray], one: np.ndarray, two: np.ndarray, dealt: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose sizes and signatures fit, a block of rows against a block of like sizes at a time."""
        n, s1, s2 = c[4], c[6], c[7]
        for s in range(0, len(one), 256):
            a = one[s : s + 256]
            low = np.searchsorted(n[two], -(-self.percent * int(n[a[0]]) // 100)) if dealt else s
            high = np.searchsorted(n[two], 100 * int(n[a[-1]]) // self.percent, side="right")
            for t in range(low, high, 2048):
                b = two[t : min(t + 2048, high)]
                far = np.bitwise_count(s1[a][:, None] ^ s1[b]) + np.bitwise_count(s2[a][:, None] ^ s2[b])
                total = n[a][:, None] + n[b]
                i, j = np.nonzero(far <= total - 2 * needed(total, 0, self.percent))
                if not dealt:
                    i, j = i[i + s < j + t], j[i + s < j + t]
                yield a[i], b[j]


def _nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, c: list[np.ndarray], limit: int | None) -> tuple[np.ndarray, ...]:
    """The ``limit`` closest partners of each line, the earlier ones among equals, with a mark where there were more; all without a limit."""
    if limit is None or not len(i):
        return i, j, far, np.zeros(len(i), bool)
    order = np.lexsort((c[3][j], c[2][j], far, c[3][i], c[2][i]))
    i, j, far = i[order], j[order], far[order]
    x, y = (c[2][i], c[3][i]), (c[2][j], c[3][j])
    new = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
    # the same pair from several groups counts once
    keep = new | np.r_[True, (y[0][1:] != y[0][:-1]) | (y[1][1:] != y[1][:-1])]
    i, j, far, new = i[keep], j[keep], far[keep], new[keep]
    start = np.flatnonzero(new)
    total = np.diff(np.r_[start, len(i)])
    rank = np.arange(len(i)) - np.repeat(start, total)
    keep = rank < limit
    return i[keep], j[keep], far[keep], np.repeat(total > limit, total)[keep]


def _line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return scrambled(scrambled(doc.astype(np.uint64) * _M1) + line.astype(np.uint64))


def _line_items(batch: pa.RecordBatch) -> np.ndarray:
    return _line_key(batch.column(0).to_numpy(), batch.column(1).to_numpy())


def _word_sets(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, l, words array<long>) of the lines of ``wanted`` (d, l), which a filter of bounded size picks out before they are shuffled."""
    there = marks(wanted, _line_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stored_sets(batches):
            own = own.only(there.has(_line_key(own.doc, own.line)))
            words = pa.ListArray.from_arrays(pa.array(np.r_[own.starts, len(own.hashes)].astype(np.int32)), pa.array(own.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(own.doc), pa.array(own.line.astype(np.int32)), words], names=["d", "l", "words"])

    return parsed.mapInArrow(lean(run), "d long, l int, words array<long>").join(wanted, ["d", "l"], "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the later line of each pair whose word sets are similar; an earlier line that very many share is dealt out."""
    pairs = spread_join(pairs, sets.selectExpr("d yd", "l yl", "words yw"), ["yd", "yl"])
    both = pairs.join(sets.selectExpr("d xd", "l xl", "words xw"), ["xd", "xl"])
    common = F.size(F.array_intersect("xw", "yw"))
    return both.where(100 * common >= percent * (F.size("xw") + F.size("yw") - common)).select(F.col("xd").alias("doc"), F.col("xl").alias("line")).distinct()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, the number of each row's first line, and that column's name.

    Rows that share an id are numbered on in the order of their texts, so that (id, line) is one line of one row. Equal
    rows may take each other's numbers: their lines are the same. Only rows of such ids are moved for this, sorted by
    ranges; sums by range go ahead of those inside a range, so that no task holds all rows of an id.
    """
    at, own = fresh(docs, "_at"), fresh(docs, "_r")
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias(own))
    ids = store(ids.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own), "repeated")
    if ids.isEmpty():
        drop(ids)
        return docs.withColumn(at, F.lit(0)), at
    salt, range_, ahead = (fresh(docs, x) for x in ("_salt", "_range", "_ahead"))
    shared = docs.join(ids, F.col("doc_id") == F.col(own), "left_semi").withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    shared = store(shared.repartitionByRange(F.col("doc_id"), F.col("text"), F.col(salt)).withColumn(range_, F.spark_partition_id()), "repeated-rows")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    sums = shared.groupBy(F.col("doc_id").alias(own), F.col(range_).alias(ahead + "_r")).agg(F.sum(n).alias("n"))
    before = Window.partitionBy(own).orderBy(ahead + "_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(ahead, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("doc_id", range_).orderBy("text", salt).rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn(at, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    shared = shared.join(sums, (F.col("doc_id") == F.col(own)) & (F.col(range_) == F.col(ahead + "_r")))
    shared = shared.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(at) + F.col(ahead)).cast("int").alias(at))
    rest = docs.join(ids, F.col("doc_id") == F.col(own), "left_anti").withColumn(at, F.lit(0))
    return rest.union(shared), at


def removed_lines(docs: DataFrame, percent: int = 80, rows: tuple[DataFrame, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(removed (doc, line), (doc, n_lines)): lines, counted from 0, that go, and how many have a word, of documents with an id.

    Lines without a word never go. Rows that share an id count as one document, whose lines are ``numbered`` on from
    row to row: of equal rows the first one keeps its lines. Rows without an id are left out: they lose nothing and
    remove nothing. Null and empty texts have no lines; an empty table gives empty results.
    """
    own, at = rows or numbered(docs)
    own = own.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text", at)
    first = store(own.mapInArrow(lean(_parse), _PARSED), "parsed", "none")
    total = total_of(first, "n")
    order = ranks(first.where(F.col("slice").isNotNull()), total)
    parsed = first.where(F.col("slice").isNull()).select("meta", "hashes")
    parts = parts_for(docs, total, WORDS_A_PART)

    def candidates(limit: int | None, asking: tuple[Marks, Marks] | None = None) -> DataFrame:
        rows = parsed.mapInArrow(lean(_second_pass(order, percent, parts, asking)), _DEALT)
        return rows.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(lean(_compare(percent, limit)), _PAIRS)

    def lines_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl")).distinct()

    found = store(candidates(NEAREST), "candidates")
    equal = store(found.where("yd is null").select(F.col("xd").alias("doc"), F.col("xl").alias("line")).distinct(), "equal")
    near = found.where("yd is not null").groupBy("xd", "xl", "yd", "yl").agg(F.max("more").alias("more"))
    near = store(near.join(equal.select(F.col("doc").alias("xd"), F.col("line").alias("xl")), ["xd", "xl"], "left_anti"), "near")
    sets = store(_word_sets(parsed, lines_of(near)), "sets", "none")
    gone = store(_verified(near.drop("more"), sets, percent).union(equal), "gone")
    drop(found, equal)
    left = near.where("more").select(F.col("xd").alias("doc"), F.col("xl").alias("line")).distinct().join(gone, ["doc", "line"], "left_anti")
    left, rest, more = store(left, "left"), None, None
    out = gone
    if not left.isEmpty():  # the exact way for lines with further candidates: all of them
        words = sets.join(left.select(F.col("doc").alias("d"), F.col("line").alias("l")), ["d", "l"], "left_semi").select(F.explode("words").alias("w"))
        asking = (marks(words, lambda batch: batch.column(0).to_numpy().view(np.uint64)), marks(left, _line_items))
        rest = candidates(None, asking).drop("more").distinct().join(near.drop("more"), ["xd", "xl", "yd", "yl"], "left_anti")
        rest = store(rest.join(left.select(F.col("doc").alias("xd"), F.col("line").alias("xl")), ["xd", "xl"], "left_semi"), "rest")
        more = store(_word_sets(parsed, lines_of(rest)), "sets", "none")
        out = gone.union(_verified(rest, more, percent))
    removed = store(out.distinct(), "removed")
    counts = store(parsed.select("meta").mapInArrow(_line_counts, "doc long, n long").groupBy("doc").agg(F.sum("n").alias("n_lines")), "line-counts")
    drop(first, near, sets, gone, left, rest, more)
    return removed, counts


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for meta in batch.column(0):
            doc, n = np.unique(take(meta.as_py())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n)], names=["doc", "n"])


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (line numbers from 0, in order): a row for each distinct id of ``docs``.

    Lines of rows that share an id are counted together and numbered on from row to row, in the order of their texts.
    """
    removed, lines = removed_lines(docs, percent)
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc")).distinct()
    by_doc = removed.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    out = ids.join(lines, "doc", "left").join(by_doc, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with the removed lines cut out of the texts and ``n_chars``, if there, counted anew."""
    rows, at = numbered(docs)
    removed, _ = removed_lines(docs, percent, (rows, at))
    own, gone = fresh(rows, "_d"), fresh(rows, "_gone")
    by_doc = removed.groupBy(F.col("doc").alias(own)).agg(F.collect_list("line").alias(gone))
    out = rows.join(by_doc, F.col("doc_id") == F.col(own), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i + F.col(at))), "\n")
    changed = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length(kept).cast("long"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
