"""LM scoring: a Katz back-off bigram model with Good-Turing discounts, trained and evaluated on the whole corpus.

P(w | h) = d(c(h,w)) c(h,w) / (c(h) + 1) for a pair seen in training, else a(h) P(w); P(w) = d(c(w)) c(w) / (N + 1) for
a known word, and one unknown class has what is left. a(h) is what the seen pairs of h leave, over what their words
leave of P: both distributions sum to 1 exactly. The 1 in the denominators keeps something to back off with where
no count is low enough to be discounted.

Tables are partitioned by history. Tokens travel as compressed column blobs, a blob for each task and partition:

A. pairs with training counts by history: counts of counts, and the distinct words each partition has to know;
B. these requests by word: word counts, and the answers, stored by the partition that asked;
C. tokens by history, with the answers: pair counts, back-off weights, and sums for each document.

There are as many partitions as the input asks for. A history that a bounded sample shows as frequent is spread over several partitions by the next word (and a frequent
pair by document); its back-off weight is put together from those partitions' sums. The sample steers nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.blobs import groups, put, runs, take
from veldspar.llm.common import drop, hashed_words, lean, remainder, slices, store, table
from veldspar.llm.rarity import parts_for

START, END = 1, 2
TOP = 5
CHARS = 3_500_000
#: Tokens of the whole corpus for each partition of histories.
TOKENS_A_PART = 1_500_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * _C1 + w
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


@dataclass
class Routes:
    """Partitions of histories: ``hot`` histories (sorted) go to ``spread`` partitions each, hot pairs likewise."""

    parts: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_h: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @property
    def chars(self) -> int:
        """Characters a chunk: more where there are many partitions, so that blobs stay of a useful size."""
        return max(CHARS, min(1500 * self.parts, 4 * CHARS))

    @property
    def common(self) -> np.ndarray:
        """Words every partition has to know: hot histories and the words of hot pairs, which are hot themselves or the end."""
        return np.union1d(np.append(self.hot, np.uint64(END)), self.pair_w)

    def of(self, h: np.ndarray, w: np.ndarray, key: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        n = np.uint64(self.parts)
        to = h % n
        at, is_hot = find(self.hot, h)
        to[is_hot] += _mix(w[is_hot], h[is_hot]) % self.spread[at[is_hot]]
        if row is not None:
            at, is_hot = find(self.pairs, key)
            to[is_hot] += row[is_hot].astype(np.uint64) % self.pair_spread[at[is_hot]]
        return to % n


def find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``x`` in the sorted ``names``, and which are there."""
    if not len(names):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def discounts(counts: np.ndarray) -> np.ndarray:
    """d[0..TOP]: Good-Turing discounts of counts 1..TOP from n[1..TOP+1]; where these are unusable, absolute ones."""
    n = counts.astype(float)
    out = np.ones(TOP + 1)
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] > 0 else 0.5
    top = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - plain) / r if plain < 1 else 1 - 0.5 / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > TOP, c, c * d[np.minimum(c, TOP)])


def _tokens(batches: Iterator[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Chunks (h, w, row, train, documents (row, id, tokens)) of columns row, doc_id, text, train, of some ``chars`` characters each."""
    for batch in batches:
        for part, texts in slices(batch, 2, 1 << 20, chars):
            raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            starts, found = hashed_words(np.frombuffer(b"\n".join(raws), np.uint8))
            of = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
            n = np.bincount(of, minlength=len(raws))
            first = np.cumsum(n + 2) - (n + 2)  # each text: the start, its words, the end
            seq = np.empty(int((n + 2).sum()), np.uint64)
            seq[first], seq[first + n + 1] = START, END
            seq[np.arange(len(found)) + 2 * of + 1] = np.where(found <= np.uint64(END), found + np.uint64(END + 1), found)
            is_start, is_end = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
            is_start[first], is_end[first + n + 1] = True, True
            rows, train = part.column(0).to_numpy(), np.array(part.column(3).to_pylist(), bool)
            documents = list(zip(rows.tolist(), part.column(1).to_pylist(), (n + 1).tolist(), strict=True))
            yield seq[~is_end], seq[~is_start], np.repeat(rows, n + 1), np.repeat(train, n + 1), documents


def _short(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted histories as values and run lengths."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.diff(np.r_[first, len(h)]).astype(np.uint32)


def _pairs_out(routes: Routes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w, _, train, _ in _tokens(batches, routes.chars):
            key, first, inverse = np.unique(_mix(h, w), return_index=True, return_inverse=True)
            count = np.bincount(inverse, train, len(key)).astype(np.uint32)
            h, w = h[first], w[first]
            order, parts = runs(routes.of(h, w, key), h)
            rows = [(b, put(*_short(h[order[s]]), w[order[s]], count[order[s]])) for b, s in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["b", "blob"])

    return run


_ASK = "kind byte, wb int, b int, words binary, counts binary, n array<long>"


def _ask(routes: Routes):
    """For each partition: counts of counts of pairs, exact counts of hot pairs, and requests by the word's own partition."""
    names = ["kind", "wb", "b", "words", "counts", "n"]
    types = [pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in groups(batches):
            parts = [take(r[1]) for r in rows]
            h = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            w, c = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            del parts
            key, inverse = np.unique(_mix(h, w), return_inverse=True)
            total = np.bincount(inverse, c, len(key)).astype(np.int64)
            n = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
            at, hot = find(routes.pairs, key)
            words, inverse = np.unique(np.concatenate([w, routes.common]), return_inverse=True)
            count = np.bincount(inverse[: len(w)], c, len(words)).astype(np.uint32)
            order, to = runs(words % np.uint64(routes.parts), words)
            out = [(0, wb, b, put(words[order[s]]), put(count[order[s]]), None) for wb, s in to]
            out.append((1, None, b, put(routes.pairs[at[hot]]), put(total[hot]), n.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _answer(routes: Routes):
    """For each partition of words (wb, b, words, counts): the summed counts for each one that asked; then those of common words, counts of counts, N and V."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            asked = [take(r[2])[0] for r in rows]
            words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([take(r[3])[0] for r in rows]), len(words)).astype(np.int64)
            n = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3).tolist()
            ends, out = np.cumsum([len(a) for a in asked]), []
            for r, a, end in zip(rows, asked, ends, strict=True):
                out.append((r[1], put(a), put(total[inverse[end - len(a) : end]]), None))
            common = find(routes.common, words)[1]
            out.append((None, put(words[common]), put(total[common]), [*n, int(total.sum()), int((total > 0).sum())]))
            types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["b", "words", "counts", "n"])

    return run


def _tokens_out(routes: Routes):
    """Rows (b, kind 1, blob, first row) of tokens, and (b, kind 2) of the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w, row, train, documents in _tokens(batches, routes.chars):
            base = int(row.min())
            part = routes.of(h, w, _mix(h, w), row)
            mark = ((row - base) << 1 | train).astype(np.uint64)
            order, parts = runs(part, h)
            out = []
            for b, s in parts:
                o = order[s]
                names, index = np.unique(w[o], return_inverse=True)
                out.append((b, 1, put(*_short(h[o]), names, index.astype(np.uint32), mark[o]), base))
            ids = np.array([d[1] if d[1] is not None else 0 for d in documents], np.int64)
            null = np.array([d[1] is None for d in documents], np.uint8)
            out.append((base % routes.parts, 2, put(np.array([d[0] for d in documents], np.int64), ids, null, np.array([d[2] for d in documents], np.int64)), base))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int8()), pa.array([o[2] for o in out], pa.binary()), pa.nulls(len(out), pa.binary()), pa.array([o[3] for o in out], pa.int64())], names=["b", "kind", "blob", "more", "base"])

    return run


@dataclass
class Scale:
    """Counts of the whole training corpus: N, V, discounts of words and pairs, mass of the unknown class, counts of hot pairs and common words."""

    tokens: int
    distinct: int
    word_d: np.ndarray
    pair_d: np.ndarray
    unknown: float
    pairs: np.ndarray
    pair_counts: np.ndarray
    starts: int
    common: np.ndarray
    common_counts: np.ndarray

    def count(self, words: np.ndarray) -> np.ndarray:
        """Training counts of common words."""
        at, there = find(self.common, words)
        return np.where(there, self.common_counts[at], 0) if len(self.common) else np.zeros(len(words), np.int64)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.word_d) / (self.tokens + 1), self.unknown)


_SUMS = "kind byte, d int, blob binary, hot long, mass double, words double"


def _by_document(parts: int, row: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Columns by ranges of 1,024 rows dealt over the partitions."""
    to = _mix(row.astype(np.uint64) >> np.uint64(10), np.zeros(len(row), np.uint64)) % np.uint64(parts)
    order, found = runs(to, row)
    for d, s in found:
        yield d, put(row[order[s]], *(c[order[s]] for c in columns))


def _model(routes: Routes, scale: Scale, b: int, tokens: list, answers: list) -> dict[str, np.ndarray]:
    """The part of the model that partition ``b`` holds: by pair (sorted keys) its log probability, and its word's; hot histories' masses.

    A hot history's back-off weight is left out of ``logp`` (``late``: its place among the hot ones, else -1). Hot pairs
    are no part of the masses here, since any partition may hold their tokens: ``_hot_masses`` adds them once for each pair.
    """
    found = []
    for blob, _ in tokens:
        names, runs, words, index, mark = take(blob)
        h, w = np.repeat(names, runs), words[index]
        key, first, inverse = np.unique(_mix(h, w), return_index=True, return_inverse=True)
        found.append((key, h[first], w[first], np.bincount(inverse, mark & np.uint64(1), len(key)).astype(np.int64)))
    key, first, inverse = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
    pair_h, pair_w = (np.concatenate([f[i] for f in found])[first] for i in (1, 2))
    pair_c = np.bincount(inverse, np.concatenate([f[3] for f in found]), len(key)).astype(np.int64)
    del found, first, inverse
    at, split = find(scale.pairs, key)
    pair_c[split] = scale.pair_counts[at[split]]
    answers = [*answers, (scale.common, scale.common_counts)]  # a partition that only holds tokens of hot pairs has asked nothing
    names_w, counts_w = np.concatenate([k[0] for k in answers]), np.concatenate([k[1] for k in answers])
    order = np.argsort(names_w, kind="stable")
    names_w, counts_w = names_w[order], counts_w[order]
    at, there = find(names_w, pair_w)
    word_c = np.where(there, counts_w[at], 0)
    low = scale.unigram(word_c)
    hist, of_h = np.unique(pair_h, return_inverse=True)
    hot_at, hot = find(routes.hot, hist)
    c_h = np.bincount(of_h, pair_c, len(hist))
    at, there = find(names_w, hist)
    c_h = np.where(hot & there, counts_w[at], c_h)
    c_h = np.where(hist == START, scale.starts, c_h)
    seen = pair_c > 0
    held = np.where(seen, discounted(pair_c, scale.pair_d), 0.0)
    mass = np.bincount(of_h, np.where(split, 0.0, held), len(hist)) / (c_h + 1)
    words = np.bincount(of_h, np.where(seen & ~split, low, 0.0), len(hist))
    back = np.where(c_h > 0, (1 - mass) / np.maximum(1 - words, 1e-300), 1.0)
    log_back = np.where(hot, 0.0, np.log10(np.maximum(back, 1e-300)))
    logp = np.where(seen, np.log10(np.maximum(held, 1e-300) / (c_h[of_h] + 1)), log_back[of_h] + np.log10(low))
    base = np.log10((word_c + 0.5) / (scale.tokens + 0.5 * (scale.distinct + 1)))
    late = np.where(hot[of_h] & ~seen, hot_at[of_h], -1).astype(np.int32)
    return {"key": key, "logp": logp, "base": base, "known": word_c > 0, "late": late, "hot": hot_at[hot], "mass": mass[hot], "words": words[hot]}


def _hot_masses(routes: Routes, scale: Scale) -> np.ndarray:
    """(mass, words) that the hot pairs add to each hot history, by their exact counts: a hot pair's history is hot."""
    at, there = find(scale.pairs, routes.pairs)
    c = np.where(there, scale.pair_counts[at], 0) if len(scale.pairs) else np.zeros(0, np.int64)
    h, w, c = routes.pair_h[c > 0], routes.pair_w[c > 0], c[c > 0]
    c_h = np.where(h == START, scale.starts, scale.count(h))
    at, _ = find(routes.hot, h)
    return np.stack([np.bincount(at, x, len(routes.hot)).astype(float) for x in (discounted(c, scale.pair_d) / (c_h + 1), scale.unigram(scale.count(w)))])


def _evaluate(routes: Routes, scale: Scale):
    """Blobs for documents: sums (kind 0), documents (1), unseen pairs of hot histories (3); and hot histories' masses (2).

    Pairs are brought together once for the model; tokens are then looked up a blob at a time.
    """
    names = [x.split()[0] for x in _SUMS.split(", ")]
    types = [pa.int8(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in groups(batches):
            out = []
            for r in rows:
                if r[1] == 2:
                    row, ids, null, n = take(r[2])
                    out += [(1, d, blob, None, None, None) for d, blob in _by_document(routes.parts, row, ids, null, n)]
            tokens = [(r[2], r[4]) for r in rows if r[1] == 1]
            answers = [(take(r[2])[0], take(r[3])[0]) for r in rows if r[1] == 0]
            del rows
            if tokens:
                model = _model(routes, scale, b, tokens, answers)
                out += [(2, None, None, *x) for x in zip(model["hot"].tolist(), model["mass"].tolist(), model["words"].tolist(), strict=True)]
            del answers
            for blob, base_row in tokens:
                runs_h, runs, words, index, mark = take(blob)
                at = np.searchsorted(model["key"], _mix(np.repeat(runs_h, runs), words[index]))
                docs, of_doc = np.unique((mark >> np.uint64(1)).astype(np.int64) + base_row, return_inverse=True)
                sums = [np.bincount(of_doc, model[x][at], len(docs)) for x in ("known", "base", "logp")]
                out += [(0, d, x, None, None, None) for d, x in _by_document(routes.parts, docs, sums[0].astype(np.int64), sums[1], sums[2])]
                late = model["late"][at]
                if (late >= 0).any():
                    both, n = np.unique(np.stack([of_doc[late >= 0], late[late >= 0]]), axis=1, return_counts=True)
                    out += [(3, d, x, None, None, None) for d, x in _by_document(routes.parts, docs[both[0]], both[1].astype(np.int64), n)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return run


def _finish(log_back: np.ndarray):
    """doc_id, n_tokens, n_known, base, score of each document from the blobs of its range (columns d, kind, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            ids = [take(r[2]) for r in rows if r[1] == 1]
            row, doc, null, n = (np.concatenate([x[i] for x in ids]) for i in range(4))
            order = np.argsort(row)
            row, sums = row[order], np.zeros((3, len(row)))
            for r in rows:
                if r[1] == 0:
                    own, *values = take(r[2])
                    at = np.searchsorted(row, own)
                    for total, v in zip(sums, values, strict=True):
                        total[at] += v
                elif r[1] == 3:
                    own, hot, times = take(r[2])
                    np.add.at(sums[2], np.searchsorted(row, own), log_back[hot] * times)
            yield pa.RecordBatch.from_arrays([pa.array(doc[order], pa.int64(), mask=null[order].astype(bool)), pa.array(n[order]), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (h, w, n) of histories (w null) and of pairs."""
    for h, w, *_ in _tokens(batches):
        names, n = np.unique(h, return_counts=True)
        _, first, m = np.unique(_mix(h, w), return_index=True, return_counts=True)
        both = pa.concat_arrays([pa.nulls(len(names), pa.int64()), pa.array(w[first].view(np.int64))])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[names, h[first]].view(np.int64)), both, pa.array(np.r_[n, m])], names=["h", "w", "n"])


def _routes(docs: DataFrame, parts: int | None, sample: int = 1000) -> Routes:
    """Partitions from the tokens of some ``sample`` documents by hash, and hot histories and pairs: those with over a quarter of a
    partition's share there. They are counted in the cluster; at most four of either kind for each partition come here."""
    every = max(1, docs.count() // sample)
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(every)) == 0).select("row", "doc_id", "text", "train")
    counts = store(rows.mapInArrow(_sampled, "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n")), "sampled")
    size = int(counts.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts = parts or parts_for(docs, size * every, TOKENS_A_PART)
    found = counts.where((F.col("n") >= 20) & (4 * parts * F.col("n") > size)).collect()
    drop(counts)

    def unsigned(values: list[int]) -> np.ndarray:
        return np.array(values, np.int64).view(np.uint64)

    def spread(values: list[int]) -> np.ndarray:
        return np.array([min(parts, -(-4 * parts * n // size)) for n in values], np.uint64)

    hot, pairs = ([r for r in found if (r["w"] is None) == single] for single in (True, False))
    names, h, w = unsigned([r["h"] for r in hot]), unsigned([r["h"] for r in pairs]), unsigned([r["w"] for r in pairs])
    key, by_name = _mix(h, w), np.argsort(names)
    by_key = np.argsort(key)
    return Routes(parts, names[by_name], spread([r["n"] for r in hot])[by_name], key[by_key], spread([r["n"] for r in pairs])[by_key], h[by_key], w[by_key])


def score(docs: DataFrame, modulus: int = 5, held: int = 1, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from rows whose crc32 remainder is not ``held``; a null id has remainder 0 and is learnt from. A null
    text is an empty one: its only token is the end. Repeated rows are scored row by row; without training rows every
    word is unknown and has probability 1; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", modulus) != held).alias("train"))
    routes = _routes(rows, parts)
    parts = routes.parts
    pairs = rows.mapInArrow(_pairs_out(routes), "b int, blob binary").repartition(parts, "b").sortWithinPartitions("b")
    asked = store(pairs.mapInArrow(lean(_ask(routes)), _ASK), "asked")
    pair_n, hot_pairs = np.zeros(TOP + 3, np.int64), {}
    for r in asked.where("kind = 1").select("words", "counts", "n").collect():  # a short row for each partition
        pair_n += np.array(r["n"])
        hot_pairs |= dict(zip(take(bytes(r["words"]))[0].tolist(), take(bytes(r["counts"]))[0].tolist(), strict=True))
    told = asked.where("kind = 0").select("wb", "b", "words", "counts").repartition(parts, "wb").sortWithinPartitions("wb")
    told = store(told.mapInArrow(lean(_answer(routes)), "b int, words binary, counts binary, n array<long>"), "answers")
    drop(asked)
    sums, common = np.zeros(TOP + 3 + 2, np.int64), {}
    for r in told.where("b is null").select("words", "counts", "n").collect():  # a short row for each partition
        sums += np.array(r["n"])
        common |= dict(zip(take(bytes(r["words"]))[0].tolist(), take(bytes(r["counts"]))[0].tolist(), strict=True))
    n_tokens, distinct = int(sums[TOP + 3]), int(sums[TOP + 4])
    word_d, pair_d = discounts(sums[: TOP + 3]), discounts(pair_n)
    n = sums[: TOP + 3].astype(float)
    high = n_tokens - sum(r * n[r] for r in range(1, TOP + 1))
    mass = (sum(r * n[r] * word_d[r] for r in range(1, TOP + 1)) + high) / (n_tokens + 1)
    starts = int(rows.where("train").count())
    counts = [a for x in (hot_pairs, common) for a in (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], np.int64))]
    scale = Scale(n_tokens, distinct, word_d, pair_d, 1 - mass, *counts[:2], starts, *counts[2:])
    answers = told.where("b is not null").selectExpr("b", "cast(0 as byte) kind", "words blob", "counts more", "cast(0 as long) base")
    tokens = rows.mapInArrow(_tokens_out(routes), "b int, kind byte, blob binary, more binary, base long")
    both = answers.unionByName(tokens).repartition(parts, "b").sortWithinPartitions("b", "kind")
    found = store(both.mapInArrow(lean(_evaluate(routes, scale)), _SUMS), "sums")
    drop(told)
    weights = found.where("kind = 2").groupBy("hot").agg(F.sum("mass").alias("m"), F.sum("words").alias("w")).collect()  # a row for each hot history
    masses = _hot_masses(routes, scale)
    for r in weights:
        masses[:, r["hot"]] += r["m"], r["w"]
    log_back = np.log10(np.maximum(1 - masses[0], 1e-300) / np.maximum(1 - masses[1], 1e-300))
    ranges = found.where("kind <> 2").select("d", "kind", "blob").repartition(parts, "d").sortWithinPartitions("d", F.xxhash64("blob"))
    total = ranges.mapInArrow(_finish(log_back), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return total.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
