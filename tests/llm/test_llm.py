import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oracle import expected, rows
from veldspar.llm import common, katz, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, toxicity, url_filter, vector_search
from veldspar.llm.blobs import put, take
from veldspar.llm.common import hashed_words, lower_words, remainder
from veldspar.llm.components import components
from veldspar.llm.shingle_links import joined
from veldspar.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clashing(df):
    """Extra columns with the names of results."""
    for c in ("score", "kept", "held_out", "size", "rank", "rule", "_y", "doc", "target", "bin"):
        df = df.withColumn(c, F.lit("other"))
    return df


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_part_where_they_should():
    text = "a\x0bb\x0cc\u00a0d\u2003E \x85f\tÄÉ\x1cg"
    assert [w.decode() for w in lower_words(text)] == WORD.findall(lowered(text))
    raw = np.frombuffer("One two  ONE\ntwo twö".encode(), np.uint8)
    starts, h = hashed_words(raw)
    assert starts.tolist() == [0, 4, 9, 13, 17] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_blobs_round_trip():
    parts = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint32), np.array([1.5, -2]), np.array([2**63], np.uint64)]
    for a, b in zip(parts, take(put(*parts)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert rows(df.collect(), df.columns) == expected(SQL[name], sf_dir)


# 1 quality classifier
def test_quality_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op1_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_voters_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d"), 80)) for _ in range(30)]
    made = quality_classifier.Voters(np.ones(64, np.float32), rng.standard_normal((64 + quality_classifier.SHARES, 8)).astype(np.float32), np.zeros((0, 8), np.float32), np.zeros(0), 5)
    made.points, made.labels = made.project(texts[:20]), rng.integers(0, 2, 20).astype(float)
    got = made.score(texts[20:], block=3)
    for t, s in zip(texts[20:], got, strict=True):
        cos = made.points @ made.project([t])[0]
        near = np.argsort(-cos)[:5]
        weight = np.maximum(cos[near], 0).astype(float) ** 8
        assert s == pytest.approx((weight * made.labels[near]).sum() / weight.sum(), abs=1e-5)


@pytest.mark.parametrize("fn", [quality_classifier.classify, toxicity.score, quality_rules.judge])
def test_scorers_on_odd_rows(spark, odd, labels_of, fn):
    out = fn(clashing(odd), labels_of((1, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None))).collect()
    assert len(out) == 10
    assert fn(odd.limit(0), labels_of()).count() == 0
    assert fn(odd, labels_of()).count() == 10


# 6 toxicity
def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in got)
    assert hit[1, 1] / (hit[1, 0] + hit[1, 1]) > 0.75 and hit[0, 1] / (hit[0, 0] + hit[0, 1]) < 0.03


def test_corrected_risk_is_not_negative():
    rng = np.random.default_rng(1)
    clean = [np.unique(rng.integers(0, 50, 20)).astype(np.int32) for _ in range(200)]
    bad = [np.append(r, 60).astype(np.int32) for r in clean[:40]]
    made = toxicity.train(bad, clean + bad[:22], 0.1, 128)
    assert made.weights[60] > 1 and abs(made.weights[:50]).max() < made.weights[60] / 2


# 9 quality rules
def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_statistics(spark, sf_dir, odd):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()] + [r["text"] for r in odd.collect()] + ["a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a"]
    for t in texts:
        assert quality_rules.statistics(t)[0] == brute_statistics(t)


def test_monotonic_trees():
    rng = np.random.default_rng(2)
    x = rng.random((500, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(500) < 0.5).astype(float)
    made = quality_rules.grow(x, y, [-1, 0])
    line = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.5)])
    assert (np.diff(made.score(line)) <= 1e-12).all() and made.score(line)[0] > 0.8


def test_quality_rules_keep_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op9_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where(remainder("doc_id") == 0).collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"]]) > 0.97
    assert np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.2


# 3 simhash
def brute_fingerprint(text):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=3):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for i, g in enumerate(group):
        least[g].append(ids[i])
    return {i: min(least[g]) for i, g in zip(ids, group, strict=True)}


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in simhash.op3_simhash(spark, sf_dir).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components([prints[i] for i in docs], list(docs))


def test_masks_cover_every_pair_in_the_radius():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in simhash.masks())


def test_large_buckets_are_exact(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "f long")
    for chunk in (16, 1024):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, chunk=chunk)).collect()}
        assert len(set(found.values())) == len(set(brute_components(prints, prints)[p] for p in prints if simhash._signed(p) in found))


def test_simhash_odd_rows(odd, docs_of):
    got = [tuple(r) for r in simhash.near_duplicates(clashing(odd)).collect()]
    assert len(got) == 10 and sum(f == "0" * 16 for _, f, _ in got) == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_first(docs_of((3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "quite another text altogether here"), (None, "a b c d e f g")))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 9]


def brute_groups(texts, percent=80):
    """Least id reachable by equal five-word sets, SimHash at 3 bits, or Jaccard of ``percent`` % or more."""
    found = {i: WORD.findall(lowered(t or "")) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in found.items()}
    prints, ids = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}, sorted(texts)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 3 or (common and 100 * common >= percent * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in ids}


def test_kept_documents_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, least in brute_groups(texts).items() if i == least}
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_groups_of_a_dense_family(spark, docs_of, chunk):
    rng = np.random.default_rng(8)
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(150):  # a family around one text, at 0.6 to 1 of it
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 40)}"
        texts[i * 7 % 150] = " ".join(w)
    for i in range(150, 190):  # a chain whose ends are far from each other
        texts[i] = " ".join(f"c{k}" for k in range(i * 5, i * 5 + 100))
    docs = docs_of(*texts.items())
    none = spark.createDataFrame([], "doc_id long, component_id long")
    got = {r["doc_id"]: r["component_id"] for r in joined(docs, none, chunk=chunk).collect()}
    want = brute_groups(texts)
    bits = simhash.near_duplicates(docs, 3, 5).select("doc_id", "component_id")
    both = {r["doc_id"]: r["component_id"] for r in joined(docs, bits, chunk=chunk).collect()}
    assert {i: both.get(i, i) for i in texts} == want
    assert all(want[i] == want[c] for i, c in got.items()) and len(got) > 100


def test_kept_documents_odd_rows(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 2, 4, 6, 2**60 + 1]
    assert simhash.keep_first(odd.limit(0)).count() == 0
    assert "extra" in simhash.keep_first(odd.selectExpr("*", "1 extra", "2 component_id", "3 doc")).columns


# 4 line dedup
def brute_removed(docs, percent=80):
    earlier, out = [], set()
    for i, text in sorted(docs):
        for j, line in enumerate(lowered(text).split("\n")):
            s = set(WORD.findall(line))
            if s:
                if any(100 * len(s & o) >= percent * len(s | o) for o in earlier):
                    out.add((i, j))
                earlier.append(s)
    return out


def removed_of(df):
    return {(r["doc_id"], j) for r in df.collect() for j in r["removed"]}


def test_line_dedup_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert removed_of(line_dedup.op4_line_dedup(spark, sf_dir)) == brute_removed(docs)


@pytest.mark.parametrize("chunk", [4, 32768])
def test_line_dedup_of_a_dense_family(spark, docs_of, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(20)]
    docs = [(i, "\n".join(" ".join(f"x{rng.integers(9)}" if rng.random() < 0.1 else w for w in base) for _ in range(3))) for i in range(40)]
    assert removed_of(line_dedup.dedup(docs_of(*docs))) == brute_removed(docs)


def test_line_dedup_odd_rows(odd, docs_of):
    got = line_dedup.dedup(clashing(odd)).collect()
    assert len(got) == 7 and line_dedup.dedup(odd.limit(0)).count() == 0
    docs = docs_of((1, "One two three.\n\nkeep me"), (2, "one TWO three.\n\nother line"), (None, "one two three."), (3, None))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeats(docs).collect()}
    assert texts == {1: ("One two three.\n\nkeep me", 23), 2: ("\nother line", 11), None: ("one two three.", 14), 3: (None, 0)}


@pytest.mark.parametrize("parts", [1, 4])
def test_line_dedup_keeps_the_first_of_repeated_rows(docs_of, parts):
    same, other = "one two three four five\nsix seven eight nine ten\n", "quite other words than these\nalpha beta gamma delta epsilon"
    docs = docs_of((1, same), (1, same), (1, other), (2, other), (1, same), (3, "lines of a third text")).repartition(parts)
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.without_repeats(docs).collect())
    assert got == {(1, same): 1, (1, ""): 2, (1, other): 1, (2, ""): 1, (3, "lines of a third text"): 1}
    removed = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.dedup(docs).collect()}
    assert removed == {1: (8, [3, 4, 6, 7]), 2: (2, [0, 1]), 3: (1, [])}


# 5 url filter
def test_url_parts_and_rules(spark, labels_of):
    urls = ["http://Example.ORG/es/x?q#f", "https://a.example.org/en/12", "https://b.org/", "http://c.org", "x://d.com/fr/://", "y://com/de/", None, "no scheme", "http://notorg/", "http://example.org/ES/", "http://Ä.Org?x/", "http://e.net/a#?b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(clashing(pages), labels_of()).collect()}
    assert got == {
        0: ("example.org", "/es/x", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("b.org", "/", "org/", "allow"),
        3: ("c.org", "", None, "allow"), 4: ("d.com", "/fr/://", "com/fr/", "allow"), 5: ("com", "/de/", "com/de/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notorg", "/", None, "allow"), 9: ("example.org", "/ES/", "org/", "allow"), 10: ("Ä.org", "", None, "allow"), 11: ("e.net", "/a", None, "allow"),
    }


def test_mined_rules_equal_brute_force(spark, labels_of):
    rng = np.random.default_rng(6)
    urls = [f"http://{'spam' if i % 3 == 0 else 'fine'}{rng.integers(3)}.net/{'win' if rng.random() < 0.5 else 'news'}/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = {i for i, u in enumerate(urls) if "spam" in u and "/win/" in u}
    got = url_filter.judge(pages, labels_of(*[(i, int(i not in bad), 0) for i in range(300)]))
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == bad


# 7 vector search
def test_vector_search_recall_and_order(spark):
    sf = "/root/testdata/sf0.1"
    got = defaultdict(list)
    for r in vector_search.op7_vector_search(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = np.array([r["vec_id"] for r in data]), 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        found = got[ids[i]]
        hits += len(set(ids[np.argsort(-s, kind="stable")[:5]].tolist()) & {v for v, _ in found})
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == 5
        assert all(v == pytest.approx(s[ids == j][0], abs=1e-12) for j, v in found)
    assert hits >= 0.9 * 5 * len(got)


def test_vector_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    made = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, None), (50, [2.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in vector_search.search(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


# 8 mixing
def test_mixing_odd_rows(odd):
    got = mixing.mix(clashing(odd)).collect()
    assert len(got) == 10 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0
    used = mixing.blend(odd).count()
    assert used == sum(r["times"] for r in got)


def test_mixing_targets_are_near(spark):
    by = defaultdict(lambda: [0, 0, 0])
    for r in mixing.op8_mixing(spark, "/root/testdata/sf0.1").collect():
        t = by[r["source_size"]]
        t[0], t[1], t[2] = t[0] + r["taken"], r["target"], max(t[2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())


# 2 packing
def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(7)
    items = sorted(((int(rng.integers(1, 60)), int(rng.integers(4)), int(rng.integers(30))) for _ in range(300)), reverse=True)
    got = packing.best_fit(*zip(*items, strict=True), 100, 2)
    bins: list[list] = []
    for (size, source, cluster), (b, offset) in zip(items, got, strict=True):
        fits = [(100 - sum(i[0] for i in x), k) for k, x in enumerate(bins) if sum(i[0] for i in x) + size <= 100 and sum(i[1] == source for i in x) < 2 and all(i[2] != cluster for i in x)]
        want = min(fits)[1] if fits else len(bins)
        assert b == want
        if want == len(bins):
            bins.append([])
        assert offset == sum(i[0] for i in bins[b])
        bins[b].append((size, source, cluster))


def test_packing_holds_everything_once(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents"), clashing(odd)):
        got = packing.pack(docs).toPandas()
        words = docs.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
        assert got["size"].sum() == words and got.groupby("bin")["size"].sum().max() <= packing.CAPACITY
        assert got[got["bin"].notna()].groupby(["bin", "offset"]).size().max() == 1
    assert 2**60 + 1 in set(packing.pack(odd).select("doc_id").where("doc_id > 100").toPandas()["doc_id"])
    assert packing.pack(odd.limit(0)).count() == 0


# 10 LM scoring
def brute_katz(texts, train):
    seqs = [["<s>", *WORD.findall(lowered(t)), "</s>"] for t in texts]
    uni, pairs, starts = Counter(), Counter(), Counter()
    for q, z in zip(seqs, train, strict=True):
        if z:
            uni.update(q[1:]), pairs.update(zip(q, q[1:], strict=False)), starts.update(q[:-1])

    def d(counts):
        n = np.zeros(katz.TOP + 3, int)
        for v in counts.values():
            n[min(v, katz.TOP + 2)] += 1
        return katz.discounts(n)

    d_u, d_p, n = d(uni), d(pairs), sum(uni.values())
    cut = lambda c, x: c if c > katz.TOP else c * x[c]
    p1 = {w: cut(c, d_u) / (n + 1) for w, c in uni.items()}
    unknown, after = 1 - sum(p1.values()), defaultdict(list)
    for (h, w), c in pairs.items():
        after[h].append((w, c))
    back = {h: (1 - sum(cut(c, d_p) for _, c in x) / (starts[h] + 1)) / (1 - sum(p1[w] for w, _ in x)) for h, x in after.items()}
    p = lambda h, w: cut(pairs[h, w], d_p) / (starts[h] + 1) if pairs[h, w] else back.get(h, 1) * p1.get(w, unknown)
    for h in list(after)[:20]:  # exactly normalised
        assert sum(p(h, w) for w in uni) + p(h, "\0unknown") == pytest.approx(1)
    score = [sum(math.log10(p(h, w)) for h, w in zip(q, q[1:], strict=False)) for q in seqs]
    base = [sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in q[1:]) for q in seqs]
    return score, base, [sum(uni[w] > 0 for w in q[1:]) for q in seqs], n


@pytest.mark.parametrize("parts", [3, 64])
def test_katz_equals_brute_force(spark, sf_dir, parts):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    score, base, known, n = brute_katz([r["text"] for r in docs], [zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for r in docs])
    got = katz.score(table(spark, sf_dir, "documents"), parts=parts).orderBy("doc_id").collect()
    assert [r["n_known"] for r in got] == known and {r["train_tokens"] for r in got} == {n}
    assert np.allclose([r["score"] for r in got], score, atol=1e-6) and np.allclose([r["base_score"] for r in got], base, atol=1e-6)


@pytest.mark.parametrize("parts", [8, 64])
@pytest.mark.parametrize("rows_of", ["long", "copies"])
def test_katz_of_few_pairs_equals_brute_force(docs_of, parts, rows_of):
    if rows_of == "long":  # a pair that one document has, in a row that is no multiple of its spread
        docs = [(i, f"some a zebra of {i} and b a c{i % 7} here") for i in range(40)]
        docs[6] = (6, "a b " * 3000)
        docs[3] = (3, "a some a here a of")  # held out: backs off from a
    else:
        docs = [(i, "same few words again and again the same few words") for i in range(60)]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs]
    assert train[6]
    score, base, known, _ = brute_katz([t for _, t in docs], train)
    got = katz.score(docs_of(*docs).coalesce(1), parts=parts).orderBy("doc_id").collect()
    assert [r["n_known"] for r in got] == known
    assert np.allclose([r["score"] for r in got], score, atol=1e-6) and np.allclose([r["base_score"] for r in got], base, atol=1e-6)


def test_katz_odd_rows(odd):
    got = katz.score(clashing(odd)).collect()
    assert len(got) == 10 and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert katz.score(odd.limit(0)).count() == 0


# bounds, clashes, rows that share an id
def test_labelled_sample_is_bounded(docs_of, labels_of):
    docs = docs_of(*[(1, f"text {i}") for i in range(10_000)], *[(i, f"other {i}") for i in range(2, 40)])
    rows_ = common.labelled_sample(docs, labels_of(*[(i, i % 2, 0) for i in range(1, 40)], (1, 0, 0)), "quality", 3).collect()
    assert Counter(r["_y"] for r in rows_) == {0: 3, 1: 3} and len({r["doc_id"] for r in rows_}) == 6
    one = common.labelled_sample(docs, labels_of((1, 1, 0)), "quality", 1).collect()
    assert len(one) == (zlib.crc32(b"1") % 5 != 0)


def test_spread_join_is_a_join(spark):
    big = spark.createDataFrame([(0, i) for i in range(60)] + [(k, k) for k in range(1, 30)] + [(None, 1)], "k int, v int")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 20)], "k int, name string")
    for how in ("inner", "left"):
        got = common.spread_join(big, small, ["k"], how, most=4, least=5)
        assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))


def test_stored_tables_go(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = common.store(spark.range(3), "three")
    assert found.count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    common.drop(found, None)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        found.count()


def test_two_texts_of_one_id(docs_of):
    docs = docs_of((0, "a b c d e"), (1, "a b c d e\nx1"), (1, "unique words here now\ny1"), (1, "q q2"), (1, "q q2\nz"))
    got = Counter(r["text"] for r in line_dedup.without_repeats(docs).collect())
    assert got == {"a b c d e": 1, "x1": 1, "unique words here now\ny1": 1, "q q2": 1, "z": 1}
    kept = simhash.keep_first(docs_of((1, "one text that is quite long enough"), (1, "another text of the same id, unlike it"), (2, "one text that is quite long enough")))
    assert sorted((r["doc_id"], r["text"][:3]) for r in kept.collect()) == [(1, "ano"), (1, "one")]


def test_columns_that_clash_with_helpers(odd):
    names = ("_gone", "_d", "_at", "_r", "_own", "_bits", "_f", "_hash", "_i", "_use", "_h", "_times", "f", "a", "b", "row", "words", "h", "n", "cluster", "tie", "component", "doc", "_y", "_salt", "_range")
    more = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for fn in (line_dedup.without_repeats, simhash.keep_first, mixing.blend):
        out = fn(more)
        assert out.columns == more.columns
        plain = Counter((r["doc_id"], r["text"]) for r in fn(odd).collect())
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == plain
        assert all([r[c] for c in names] == list(range(len(names))) for r in out.collect())
    for fn in (packing.pack, line_dedup.dedup, simhash.near_duplicates, mixing.mix, katz.score):
        assert fn(more).count() == fn(odd).count()


def test_lines_of_other_thresholds(docs_of):
    rng = np.random.default_rng(9)
    docs = [(i, "\n".join(" ".join(f"w{rng.integers(6)}" for _ in range(rng.integers(1, 7))) for _ in range(4))) for i in range(25)]
    for percent in (50, 66, 75, 90, 100):
        assert removed_of(line_dedup.dedup(docs_of(*docs), percent)) == brute_removed(docs, percent)


def test_packing_does_not_depend_on_partitions(spark, docs_of):
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{rng.integers(300)}" for _ in range(rng.integers(1, 900))) for _ in range(40)]
    docs = docs_of(*[(i % 35, texts[rng.integers(40)], f"s{i % 3}") for i in range(120)])
    found = [sorted(tuple(r) for r in packing.pack(docs.repartition(n)).collect()) for n in (1, 3)]
    assert found[0] == found[1]


def test_packing_keeps_its_constraints(spark):
    sf = "/root/testdata/sf0.01"
    got = packing.op2_packing(spark, sf).where("bin IS NOT NULL AND bin NOT LIKE 'full-%'")
    named = simhash.with_component(table(spark, sf, "documents"), "cluster").select("doc_id", "source", "cluster")
    both = got.join(named, "doc_id")
    assert both.count() == got.count()
    assert both.groupBy("bin", "cluster").count().where("count > 1").count() == 0
    assert both.groupBy("bin", "source").count().where(F.col("count") > packing.PER_SOURCE).count() == 0


def test_risk_and_its_slopes_equal_brute_force():
    rng = np.random.default_rng(11)
    for shift in (-5.0, 4.0):  # without and with a negative part below 0
        z, n_p, prior = np.r_[rng.normal(2 + shift, 1, 7), rng.normal(-2, 1, 20)], 7, 0.4
        loss = lambda x, y: math.log1p(math.exp(-x if y else x))
        plus = prior * sum(loss(x, 1) for x in z[:n_p]) / n_p
        minus = sum(loss(x, 0) for x in z[n_p:]) / 20 - prior * sum(loss(x, 0) for x in z[:n_p]) / n_p
        assert toxicity.risk(z, n_p, prior) == pytest.approx((plus, minus))
        assert (minus < 0) == (shift > 0)
        whole = lambda v: sum(toxicity.risk(v, n_p, prior)) if minus >= 0 else -toxicity.risk(v, n_p, prior)[1]
        for i in range(len(z)):
            step = np.zeros(len(z))
            step[i] = 1e-5
            assert toxicity.slopes(z, n_p, prior)[i] == pytest.approx((whole(z + step) - whole(z - step)) / 2e-5, abs=1e-6)


def test_unlabelled_texts_are_drawn_whatever_their_labels(docs_of, labels_of):
    docs = docs_of(*[(i, f"common words {'grim' if i % 4 == 0 else 'mild'} number{i}") for i in range(400)])
    labels = [(i, None, 1) for i in range(0, 400, 8)]
    positive, unlabelled = toxicity.samples(docs, labels_of(*labels), "toxic", 1000, 1 << 14, 512)
    again = toxicity.samples(docs, labels_of(*labels, *[(i, None, 0) for i in range(1, 400, 3)]), "toxic", 1000, 1 << 14, 512)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert len(positive) == sum(i % 8 == 0 for i in train) and len(unlabelled) == len(train)
    assert [sorted(map(bytes, x)) for x in again] == [sorted(map(bytes, x)) for x in (positive, unlabelled)]
    assert len(toxicity.samples(docs, labels_of(*labels), "toxic", 20, 1 << 14, 512)[1]) == 40
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels_of(*labels)).collect()}  # positives only
    assert np.mean([got[i] == (i % 4 == 0) for i in got]) > 0.9


def test_mined_rules_are_those_of_a_brute_force_miner(spark):
    rng = np.random.default_rng(12)
    rows_ = [({t for t in "abcdef" if rng.random() < 0.5} | {"all"} | ({"g", "h"} if rng.random() < 0.3 else set()), None) for _ in range(200)]
    rows_ = [(sorted(t), ("a" in t and "b" in t) or rng.random() < 0.1) for t, _ in rows_]
    marked = spark.createDataFrame([(t, bool(b)) for t, b in rows_], "tokens array<string>, bad boolean")
    rules, members = url_filter.mine(marked, 0.01, 0.7, 5)
    of = defaultdict(set)
    for r in members.collect():
        of[r["class"]].add(r["token"])
    got = {frozenset(r["classes"]): r["confidence"] for r in rules.collect()}
    names = sorted({t for t, _ in rows_ for t in t} - {"all", "h"})  # one of those that always come together, none of all rows
    want = {}
    for size in range(1, len(names) + 1):
        for chosen in itertools.combinations(names, size):
            hit = [b for t, b in rows_ if set(chosen) <= set(t)]
            if sum(hit) >= 5 and sum(hit) / len(hit) >= 0.7:
                want[frozenset(chosen)] = pytest.approx(sum(hit) / len(hit))
    assert got == want and len(want) > 3 and of["g"] == {"g", "h"}
    deep = spark.createDataFrame([([f"t{i}" for i in range(20)], True)] * 40 + [(["x"], False)] * 40, "tokens array<string>, bad boolean")
    assert [r["n"] for r in url_filter.mine(deep)[0].collect()] == [1]


def test_url_filter_odd_rows(spark, labels_of):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.org/" + "x/" * 3000), (2, ""), (3, "http://b.net/x"), (3, "http://b.net/x")], "page_id long, url string")
    got = url_filter.judge(clashing(pages), labels_of((1, 0, 1), (3, 0, 0), (None, 0, 0)))
    assert Counter(r["page_id"] for r in got.collect()) == {1: 2, None: 1, 2: 1, 3: 2}
    assert url_filter.judge(pages.limit(0), labels_of()).count() == 0


def test_long_texts_repeat_as_short_ones():
    rng = np.random.default_rng(13)
    for n in (3, 6, 50, 3000):
        found = [f"w{x}".encode() for x in rng.integers(0, max(2, n // 8), n)]
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        often = Counter(windows)
        assert quality_rules.repeated_words(found) == len({j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)})


def test_flat_trees_equal_nested_ones():
    rng = np.random.default_rng(14)
    x = rng.random((300, 3))
    made = quality_rules.grow(x, (x[:, 0] + x[:, 1] > 1).astype(float), [0, 0, 0], trees=7)

    def one(row):
        total = made.base
        for feature, cut, leaf in zip(made.feature, made.cut, made.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(made.score(x), [one(r) for r in x])


def test_katz_without_training_rows(docs_of):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = katz.score(docs_of(*[(i, "some words") for i in ids])).collect()
    assert len(got) == 3 and {r["train_tokens"] for r in got} == {0} and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_repeated_ids_of_vectors(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0])], "vec_id long, embedding array<float>")
    found = [sorted(tuple(r) for r in vector_search.search(clashing(df.repartition(n)), df.repartition(n).where("vec_id = 50"), 5).collect()) for n in (1, 3)]
    assert found[0] == found[1] and [r[2] for r in found[0]] == [1, 1]


# pipeline
def test_pipeline_equals_brute_force(spark, docs_of, labels_of, tmp_path):
    """All rows of run() on a small fixture: kept documents, their lines, one of each group, how often each is used, and bins that hold them."""
    import corpus_pipeline as p

    texts = {r["doc_id"]: (r["text"], r["source"]) for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(120).collect()}
    docs = docs_of(*[(i, t, s) for i, (t, s) in texts.items()], (None, "no id but many words of its own that nobody else in here ever says at all", "s"), (5000, None), (5001, ""), (7, texts[7][0] if 7 in texts else "x", "again"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    kept = [r for r in quality_rules.judge(docs.select("doc_id", "text", "source"), table(spark, str(tmp_path), "labels")).where("kept").collect()]
    rows_ = sorted(((r["doc_id"], t, s) for r in kept for i, t, s in [next((i, t, s) for i, t, s in _rows_of(docs) if i == r["doc_id"] and s == r["source"])]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    named = [x for x in rows_ if x[0] is not None]
    at, numbered = {}, []
    for i, t, s in named:  # lines of one id count on from row to row
        numbered.append((i, t, s, at.get(i, 0)))
        at[i] = at.get(i, 0) + len(t.split("\n"))
    whole = defaultdict(list)
    for i, t, _, _ in numbered:
        whole[i].append(t)
    gone = brute_removed([(i, "\n".join(x)) for i, x in whole.items()])
    cut = [(i, "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j + a) not in gone), s) for i, t, s, a in numbered]
    group = brute_groups({k: t for k, (_, t, _) in enumerate(cut)})
    left = [x for k, x in enumerate(cut) if group[k] == k] + [x for x in rows_ if x[0] is None]
    plan = mixing.mix(docs_of(*left)).collect()  # the mix itself is held to SQL
    want = Counter({r["doc_id"]: 0 for r in plan})
    for r in plan:
        want[r["doc_id"]] += r["size"] * r["times"]
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["size"]
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in want.items() if n}
    use = defaultdict(list)
    for r in got:
        if r["bin"] is not None:
            use[r["bin"]].append((r["offset"], r["size"]))
    for pieces in use.values():  # no bin overflows, no pieces overlap
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(pieces))) and sum(n for _, n in pieces) <= packing.CAPACITY


def _rows_of(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_pipeline_on_odd_rows(spark, odd, labels_of, tmp_path):
    import corpus_pipeline as p

    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels_of((1, 1, 0), (4, 0, 1), (None, 1, 1)).write.parquet(str(tmp_path / name / "labels.parquet"))
        assert p.run(spark, str(tmp_path / name)).columns == ["doc_id", "piece", "size", "bin", "offset"]
        p.run(spark, str(tmp_path / name)).collect()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        rows_ = docs.collect()
        if name == "quality_rules":
            kept = quality_rules.op9_quality_rules(spark, sf_dir).where("kept").select("doc_id").collect()
            assert {r["doc_id"] for r in rows_} == {r["doc_id"] for r in kept}
        if name == "line_dedup":
            gone = brute_removed(list({i: before[i] for i in (r["doc_id"] for r in rows_)}.items()))
            for r in rows_:
                assert r["text"] == "\n".join(x for j, x in enumerate(before[r["doc_id"]].split("\n")) if (r["doc_id"], j) not in gone)
        docs = spark.createDataFrame(rows_, docs.schema)
    assert p.run(spark, sf_dir).count() >= len({r["doc_id"] for r in docs.collect()})
