"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled documents, with monotonic constraints on chosen
statistics, and flattened into numpy node arrays, so that a block of documents is scored by ``depth`` gathers
a tree. Statistics come from one pass over the whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from veldspar.llm.common import annotate, labelled_sample, table

SYMBOLS = "#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, with the sign in which a score may move as one grows (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "letter_share": 0, "bare_symbol_words": -1, "exclaim_share": -1, "words_a_line": 0, "distinct_share": 0, "long_words": 0,
}
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text; a null text is an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(_WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(found)
    size = max(1, len(raw))
    features = [
        np.log1p(n), word_chars / max(1, n), symbols / max(1, word_chars), dup / max(1, lines), repeat / max(1, n),
        (size - len(raw.translate(None, _UPPER))) / size, (size - len(raw.translate(None, _DIGIT))) / size, (size - len(raw.translate(None, _LETTER))) / size,
        sum(map(found.count, (b"|", b"*", b"#", b"-"))) / max(1, n), raw.count(b"!") / size, n / max(1, lines), len(set(found)) / max(1, n), sum(len(w) > 14 for w in found) / max(1, n),
    ]
    return [n, word_chars, symbols, dup, repeat], features


def repeated_words(found: list[bytes], width: int = 5) -> int:
    """Words in ``width``-word windows that come twice or more, the first one included.

    Words are numbered, then pairs of runs are, exactly: a long text needs a few integers a word.
    """
    if len(found) <= width:
        return 0
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    if len(number) == len(found):
        return 0
    window, length = word, 1
    while length < width:
        step = min(length, width - length)  # windows that overlap cover the longer one as well
        window = np.unique(window[:-step] * (int(window.max()) + 1) + window[step:], return_inverse=True)[1]
        length += step
    often = np.bincount(window)[window] > 1
    inside = np.zeros(len(found) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(often), 1)
    np.add.at(inside, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


@dataclass
class Trees:
    """Flat trees: node arrays of shape (trees, nodes); a complete tree of ``depth`` levels, leaves last."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    Monotonic: a cut on a signed feature is taken only if its two values are in order, and both halves' later
    values stay on their side of the middle. Without rows the trees answer 0.5.
    """
    inner = 2**depth - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    all_f, all_c, all_l = [], [], []
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        bounds = {0: (-np.inf, np.inf)}
        leaf, at = np.zeros(inner + 1), np.zeros(len(y), np.int64)
        for node in range(2 * inner + 1):
            low, high = bounds[node]
            rows = np.flatnonzero(at == node)
            gs, hs = g[rows].sum(), h[rows].sum()
            if node >= inner:
                leaf[node - inner] = rate * np.clip(-gs / (hs + l2), low, high)
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 4:
                    continue
                gl = np.cumsum(np.bincount(codes[j][rows], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[j][rows], h[rows], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                left, right = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                gain[(hl < least) | (hr < least) | (signs[j] * (right - left) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, e[k], left[k], right[k])
            lo_bounds = hi_bounds = (low, high)
            if best[1] is not None:
                _, j, value, left, right = best
                feature[node], cut[node] = j, value
                if signs[j]:
                    middle = (left + right) / 2
                    lo_bounds, hi_bounds = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
            bounds[2 * node + 1], bounds[2 * node + 2] = lo_bounds, hi_bounds
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        raw += leaf[at - inner]
        all_f.append(feature), all_c.append(cut), all_l.append(leaf)
    shape = (len(all_f), -1)
    return Trees(edges, np.array(all_f, np.int64).reshape(shape if all_f else (0, inner)), np.array(all_c).reshape(shape if all_f else (0, inner)), np.array(all_l).reshape(shape if all_f else (0, inner + 1)), base if len(y) else 0.0, depth)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = 6000) -> Trees:
    """Grows trees on at most ``each`` labelled documents of either label (the first by hash of the id).

    Only rows whose crc32 remainder modulo 5 is not 0 are learnt from, so that the others can measure the result.
    """
    sample = labelled_sample(docs, labels, label, each)
    rows = annotate(sample, lambda texts: [[statistics(t)[1] for t in texts]], "_f array<double>").select("doc_id", "_f", "_y").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    x = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([r[2] for r in rows], float), list(FEATURES.values()))


def verdicts(trees: Trees, texts: list[str | None], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """COUNTS as columns, base_failed, score and kept of each text."""
    found = [statistics(t) for t in texts]
    counts = np.array([f[0] for f in found], np.int64).reshape(len(found), len(COUNTS))
    score = trees.score(np.array([f[1] for f in found]).reshape(len(found), len(FEATURES)))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    return counts, failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, each: int = 6000) -> DataFrame:
    """``docs`` without its text, with COUNTS, base_failed, kept and quality_score for every row.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed
    and a score of ``threshold`` or more. Null and empty texts have no words and fail; repeated rows and null ids
    get a row each; an empty table gives an empty result; without labels every score is 0.5. Columns of ``docs``
    with the names of these results are replaced, other columns pass through.
    """
    trees = fit(docs, labels, each=each)

    def score(texts: list[str | None]) -> list:
        counts, failed, score, kept = verdicts(trees, texts, threshold)
        return [*counts.T, failed, kept, score]

    return annotate(docs, score, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality_score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, each: int = 6000) -> DataFrame:
    """``docs``, all columns, without the rows that ``judge`` does not keep: one pass, no join."""
    trees = fit(docs, labels, each=each)
    return annotate(docs, lambda texts: [verdicts(trees, texts, threshold)[3]], "_keep boolean", keep_text=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels"))
