"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every document is reduced, over its whole text, to FEATURES numbers; nothing
else of it reaches the model. The trees are grown on the driver from a bounded
sample of labelled rows and flattened into arrays, which the tasks walk for all
rows and trees of a slice at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import held_out, id_text, raw_texts, slices
from locusframe.llm.labelled import training_texts

#: Labelled rows from which the trees are grown at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 1.0

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII symbol, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence sign, 6 beyond ASCII
for _c in range(256):
    _KIND[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c in b" \t\n\r\x0b\x0c" else 5 if _c in b".,;:'\"()-?" else 6 if _c > 127 else 0

FEATURES = (
    "log_words", "word_length", "word_length_sd", "longest_word", "distinct_share", "top_word_share", "repeats", "longest_repeat", "lower", "upper", "digit",
    "space", "sentence_sign", "symbol", "beyond_ascii", "byte_entropy", "log_lines", "line_length", "line_length_sd", "repeated_lines", "symbol_lines", "upper_lines", "bangs", "pipes", "signs_a_word", "words_a_stop", "symbol_words",
)


def statistics(raw: bytes) -> list[float]:
    """The numbers of FEATURES for one text in UTF-8; all 0 for an empty one."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    by = np.bincount(data, minlength=256)
    kind = np.bincount(_KIND, by, 7)
    size = len(raw)
    p = by[by > 0] / size
    lens = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, n - 1)
    edges = np.flatnonzero(~np.r_[False, same, False])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_lens = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.flatnonzero(data == 10)
    bounds = np.r_[0, ends + 1, size]
    # one byte per byte of text: sums of marks between bounds, without running sums
    kinds = _KIND[data]
    span = np.maximum(np.diff(bounds), 1)
    symbol_share, upper_share = between(kinds == 0, bounds) / span, between(kinds == 2, bounds) / span
    starts = np.flatnonzero(np.r_[True, data[:-1] == 32])
    odd = np.logical_or.reduceat(kinds == 0, starts)
    return [
        float(np.log1p(n)), float(lens.mean()), float(lens.std()), float(np.log1p(lens.max())), len(count) / n, max(count.values()) / n, float(same.sum()) / n, float(np.log1p(np.diff(edges).max() - 1 if len(edges) > 1 else 0)),
        kind[1] / size, kind[2] / size, kind[3] / size, kind[4] / size, kind[5] / size, kind[0] / size, kind[6] / size, float(-(p * np.log2(p)).sum()),
        float(np.log1p(len(lines))), float(line_lens.mean()), float(line_lens.std()), 1 - len(set(lines)) / len(lines), float((span * (symbol_share > 0.1)).sum()) / size, float((span * (upper_share > 0.4)).sum()) / size,
        by[33] / n, by[124] / n, kind[5] / n, n / (1 + by[46]), float(odd.mean()),
    ]


def between(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of marks in each range of bounds, 0 in an empty one."""
    at = bounds[:-1]
    full = at < bounds[1:]
    out = np.zeros(len(at), np.int64)
    if full.any():
        out[full] = np.add.reduceat(marks, at[full], dtype=np.int64)
    return out


class Trees:
    """Complete trees of equal depth in flat arrays: node i has the children 2i + 1 and 2i + 2, leaves come last."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        node = np.zeros((n, t), np.int64)
        tree = np.arange(t)
        rows = np.arange(n)[:, None]
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched over at most `bins` quantile bins a feature.

    Without rows, or with one class only, the trees hold the smoothed share of that class alone.
    """
    n, m = x.shape
    inner = 2**depth - 1
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # value <= cut k: bin k or less
    margin = np.full(n, base)
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            gain, pick = np.zeros(width), [(0, np.inf, bins)] * width
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = node * bins + code[j]
                gs, hs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain_j = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain_j[(hs < 1) | (ha - hs < 1)] = 0
                k = gain_j[:, : len(cuts[j])].argmax(axis=1)
                for v in range(width):
                    if gain_j[v, k[v]] > gain[v] + 1e-9:
                        gain[v], pick[v] = gain_j[v, k[v]], (j, cuts[j][k[v]], k[v])
            at = 2**level - 1
            for v in range(width):
                features[t, at + v], thresholds[t, at + v] = pick[v][0], pick[v][1]
            right = code[[p[0] for p in pick]][node, np.arange(n)] > np.array([p[2] for p in pick])[node]
            node = 2 * node + right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaves[t] = -rate * gs / (hs + ridge)
        margin += leaves[t][node]
    return Trees(features, thresholds, leaves, base)


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = [statistics(t) for t in raw_texts(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64())), part.column(2)], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels.quality, from at most `sample` labelled rows that are not held out."""
    rows = training_texts(docs, labels, "quality", sample).mapInArrow(_table, "doc_id long, x array<double>, y int")
    got = sorted((r["doc_id"], tuple(r["x"]), r["y"]) for r in rows.collect())  # at most `sample` rows
    return grow(np.array([x for _, x, _ in got]).reshape(len(got), len(FEATURES)), np.array([y for _, _, y in got], float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 from 0.5 on).

    Null and empty texts have statistics 0 and get a score too. Repeated rows,
    and rows with a null identifier, are scored each; an empty table gives no
    rows. Other columns stay outside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([statistics(t) for t in raw_texts(part)]).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
