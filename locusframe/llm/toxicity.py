"""Toxicity: a counterfactually regularised linear classifier.

Features are the presence of words and word beginnings. Their document
frequencies by label are counted over the labelled sample; those that tell the
labels apart best are kept. A logistic model is fitted on the driver with a
further penalty: each labelled sentence that names a group is written again
with another group's term, and the squared change of its score is added to the
loss, so that a bare mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import held_out, id_text, slices
from locusframe.llm.labelled import training_texts

#: Labelled rows from which the model learns, and features that it keeps, at most.
SAMPLE, KEPT = 20_000, 1024
#: A document is rejected from this score on.
CUT = 0.7
#: Least association (G squared) of a kept feature, weight of the counterfactual penalty and of the ridge.
LEAST, FAIR, RIDGE = 20.0, 4.0, 2e-5
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (3, 4, 5)

# Terms that name groups, by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_SWAP = {w: [x for x in group if x != w] for group in IDENTITY for w in group}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """Signed 64-bit hashes of a word and its beginnings."""
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in STEMS if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def swapped(sentence: str) -> str | None:
    """The sentence with each group term replaced by another of its kind; None without any."""
    found = False

    def other(m: re.Match) -> str:
        nonlocal found
        choice = _SWAP.get(m.group().lower())
        if not choice:
            return m.group()
        found = True
        return choice[xxhash.xxh3_64_intdigest(sentence) % len(choice)]

    out = _WORD.sub(other, sentence)
    return out if found else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the partition's features by label."""
    known: dict[str, list[int]] = {}
    freq: dict[int, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got: set[int] = set()
            for w in words(text or ""):
                f = known.get(w)
                if f is None:
                    f = known[w] = features(w)
                got.update(f)
            for f in got:
                freq.setdefault(f, [0, 0])[y] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(freq), pa.int64()), pa.array([v[0] for v in freq.values()], pa.int64()), pa.array([v[1] for v in freq.values()], pa.int64())], names=["f", "n0", "n1"])


def select_features(rows: DataFrame, kept: int = KEPT) -> list[int]:
    """Hashes of the features whose document frequencies differ most between the labels (by G squared)."""
    totals = rows.agg(F.sum(1 - F.col("y")).alias("t0"), F.sum("y").alias("t1")).first()
    t0, t1 = totals["t0"] or 0, totals["t1"] or 0
    if not t0 or not t1:
        return []
    freq = rows.mapInArrow(_count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")

    def cell(a, total, row):
        return F.when(a > 0, a * F.log(a * F.lit(float(t0 + t1)) / (F.lit(float(total)) * row))).otherwise(0.0)

    rest = F.lit(float(t0 + t1)) - n
    g = 2 * (cell(F.col("n0"), t0, n) + cell(F.col("n1"), t1, n) + F.when(rest > 0, cell(t0 - F.col("n0"), t0, rest) + cell(t1 - F.col("n1"), t1, rest)).otherwise(0.0))
    best = freq.where(n >= 5).withColumn("g", g).where(F.col("g") >= LEAST).orderBy(F.desc("g"), "f").limit(kept)
    return [r["f"] for r in best.collect()]  # at most `kept` rows


class Toxicity:
    """Weights by feature hash, and a bias."""

    def __init__(self, weight: dict[int, float], bias: float):
        self.weight, self.bias = weight, bias


def _present(text: str, at: dict[int, int]) -> list[int]:
    """Places of the kept features that a text holds."""
    return sorted({at[f] for w in words(text) for f in features(w) if f in at})


def _own(shared):
    """Kept features of each labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(shared.value)}
        for batch in batches:
            held = [_present(t or "", at) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "y", "a"])

    return run


def _products(shared):
    """(i, j, v): sums over the partition's sentences with a group term of the products of the changes of features i and j when the term is swapped; (-1, -1, v) counts the sentences that change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(shared.value)}
        total, n = np.zeros((len(at), len(at))), 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if not text or not words(text) & _SWAP.keys():
                    continue
                for s in _SENTENCE.findall(text):
                    if t := swapped(s):
                        a, b = set(_present(s, at)), set(_present(t, at))
                        if a != b:
                            k = np.array([*(a - b), *(b - a)])
                            v = np.r_[np.ones(len(a - b)), -np.ones(len(b - a))]
                            total[np.ix_(k, k)] += np.outer(v, v)
                            n += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1], pa.int32()), pa.array(np.r_[j, -1], pa.int32()), pa.array(np.r_[total[i, j], n], pa.float64())], names=["i", "j", "v"])

    return run


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, steps: int = 500, fair: float = FAIR, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the class-balanced logistic loss, the ridge and fair * w' change w, where change is the mean product of changes."""
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    vw, vb = w, b
    share = max(y.mean(), 1e-3)
    weight = np.where(y > 0, 0.3 / share, 0.7 / max(1 - share, 1e-3)) / n
    rate = 4.0 / (1 + (x.astype(np.float64) ** 2).sum(axis=1) @ weight + 4 * fair * np.trace(change))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + vb, -30, 30)))
        d = (p - y) * weight
        gw = x.T @ d.astype(np.float32) + ridge * vw + 2 * fair * (change @ vw)
        nw, nb = vw - rate * gw, vb - rate * d.sum()
        k1 = k / (k + 3)
        vw, vb = nw + k1 * (nw - w), nb + k1 * (nb - b)
        w, b = nw, nb
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> Toxicity:
    """Learns labels.toxic from at most `sample` labelled rows that are not held out. With one class only, the model holds its smoothed share.

    The driver gets a row of kept features per labelled document, and of the
    sentences with group terms, however many they are, only a matrix of
    kept x kept sums.
    """
    rows = training_texts(docs, labels, "toxic", sample)
    chosen = select_features(rows, kept)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    own = rows.mapInArrow(_own(shared), "doc_id long, y int, a array<int>").toPandas()  # bounded by the sample
    own = own.sort_values(["doc_id", "y"], kind="stable")
    y = own.y.to_numpy(float)
    if not chosen or not len(y) or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return Toxicity({}, float(np.log(prior / (1 - prior))) if len(y) else -2.0)
    x = np.zeros((len(own), len(chosen)), np.float32)
    for i, a in enumerate(own.a):
        x[i, a] = 1
    sums = rows.mapInArrow(_products(shared), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # at most kept x kept rows
    count, sums = sums[sums.i < 0].v.sum(), sums[sums.i >= 0]
    change = np.zeros((len(chosen), len(chosen)))
    change[sums.i, sums.j] = sums.v / max(count, 1)
    w, bias = fit(x, y, change)
    return Toxicity(dict(zip(chosen, w.tolist(), strict=True)), bias)


def _scores(shared, texts: list[str], known: dict[str, tuple]) -> np.ndarray:
    model = shared.value
    out = np.full(len(texts), model.bias)
    for i, text in enumerate(texts):
        held: set[int] = set()
        for w in words(text):
            f = known.get(w)
            if f is None:
                if len(known) > 150_000:
                    known.clear()
                f = known[w] = tuple(x for x in features(w) if x in model.weight)
            if f:
                held.update(f)
        out[i] += sum(model.weight[f] for f in sorted(held))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 from CUT on).

    Null and empty texts have no features: their score is that of the bias.
    Repeated rows, and rows with a null identifier, are scored each; an empty
    table gives no rows. Other columns stay outside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for part in slices(batch):
                got = _scores(shared, [t or "" for t in part.column(1).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of docs, all columns kept, whose score stays below CUT; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for part in slices(batch, at):
                got = _scores(shared, [t or "" for t in part.column(at).to_pylist()], known)
                stays = (got < CUT) | part.column(at).is_null().to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
