"""Audit of how five document filters interact, over every order in which they can be applied.

A document is reduced to a mask of five bits, one for each filter that it fails.
For a mask and an order the step at which the document goes is fixed, so it is
looked up in a table of 32 masks by 120 orders. A task counts its documents by
part, mask and label and adds them to removals by order and step; these partial
arrays are summed. Only the last filter needs other rows: copies are told by the
SHA-256 of the whole text, folded in each task first, so that a text which makes
up a third of the corpus leaves a task once for each part and label.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import read, slices

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
_COPY = 1 << FILTERS.index("E")
#: Place of each filter in each order.
_STEP_OF = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
_REMOVALS = len(ORDERS) * len(FILTERS)
#: A partial array: removals of all, of good and of toxic documents by order and step; failures and lone failures by filter; documents.
_WIDTH = 3 * _REMOVALS + 2 * len(FILTERS) + 1
#: Entries that a task holds before it hands them on.
HELD_TEXTS, HELD_PARTS = 100_000, 256
_CHUNK = 4 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """What fails a document: A: under `words` words; B: distinct words under `distinct` percent; C: capitals over `capitals` percent of the characters; D: any of `signs`."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    signs: bytes = b"#$%&*|"


def first_failures() -> np.ndarray:
    """The step (from 0) at which a document of a mask goes in an order; 5 where it stays: 32 masks by 120 orders."""
    fails = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS))) & 1 == 1
    return np.where(fails[:, None, :], _STEP_OF[None, :, :], len(FILTERS)).min(axis=2)


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split piece by piece."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = at + _CHUNK
        found = _BLANK.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        words = text[at:end].split()  # of bytes, this splits at the blanks of the contract
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def mask_of(text: bytes, limits: Limits = Limits()) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    n, distinct = _words(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, limits.signs))
    points = len(text.translate(None, _CONTINUATION))
    return (n < limits.words) | (100 * distinct < limits.distinct * n) << 1 | (100 * capitals > limits.capitals * points) << 2 | (signs > 0) << 3


def masks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask (filters A to D) of every row; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                texts = [t or b"" for t in piece.column(2).cast(pa.binary()).to_pylist()]
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), digests, pa.array([mask_of(t, limits) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def _fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, digest, mask, good, toxic) rows to one row a text, part and label: smallest identifier, rows that have it, rows with an identifier, rows without."""
    held: dict[tuple, list] = {}

    def told() -> pa.RecordBatch:
        keys, found = zip(*held.keys(), strict=True), zip(*held.values(), strict=True)
        types = [pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, *found], types, strict=True)], names=["part", "digest", "mask", "good", "toxic", "low", "n_low", "n", "n_null"])

    for batch in batches:
        ids, *keys = (c.to_pylist() for c in batch.columns)
        for i, *key in zip(ids, *keys, strict=True):
            entry = held.setdefault(tuple(key), [None, 0, 0, 0])
            if i is None:
                entry[3] += 1
                continue
            entry[2] += 1
            if entry[0] is None or i < entry[0]:
                entry[0], entry[1] = i, 1
            elif i == entry[0]:
                entry[1] += 1
        if len(held) >= HELD_TEXTS:
            yield told()
            held.clear()
    if held:
        yield told()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic, n) rows to partial arrays by part, their entries that aren't 0 as places and numbers."""
    table, held = first_failures(), {}
    places = np.arange(len(ORDERS)) * len(FILTERS)

    def told() -> pa.RecordBatch:
        at = [np.flatnonzero(a) for a in held.values()]
        columns = [pa.array(list(held), pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([a[i] for a, i in zip(held.values(), at, strict=True)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "at", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).dictionary_encode()
        names = part.dictionary.to_pylist()
        mask, good, toxic, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
        codes, where = np.unique(((part.indices.to_numpy().astype(np.int64) * 32 + mask) * 2 + good) * 2 + toxic, return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, where, n)
        for p in np.unique(codes >> 7):
            mine = codes >> 7 == p
            m, label, weight = codes[mine] >> 2 & 31, codes[mine] & 3, counts[mine]
            steps = table[m]  # rows by orders
            array = held.setdefault(names[p], np.zeros(_WIDTH, np.int64))
            for kind, chosen in enumerate((label >= 0, label & 2 > 0, label & 1 > 0)):
                gone = (steps < len(FILTERS)) & chosen[:, None]
                removed = np.bincount((places + steps)[gone], np.broadcast_to(weight[:, None], steps.shape)[gone], _REMOVALS)
                array[kind * _REMOVALS : (kind + 1) * _REMOVALS] += removed.astype(np.int64)
            for f in range(len(FILTERS)):
                array[3 * _REMOVALS + f] += weight[m >> f & 1 == 1].sum()
                array[3 * _REMOVALS + len(FILTERS) + f] += weight[m == 1 << f].sum()
            array[-1] += weight.sum()
        if len(held) >= HELD_PARTS:
            yield told()
            held.clear()
    if held:
        yield told()


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, its array as pairs of place and number) rows to 120 orders by 5 steps each."""
    which = np.argsort(_STEP_OF, axis=1)  # filter at each step of each order
    order, step = np.repeat(np.arange(len(ORDERS)), len(FILTERS)), np.tile(np.arange(len(FILTERS)), len(ORDERS))
    for batch in batches:
        for name, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            array = np.zeros(_WIDTH, np.int64)
            for e in entries:
                array[e["at"]] = e["n"]
            removed, good, toxic = array[: 3 * _REMOVALS].reshape(3, len(ORDERS), len(FILTERS))
            fails, alone = array[3 * _REMOVALS : -1].reshape(2, len(FILTERS))
            shapley = np.array([removed[which == f].sum() for f in range(len(FILTERS))])
            columns = (array[-1] - removed.cumsum(axis=1), removed, fails[which] - removed, alone[which], good, toxic, shapley[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(order)), pa.array([ORDERS[o] for o in order]), pa.array(step + 1, pa.int32()), *(pa.array(c.ravel(), pa.int64()) for c in columns)],
                names=[c.split()[0] for c in _REPORT.split(", ")],
            )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts and parts count as empty. A document with several label rows is
    good (toxic) if any of them says so; rows of documents with a null or
    unlabelled identifier are neither. E fails rows whose text a smaller
    identifier has: rows that repeat the smallest one pass, and so do null
    identifiers, which are no smaller than others either. Repeated rows count
    each. An empty table gives no rows; other columns stay outside.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic")).where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    rows = masks(docs, limits, id_col, text_col, part_col)
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(1024)).cast("int")).otherwise(0))  # no task meets all null identifiers
    no = F.lit(False)
    rows = rows.join(known, ["doc_id", "spread"], "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    texts = rows.mapInArrow(_fold_copies, "part string, digest binary, mask int, good boolean, toxic boolean, low long, n_low long, n long, n_null long")
    first = F.when(F.col("low") == F.min("low").over(Window.partitionBy("digest")), F.col("n_low")).otherwise(0)
    texts = texts.withColumn("first", first)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n_null") + F.col("first")).alias("n")), F.struct(F.col("mask").bitwiseOR(_COPY).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    counted = texts.select("part", "good", "toxic", F.explode(both).alias("b")).where("b.n > 0").select("part", "b.mask", "good", "toxic", "b.n")
    partial = counted.mapInArrow(_count, "part string, at array<int>, n array<long>")
    summed = partial.select("part", F.explode(F.arrays_zip("at", "n")).alias("e")).groupBy("part", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n"))
    whole = summed.groupBy("part").agg(F.collect_list(F.struct("at", "n")).alias("entries"))  # _WIDTH entries at most
    return whole.mapInArrow(_report, _REPORT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over every document, by language."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
  len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e
  FROM d JOIN firsts USING (text) LEFT JOIN known USING (doc_id)),
g AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN NOT (contains(fails, f) OR len(translate(fails, before, '')) < len(fails)) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(fails, f) AND len(translate(fails, before, '')) = len(fails) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, f) AND len(translate(fails, before, '')) < len(fails) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN good AND contains(fails, f) AND len(translate(fails, before, '')) = len(fails) THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN toxic AND contains(fails, f) AND len(translate(fails, before, '')) = len(fails) THEN n ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
