"""How far the sources of a language diverge in their words.

A first pass adds the document frequencies of (language, term) to a count-min
sketch. Every task writes its sketch as blocks of counters, clipped at the
frequency asked for; the blocks are summed where they meet. A counter is never
below the frequency of a term that falls on it, so a term with a counter under
the limit is impossible and leaves before anything is shuffled. The terms that
survive are counted exactly by (language, source, term), and those that the
sketch let through in error go by the exact frequency.

Distances between sources are sums over the terms that occur, not over all kept
terms: a pair starts from the distance of the two shares that an absent term
has, and terms of one source or of both add what they differ from that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut, read, slices

#: Documents of a language in which a term must occur, smoothing, scale of shares and ranks of terms told.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of counters of a sketch and counters a row; a sketch is DEPTH * WIDTH bytes whatever the input.
DEPTH, WIDTH = 4, 1 << 21
_BLOCK = 1 << 16
#: Different keys that a task counts before it hands them on.
HELD = 400_000
_FOLD = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A to Z, lower-cased, and of characters beyond ASCII; text in UTF-8."""
    return text.translate(_FOLD).split()


def _cells(keys: list[bytes], width: int) -> np.ndarray:
    """Places of the keys in a sketch, one a row of counters: DEPTH by len(keys)."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return ((h[:, 0] + rows * (h[:, 1] | np.uint64(1))) % np.uint64(width) + rows * np.uint64(width)).astype(np.int64)


def _key(lang: str, term: bytes) -> bytes:
    return lang.encode() + b"\x00" + term  # no term holds a null character


class Sketch:
    """Count-min sketch whose counters stop at `limit` (255 at most): it tells whether a key may have been added that often."""

    def __init__(self, limit: int, width: int = WIDTH):
        self.limit, self.width, self.counters = limit, width, np.zeros(DEPTH * width, np.uint8)

    def add(self, counts: dict[bytes, int]) -> None:
        if not counts:
            return
        n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), self.limit)
        for row in _cells(list(counts), self.width):
            at, where = np.unique(row, return_inverse=True)
            sums = np.bincount(where, n).astype(np.int64)
            self.counters[at] = np.minimum(self.counters[at] + sums, self.limit)

    def may_reach(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key may have reached the limit; false is certain."""
        return (self.counters[_cells(keys, self.width)] >= self.limit).all(axis=0) if keys else np.zeros(0, bool)


def _rows(docs: DataFrame) -> DataFrame:
    blank = F.lit("")
    return docs.select(*(F.coalesce(docs[c].cast("string"), blank).alias(c) for c in ("lang", "source", "text")))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    for batch in batches:
        for piece in slices(batch, 2):
            langs, sources = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, piece.column(2).cast(pa.binary()).to_pylist(), strict=True):
                yield lang, source, terms(text)


def _clipped_sum(blocks: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sums blocks of the same place, clipped again; a task holds the blocks of its places only."""
    held: dict[int, np.ndarray] = {}
    for batch in blocks:
        for at, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = held.setdefault(at, np.zeros(len(counters), np.uint8))
            np.minimum(mine.astype(np.uint16) + np.frombuffer(counters, np.uint8), limit, out=mine, casting="unsafe")
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], names=["at", "counters"])


def sketch_frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH) -> Sketch:
    """The merged sketch of document frequencies of (lang, term); DEPTH * width bytes reach the driver, whatever the corpus."""
    if not 0 < min_docs < 256:
        raise ValueError("min_docs must be from 1 to 255, as a counter is a byte")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = Sketch(min_docs, width), {}
        size = 0
        for lang, _, found in _texts(batches):
            mine = held.setdefault(lang, Counter())
            size -= len(mine)
            mine.update(set(found))
            size += len(mine)
            if size >= HELD:
                for k, c in held.items():
                    sketch.add({_key(k, t): n for t, n in c.items()})
                held, size = {}, 0
        for k, c in held.items():
            sketch.add({_key(k, t): n for t, n in c.items()})
        for i in range(0, DEPTH * width, _BLOCK):
            block = sketch.counters[i : i + _BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["at", "counters"])

    kind = "at int, counters binary"
    blocks = _rows(docs).mapInArrow(build, kind).repartition("at").mapInArrow(lambda b: _clipped_sum(b, min_docs), kind)
    merged = Sketch(min_docs, width)
    for r in blocks.toLocalIterator():
        merged.counters[r["at"] : r["at"] + len(r["counters"])] = np.frombuffer(r["counters"], np.uint8)
    return merged


def count_terms(docs: DataFrame, sketch: Sketch | None) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it), exact, of the terms that the sketch does not rule out."""
    shared = None
    if sketch is not None:
        shared = docs.sparkSession.sparkContext.broadcast((sketch.limit, sketch.width, np.packbits(sketch.counters >= sketch.limit)))

    def sieve(lang: str, found: list[bytes]) -> np.ndarray:
        if shared is None:
            return np.ones(len(found), bool)
        _, width, bits = shared.value
        cells = _cells([_key(lang, t) for t in found], width)
        return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool).all(axis=0)

    def told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            found = list(n)
            chosen = [t for t, keep in zip(found, sieve(lang, found), strict=True) if keep] if found else []
            for i in range(0, len(chosen), 10_000):
                part = chosen[i : i + 10_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([in_docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for lang, source, found in _texts(batches):
            n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(found)
            in_docs.update(set(found))
            size += len(n)
            if size >= HELD:
                yield from told(held)
                held, size = {}, 0
        yield from told(held)

    partial = _rows(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), in whole numbers of 38 digits; null where nothing is kept."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    over = ((count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    under = (total + SMOOTH * kept).cast("decimal(38,0)")
    return F.when(kept > 0, F.call_function("div", over, under) + 1)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language, and the terms that stand out.

    Part pair: item is another source, value the sum over all kept terms of the
    differences of shares, every rank. Part term: item is a term with a larger
    share than in the whole language, value the difference, ranks to `top`.
    Null texts, languages and sources count as empty; a source without terms
    takes part in pairs, and with no kept terms all its values are 0. Repeated
    rows count each; equal values rank by item. An empty table gives no rows;
    other columns, doc_id among them, are not read.
    """
    counts = count_terms(docs, sketch_frequencies(docs, min_docs, width))
    term = Window.partitionBy("lang", "term")  # a term has a row a source at most
    kept = counts.withColumn("n_lang", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term)).where(F.col("in_docs") >= min_docs)
    kept = cut(kept.select("lang", "source", "term", "n", "n_lang"))
    per_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = _rows(docs).select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("v", none).alias("v"), F.coalesce("lang_total", none).alias("lang_total"))
    groups = cut(groups.withColumn("p0", F.coalesce(_share(none, "total", "v"), none)))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "total", "v").alias("p"), "p0", _share("n_lang", "lang_total", "v").alias("q"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    out = out.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    apart = F.abs(F.col("p0") - F.col("o0"))
    base = groups.join(other, "lang").where("source < item").select("lang", "source", "item", (F.col("v") * apart).alias("f"))
    # terms of one source, as if the other had none of them: sources share few different counts
    levels = shares.groupBy("lang", "source", "n").agg(F.count("*").alias("m"), F.first("p").alias("p"), F.first("p0").alias("p0"))
    alone = levels.join(other, "lang").where("source != item").select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("m") * (F.abs(F.col("p") - F.col("o0")) - apart)).alias("f"))
    mine = shares.select("lang", "term", "source", "p", "p0")
    theirs = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    both = mine.join(theirs, ["lang", "term"]).where("source < item")
    both = both.select("lang", "source", "item", (F.abs(F.col("p") - F.col("o")) - F.abs(F.col("p") - F.col("o0")) - F.abs(F.col("p0") - F.col("o")) + apart).alias("f"))
    pairs = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("f").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    pairs = pairs.select("lang", "value", ways.alias("w")).select("lang", F.col("w.a").alias("source"), F.lit("pair").alias("part"), F.col("w.b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the terms that mark each source, over every document."""
    return divergence(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
totals AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept k USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v, totals.total AS lang_total
  FROM groups g JOIN kept k USING (lang) JOIN totals USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (n_lang + 5)::HUGEINT) // (lang_total + 5 * v)::HUGEINT AS BIGINT) AS q FROM grid),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
