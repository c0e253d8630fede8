"""Exact dedup through a cuckoo-filter index of live digests.

Each text is reduced, JVM-side, to the SHA-256 of its white-space-normalised
form. The bucketed content against which a hit of the filter is verified is this
digest, kept whole beside the 16-bit fingerprint. A task folds the digests of
its own rows into a cuckoo index first, so a text that makes up a third of the
corpus leaves each task once; the partial entries are then dealt by digest,
sorted and folded again, a bounded index at a time. Only 32-byte digests move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE, cut, id_text

_SLOTS = 4
_MASK = (1 << 64) - 1


class CuckooIndex:
    """Cuckoo filter over digests whose slots point at the stored keys of their bucket.

    A slot holds a 16-bit fingerprint and the place of the full digest. A probe
    compares fingerprints in the two candidate buckets and verifies every hit
    against the stored digest, so answers are exact. An insertion that finds no
    place after `max_kicks` moves doubles the table and refills it from the
    stored keys. Deleted places are used again.
    """

    def __init__(self, capacity: int = 1024, max_kicks: int = 200):
        self.max_kicks, self.live = max_kicks, 0
        self.keys: list[bytes | None] = []
        self.values: list[list] = []
        self.free: list[int] = []
        self.resizes = 0
        n = 2
        while n * _SLOTS < capacity:
            n *= 2
        self._reset(n)

    def _reset(self, n: int) -> None:
        self.n, self.prints, self.places = n, [0] * (n * _SLOTS), [0] * (n * _SLOTS)

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ ((fp * 0x9E3779B97F4A7C15 & _MASK) >> 20)) & (self.n - 1)

    def _find(self, key: bytes) -> int:
        h, fp = self._parts(key)
        first = h & (self.n - 1)
        for b in (first, self._other(first, fp)):
            at = b * _SLOTS
            group = self.prints[at : at + _SLOTS]
            if fp in group:
                for j in range(_SLOTS):
                    if group[j] == fp and self.keys[self.places[at + j]] == key:
                        return at + j
        return -1

    def get(self, key: bytes) -> list | None:
        slot = self._find(key)
        return None if slot < 0 else self.values[self.places[slot]]

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) >= 0

    def insert(self, key: bytes, value: list) -> None:
        """For a key that is not in the index yet."""
        if self.free:
            place = self.free.pop()
            self.keys[place], self.values[place] = key, value
        else:
            place = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        self.live += 1
        if self.live > 0.9 * self.n * _SLOTS or not self._place(key, place):
            self._grow()

    def _place(self, key: bytes, place: int) -> bool:
        h, fp = self._parts(key)
        first = h & (self.n - 1)
        for b in (first, self._other(first, fp)):
            for at in range(b * _SLOTS, b * _SLOTS + _SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.places[at] = fp, place
                    return True
        bucket = first
        for kick in range(self.max_kicks):
            at = bucket * _SLOTS + kick % _SLOTS
            self.prints[at], fp = fp, self.prints[at]
            self.places[at], place = place, self.places[at]
            bucket = self._other(bucket, fp)
            for at in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.places[at] = fp, place
                    return True
        return False

    def _grow(self) -> None:
        n = self.n
        while True:
            n *= 2
            self.resizes += 1
            self._reset(n)
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        place = self.places[slot]
        self.prints[slot] = 0
        self.keys[place], self.values[place] = None, []
        self.free.append(place)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


_ENTRY = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_ENTRY_SQL = "digest binary, keep_id long, group_size long"


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _entries(index: CuckooIndex, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    found = list(index.items())
    for i in range(0, len(found), rows):
        part = found[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], schema=_ENTRY)


#: Distinct digests that a task's index holds at most before it hands them on.
HELD = 200_000


def _fold(batches: Iterator[pa.RecordBatch], held: int | None = None) -> Iterator[pa.RecordBatch]:
    """(digest, keep_id, group_size, live) rows to one row a digest; a row that is not live deletes its digest, whatever the order.

    A full index is handed on before the next new digest. If the rows come
    sorted by digest nothing of it comes again; otherwise a digest may have
    several partial rows, which a later fold joins.
    """
    held = held or HELD
    index, dead, last = CuckooIndex(), set(), None

    def told() -> Iterator[pa.RecordBatch]:
        for key in dead:
            index.delete(key)
        yield from _entries(index)

    for batch in batches:
        digest, ids, sizes, live = (batch.column(i).to_pylist() for i in range(4))
        for key, i, size, lives in zip(digest, ids, sizes, live, strict=True):
            if index.live + len(dead) >= held and key != last:
                yield from told()
                index, dead = CuckooIndex(), set()
            last = key
            if not lives:
                dead.add(key)
            elif (entry := index.get(key)) is None:
                index.insert(key, [i, size])
            else:
                entry[0], entry[1] = _least(entry[0], i), entry[1] + size
    yield from told()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each text, white space runs taken as one space and null as empty."""
    d = id_text(docs, id_col, text_col)
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    return d.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"))


def _indexed(rows: DataFrame) -> DataFrame:
    return rows.select("digest", "keep_id", "group_size", "live").mapInArrow(_fold, _ENTRY_SQL)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a corpus: digest, keep_id (smallest identifier) and group_size of each live text."""
    return _index_of(digests(docs, id_col, text_col))


def _index_of(rows: DataFrame) -> DataFrame:
    one = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("live"))
    return _merged(_indexed(one).withColumn("live", F.lit(True)))


def _merged(partial: DataFrame) -> DataFrame:
    return _indexed(partial.repartition("digest").sortWithinPartitions("digest"))


def update_index(index: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """A new index: the texts of `deletes` leave it, then those of `inserts` (documents too) join it."""
    rows = index.withColumn("live", F.lit(True))
    if deletes is not None:
        gone = digests(deletes).select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("live"))
        rows = _merged(rows.unionByName(gone.dropDuplicates(["digest"]))).withColumn("live", F.lit(True))
    if inserts is not None:
        rows = _merged(rows.unionByName(build_index(inserts).withColumn("live", F.lit(True)))).withColumn("live", F.lit(True))
    return rows.drop("live")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal and form one group. Null identifiers come
    last when the row to keep is chosen; a group of null identifiers alone keeps
    them all. Rows that repeat an identifier and its text are one document
    twice: both carry the same decision. An empty table gives no rows.
    """
    rows = cut(digests(docs, id_col, text_col))
    groups = _index_of(rows)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
