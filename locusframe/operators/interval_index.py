"""An index of closed intervals that is broadcast and probed in Arrow batches.

The intervals of a chromosome are parted by length, a class for each power of
two, and each class is sorted by start. Whatever overlaps a probe in a class
starts between the probe's start less the class's greatest length and the
probe's end, a range that two binary searches find; only its first part, up to
the probe's start, can hold an interval that ends too early, and that interval
starts within twice its own length of the probe. A probe costs some thirty
pairs of searches and what it finds, however the intervals lie: one that spans
the whole chromosome is in a class of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of positions without nulls, as whole numbers if it has such."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.int64() if pa.types.is_integer(column.type) else pa.float64()
    return pc.fill_null(column.cast(kind), 0).to_numpy(zero_copy_only=False)


class IntervalIndex:
    def __init__(self, chrom: pa.Array | pa.ChunkedArray, start: pa.Array | pa.ChunkedArray, end: pa.Array | pa.ChunkedArray):
        """Rows with a null, or that end before they start, overlap nothing."""
        s, e = _numbers(start), _numbers(end)
        ok = np.asarray(pc.and_(pc.and_(pc.is_valid(chrom), pc.is_valid(start)), pc.is_valid(end)).to_numpy(zero_copy_only=False), bool) & (s <= e)
        names = np.asarray(chrom.to_pylist(), object)
        self.classes: dict[str, list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]] = {}
        at = np.flatnonzero(ok)
        grade = np.floor(np.log2((e - s)[at] + 1.0)).astype(int)
        for name in dict.fromkeys(names[at]):
            mine = names[at] == name
            for g in np.unique(grade[mine]):
                rows = at[mine & (grade == g)]
                rows = rows[np.argsort(s[rows], kind="stable")]
                self.classes.setdefault(name, []).append(((e - s)[rows].max(), s[rows], e[rows], rows))

    def probe(self, chrom: pa.Array, start: pa.Array, end: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of the probes, row of the index) that overlap, by probe."""
        s, e = _numbers(start), _numbers(end)
        ok = np.asarray(pc.and_(pc.and_(pc.is_valid(chrom), pc.is_valid(start)), pc.is_valid(end)).to_numpy(zero_copy_only=False), bool) & (s <= e)
        coded = pc.dictionary_encode(chrom)
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        left, right = [], []
        for code, name in enumerate(coded.dictionary.to_pylist()):
            rows = np.flatnonzero(ok & (codes == code))
            for longest, starts, ends, ids in self.classes.get(name, ()):
                low, high = np.searchsorted(starts, s[rows] - longest, "left"), np.searchsorted(starts, e[rows], "right")
                n = np.maximum(high - low, 0)
                probe = np.repeat(np.arange(len(rows)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[probe]
                hit = ends[at] >= s[rows][probe]
                left.append(rows[probe[hit]])
                right.append(ids[at[hit]])
        if not left:
            return np.zeros(0, int), np.zeros(0, int)
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((right, left))
        return left[order], right[order]


def indexed_join(left: DataFrame, right: pa.Table, right_schema: StructType, lk: tuple[str, str, str], rk: tuple[str, str, str], how: str = "inner") -> DataFrame:
    """Rows of left with each row of `right`, a table to be broadcast, that overlaps them; how is inner, left or left_semi."""
    shared = left.sparkSession.sparkContext.broadcast(right)
    fields = left.schema.fields if how == "left_semi" else [*left.schema.fields, *(StructField(f.name, f.dataType, True) for f in right_schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        index = IntervalIndex(*(table.column(c) for c in rk))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                few = batch.slice(at, 4096)
                mine, theirs = index.probe(*(few.column(c) for c in lk))
                if how == "left_semi":
                    yield few.take(pa.array(np.unique(mine)))
                    continue
                found = pa.array(theirs)
                if how == "left":
                    lone = np.setdiff1d(np.arange(few.num_rows), mine)
                    mine = np.concatenate([mine, lone])
                    found = pa.concat_arrays([found.cast(pa.int64()), pa.nulls(len(lone), pa.int64())])
                for i in range(0, max(len(mine), 1), 50_000):  # a probe may overlap many
                    own = few.take(pa.array(mine[i : i + 50_000]))
                    other = table.take(found.slice(i, 50_000)).combine_chunks()
                    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in other.columns]
                    yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[f.name for f in fields])

    return left.mapInArrow(run, StructType(fields))
