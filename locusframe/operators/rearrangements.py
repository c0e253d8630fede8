"""Structural rearrangements: class, size, clustering and catalogues.

A rearrangement table has sample, chr1, start1, end1, chr2, start2, end2 and
either svclass or strand1 and strand2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import settled

#: Breakpoints whose segmentation takes its steps together.
BATCH = 2_000_000
#: Rearrangements that a task sorts, and of which it meets both ends at a time; whole samples.
ROWS = 1_500_000
# Size classes of rearrangements.
SIZES = ("<1Kb", "1-10Kb", "10-100Kb", "100Kb-1Mb", "1Mb-10Mb", ">10Mb")
RS_38 = tuple(sorted(f"{c}:{t}:{s}" for c, t, s in product(("clustered", "non-clustered"), ("del", "inv", "tds"), SIZES)) + ["clustered:trans", "non-clustered:trans"])
RS_32 = tuple(c for c in RS_38 if "<1Kb" not in c)
# Components without clustering; a catalogue counts them by their number, from 1.
KINDS = tuple(f"{t}:{s}" for t, s in product(("del", "inv", "tds"), SIZES)) + ("trans",)


def sv_class() -> Column:
    return (
        F.when(F.col("chr1") != F.col("chr2"), "translocation")
        .when(F.col("strand1") != F.col("strand2"), "inversion")
        .when((F.col("strand1") == "-") & (F.col("strand2") == "-"), "tandem-duplication")
        .when((F.col("strand1") == "+") & (F.col("strand2") == "+"), "deletion")
    )


def clean(raw: DataFrame) -> DataFrame:
    """Lower-case headers, svclass where it is absent, chromosomes without prefix."""
    d = raw.toDF(*[c.lower() for c in raw.columns])
    need = [c for c in ("sample", "chr1", "start1", "end1", "chr2", "start2", "end2") if c not in d.columns]
    if need or ("svclass" not in d.columns and not {"strand1", "strand2"} <= set(d.columns)):
        raise ValueError(f"missing columns: {', '.join(need) or 'svclass, or strand1 and strand2'}")
    d = d.withColumns({c: F.regexp_replace(c, "^(?i)chr", "") for c in ("chr1", "chr2")})  # before the class, which compares them
    return d if "svclass" in d.columns else d.withColumn("svclass", sv_class())


def label_size(d: DataFrame) -> DataFrame:
    """sv_size: the size class; null for translocations."""
    n = F.col("end2") - F.col("start1")
    size = F.when(F.col("svclass") == "translocation", None).when(n < 1_000, SIZES[0]).when(n < 10_000, SIZES[1]).when(n < 100_000, SIZES[2]).when(n < 1_000_000, SIZES[3]).when(n <= 10_000_000, SIZES[4]).when(n > 10_000_000, SIZES[5])
    return d.withColumn("sv_size", size)


def breakpoints(d: DataFrame) -> DataFrame:
    """sample, chrom, pos of both ends of each rearrangement."""
    two = [F.struct(F.col(f"chr{k}").alias("chrom"), F.col(f"start{k}").alias("pos")) for k in (1, 2)]
    return d.select("sample", F.inline(F.array(*two)))


def distances(d: DataFrame) -> DataFrame:
    """Breakpoints with dist, the way to the one before on the chromosome; null for the first."""
    w = Window.partitionBy("sample", "chrom").orderBy("pos")
    return breakpoints(d).withColumn("dist", F.col("pos") - F.lag("pos").over(w))


def segment_constant(y: np.ndarray, gamma: float = 25.0, kmin: int = 10) -> list[tuple[int, int, float]]:
    """Piecewise constant fit by least squares with a penalty per segment: (first, end, mean); pieces have kmin values or more.

    gamma is scaled by the variance of successive differences, as for
    standardised data.
    """
    return segment_all([y], gamma, kmin)[0]


def segment_all(series: Sequence[np.ndarray], gamma: float = 25.0, kmin: int = 10) -> list[list[tuple[int, int, float]]]:
    """segment_constant of many series, which take their steps together.

    A start stays for the levels of the open piece at which no other start is
    better. Two starts keep their difference once both are long enough, so a new
    start takes its levels from the others for good, and one without levels
    goes. The levels of a series are a few stretches of the line, some ten in
    noise, so that a step costs the same however long the series is.

    Costs are held against the newest one, sums begin at their start: a distance
    of any size leaves the later steps as sharp as they would be without it.
    """
    out = [[(0, len(y), float(np.mean(y)))] if len(y) else [] for y in series]
    long = sorted((k for k, y in enumerate(series) if len(y) >= 2 * kmin), key=lambda k: -len(series[k]))
    if not long:
        return out
    n = np.array([len(series[k]) for k in long])
    penalty = np.array([gamma * (np.median(np.abs(np.diff(np.asarray(series[k], float)))) * 1.4826 / np.sqrt(2) or 1.0) ** 2 for k in long])
    # values by place: those of all series that are so long, side by side
    width = np.searchsorted(-n, -np.arange(n[0]), "left")
    at = np.r_[0, np.cumsum(width)]
    value, back = np.empty(at[-1]), np.zeros(at[-1], np.int32)  # back: start of the piece that ends with the value
    for g, k in enumerate(long):
        value[at[: n[g]] + g] = series[k]
    last, costs = np.empty((kmin, len(n))), np.full((kmin, len(n)), np.inf)  # values and costs of the last kmin places, by place modulo kmin
    for i in range(kmin - 1):
        last[i] = value[at[i] : at[i + 1]]
    costs[0] = -penalty
    # stretches of levels: series, start, lower and upper bound, cost and sum from the start to kmin places before; sorted by series and level
    own, start, low, high = np.arange(len(n)), np.zeros(len(n), int), np.full(len(n), -np.inf), np.full(len(n), np.inf)
    cost, total = -penalty, np.zeros(len(n))
    first, live = own.copy(), len(n)  # first stretch of each series that is not yet at its end
    for j in range(kmin, n[0] + 1):
        new = j - kmin
        if width[j - 1] < live:
            live = int(width[j - 1])
            keep = int(np.searchsorted(own, live))
            own, start, low, high, cost, total, first = own[:keep], start[:keep], low[:keep], high[:keep], cost[:keep], total[:keep], first[:live]
            last, costs, penalty = last[:, :live].copy(), costs[:, :live].copy(), penalty[:live]
        last[(j - 1) % kmin] = value[at[j - 1] : at[j]]
        if new >= kmin:
            begun = costs[new % kmin][own]
            m = new - start
            level = total / m
            room = begun - cost + total * level + 1e-12 * (np.abs(begun) + np.abs(cost))
            half = np.sqrt(np.maximum(room, 0.0) / m)
            left, right = np.maximum(low, level - half), np.minimum(high, level + half)
            gone = (left >= right) | (room <= 0)
            left, right = np.where(gone, high, left), np.where(gone, high, right)
            # what lies below left and above right goes to the new start
            lows, highs = np.stack([low, left, right], 1).ravel(), np.stack([left, right, high], 1).ravel()
            some = np.flatnonzero(lows < highs)
            mine, taken = some // 3, some % 3 != 1
            whose = own[mine]
            begins = np.ones(len(some), bool)
            begins[1:] = ~(taken[1:] & taken[:-1]) | (whose[1:] != whose[:-1])
            edge = np.flatnonzero(begins)
            low, high = lows[some[edge]], highs[some[np.r_[edge[1:], len(some)] - 1]]
            mine, taken, own = mine[edge], taken[edge], whose[edge]
            start, cost, total = np.where(taken, new, start[mine]), np.where(taken, begun[mine], cost[mine]), np.where(taken, 0.0, total[mine])
            first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        reached = (cost + (last * last).sum(0)[own]) - (total + last.sum(0)[own]) ** 2 / (j - start)
        least = np.minimum.reduceat(reached, first)
        back[at[j - 1] : at[j]] = np.minimum.reduceat(np.where(reached == least[own], start, j), first)
        here = least + penalty
        costs[j % kmin] = here
        costs -= here
        y = last[new % kmin]
        cost, total = cost + (y * y - here)[own], total + y[own]
    for g, k in enumerate(long):
        ends, j = [], int(n[g])
        while j:
            ends.append(j)
            j = int(back[at[j - 1] + g])
        begins = [0, *ends[:0:-1]]
        means = np.add.reduceat(np.asarray(series[k], float), begins) / np.diff([*begins, int(n[g])])
        out[k] = list(zip(begins, ends[::-1], means.tolist(), strict=True))
    return out


def mean_distances(d: DataFrame) -> DataFrame:
    """sample and m, the mean of its distances: the way from the first breakpoint of a chromosome to the last, over the number of steps."""
    per = breakpoints(d).groupBy("sample", "chrom").agg((F.max("pos") - F.min("pos")).alias("way"), F.greatest(F.count("pos") - 1, F.lit(0)).alias("steps"))
    return per.groupBy("sample").agg(F.try_divide(F.sum("way"), F.sum("steps")).alias("m"))


def low_distance_regions(d: DataFrame, factor: float = 0.1) -> DataFrame:
    """Regions (sample, chrom, start_pos, end_pos) in which breakpoints lie closer than factor times the sample's mean distance.

    Breakpoints come sorted; the series of a task are segmented in batches of
    about BATCH values, so a task holds one batch, or one series if that is longer.
    """

    def pieces(held: list[tuple[str, str, np.ndarray]]) -> pa.RecordBatch:
        found = segment_all([np.diff(pos) for _, _, pos in held])
        rows = [(s, c, int(pos[i + 1]), int(pos[j]), mean) for (s, c, pos), got in zip(held, found, strict=True) for i, j, mean in got]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["sample", "chrom", "start_pos", "end_pos", "mean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, key, size = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.StructArray.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())], names=["s", "c"])
            codes = [pc.fill_null(pc.dictionary_encode(names.field(k)).indices, -1).to_numpy(zero_copy_only=False) for k in (0, 1)]
            cuts = np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1
            pos = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                this = (names[int(a)]["s"].as_py(), names[int(a)]["c"].as_py())
                if this != key and parts:
                    held.append((*key, np.concatenate(parts)))
                    size, parts = size + len(held[-1][2]), []
                    if size >= BATCH:
                        yield pieces(held)
                        held, size = [], 0
                key = this
                parts.append(pos[a:b].copy())
        if parts:
            held.append((*key, np.concatenate(parts)))
        if held:
            yield pieces(held)

    line = breakpoints(d).where("pos IS NOT NULL").select(F.col("sample").cast("string"), F.col("chrom").cast("string"), F.col("pos").cast("long"))
    line = line.repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos")
    found = line.mapInArrow(run, "sample string, chrom string, start_pos long, end_pos long, mean double")
    return found.join(mean_distances(d), "sample").where(F.col("mean") < factor * F.col("m")).drop("mean", "m")


def _within(d: DataFrame, regions: DataFrame, chrom: str, pos: str) -> DataFrame:
    """d with _hit: whether it was set or the position lies in a region. Rows and region starts are sorted along the chromosome; a row lies in a region if the furthest end of those begun before reaches it."""
    line = d.select("*", F.col(pos).cast("long").alias("_p"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_to"))
    begun = regions.select("sample", F.col("chrom").alias(chrom), F.col("start_pos").cast("long").alias("_p"), F.lit(0).alias("_kind"), F.col("end_pos").cast("long").alias("_to"))
    w = Window.partitionBy("sample", chrom).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    far = line.unionByName(begun, allowMissingColumns=True).withColumn("_far", F.max("_to").over(w)).where("_kind = 1")
    return far.withColumn("_hit", F.col("_hit") | F.coalesce(F.col("_far") >= F.col("_p"), F.lit(False))).drop("_p", "_kind", "_to", "_far")


def label_clustered(d: DataFrame, row_id: list[str], factor: float = 0.1, regions: DataFrame | None = None) -> DataFrame:
    """clustered or non-clustered: whether an end lies in a region of low distances.

    The two ends are looked up one after the other, so rows keep their place and
    are never put together again; row_id is not needed any more.
    """
    r = settled(low_distance_regions(d, factor)) if regions is None else regions
    hit = _within(_within(d.withColumn("_hit", F.lit(False)), r, "chr1", "start1"), r, "chr2", "start2")
    return hit.withColumn("clustered", F.when(F.col("_hit"), "clustered").otherwise("non-clustered")).drop("_hit")


def _kind() -> Column:
    """The component without clustering."""
    kind = F.when(F.col("svclass") == "deletion", "del").when(F.col("svclass") == "inversion", "inv").when(F.col("svclass") == "tandem-duplication", "tds").when(F.col("svclass") == "translocation", "trans")
    return F.when(kind == "trans", kind).otherwise(F.concat(kind, F.lit(":"), F.col("sv_size")))


def label_rs(d: DataFrame) -> DataFrame:
    """rs38 and rs32 of rearrangements with svclass, sv_size and clustered."""
    name = F.concat(F.col("clustered"), F.lit(":"), _kind())
    return d.withColumns({"rs38": name, "rs32": F.when(~name.contains("<1Kb"), name)})


def by_segments(pos: np.ndarray, edges: np.ndarray, m: np.ndarray, factor: float = 0.1) -> np.ndarray:
    """Whether breakpoints lie in a region of low distances: pieces whose mean is under factor times m, from their second place on. Series begin at edges, the last of which is the end; a place is sorted and may repeat."""
    low = np.zeros(len(pos), bool)
    found = segment_all([np.diff(pos[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    for a, pieces in zip(edges[:-1], found, strict=True):
        for i, j, mean in pieces:
            low[a + i + 1 : a + j + 1] = mean < factor * m[a]
    new = np.r_[True, np.diff(pos) != 0]
    new[edges[:-1]] = True
    runs = np.flatnonzero(new)  # of equal places, all lie in a region or none
    return np.repeat(np.logical_or.reduceat(low, runs), np.diff(np.r_[runs, len(pos)]))


def by_steps(pos: np.ndarray, edges: np.ndarray, m: np.ndarray, times: int = 10) -> np.ndarray:
    """The plain rule: whether the way to the breakpoint before or behind goes more than `times` into m."""
    near = np.r_[False, times * np.diff(pos) < m[1:]]
    near[edges[:-1]] = False
    return near | np.r_[near[1:], False]


def _tallied(t: pa.Table, rule: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """sample, kind, hit and n of the rearrangements of whole samples."""
    codes = pc.dictionary_encode(t["sample"].combine_chunks())
    sample = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
    ends = pa.chunked_array([*t["chr1"].chunks, *t["chr2"].chunks]).combine_chunks()
    chrom = pc.fill_null(pc.dictionary_encode(ends).indices, -1).to_numpy(zero_copy_only=False)
    pos = np.concatenate([pc.fill_null(t[c], 0).to_numpy() for c in ("start1", "start2")])
    series = np.r_[sample, sample].astype(np.int64) * (int(chrom.max()) + 2) + chrom + 1
    at = np.flatnonzero(np.concatenate([pc.is_valid(t[c]).to_numpy() for c in ("start1", "start2")]))
    hit = np.zeros(len(pos), bool)
    if len(at):
        at = at[np.lexsort((pos[at], series[at]))]
        line, series = pos[at], series[at]
        begins = np.r_[0, np.flatnonzero(np.diff(series)) + 1]
        owner = sample[at[begins] % len(sample)]
        edges = np.r_[begins, len(at)]
        turns = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
        way, steps = np.add.reduceat(line[edges[1:] - 1] - line[begins], turns), np.add.reduceat(np.diff(edges) - 1, turns)
        mean = way / np.maximum(steps, 1)  # of a sample's distances; without any there is none to be low
        m = np.repeat(np.repeat(mean, np.diff(np.r_[turns, len(owner)])), np.diff(edges))
        # a sample or chromosome without name lies in no region
        hit[at] = rule(line, edges, m) & (np.r_[sample, sample][at] >= 0) & (chrom[at] >= 0)
    kind = pc.fill_null(t["kind"], 0).to_numpy().astype(np.int64)
    keys, n = np.unique((sample.astype(np.int64) + 1) * 64 + 2 * kind + (hit[: len(sample)] | hit[len(sample) :]), return_counts=True)
    who = keys // 64 - 1
    names = codes.dictionary.take(pa.array(who, mask=who < 0))
    return pa.RecordBatch.from_arrays([names, pa.array(keys % 64 // 2, pa.int32()), pa.array(keys % 2 == 1), pa.array(n, pa.int64())], names=["sample", "kind", "hit", "n"])


def _by_samples(batches: Iterator[pa.RecordBatch], rule: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """_tallied of rows sorted by _key, in batches of whole samples and ROWS rows or little more."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= ROWS:
            cut = int(np.searchsorted(batch.column("_key").to_numpy(), held[-1].column("_key")[-1].as_py(), "right"))
            if cut < batch.num_rows:
                yield _tallied(pa.Table.from_batches([*held, batch.slice(0, cut)]), rule)
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield _tallied(pa.Table.from_batches(held), rule)


def rs_catalogue(d: DataFrame, rule: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = by_segments) -> DataFrame:
    """sample, component and n of rearrangements with svclass and sv_size (38 components), clustered if the rule says so of an end.

    One shuffle of narrow rows deals them by sample; the ends are parted, sorted
    and put together again where they are, ROWS rearrangements at a time or one
    sample, if that has more. Rows are counted first: a task sorts some ROWS
    or one sample, however few or many partitions the session has.
    """
    kinds = F.array(*map(F.lit, KINDS))
    rows = d.select(F.col("sample").cast("string"), F.array_position(kinds, _kind()).cast("byte").alias("kind"), F.col("chr1").cast("string"), F.col("start1").cast("long"), F.col("chr2").cast("string"), F.col("start2").cast("long"))
    least, spark = -(-d.count() // ROWS), d.sparkSession
    # of many partitions Spark would merge some beyond ROWS, and a reading task would hold its rows to sort them by partition
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(least, "sample") if least > few else rows.repartition("sample")
    rows = dealt.withColumn("_key", F.xxhash64("sample")).sortWithinPartitions("_key")
    found = rows.mapInArrow(lambda batches: _by_samples(batches, rule), "sample string, kind int, hit boolean, n long").where("kind > 0")
    name = F.concat(F.when(F.col("hit"), "clustered:").otherwise("non-clustered:"), F.element_at(kinds, F.col("kind")))
    return found.select(F.col("sample").cast(d.schema["sample"].dataType), name.alias("component"), "n")


def without_smallest(catalogue: DataFrame) -> DataFrame:
    """The 32 components of a catalogue of 38."""
    return catalogue.where(~F.col("component").contains("<1Kb"))
