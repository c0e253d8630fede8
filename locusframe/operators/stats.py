"""Group tests and associations.

Sufficient statistics are one aggregate each; only the small result (a row per
comparison) meets the test kernels, in an Arrow-batched function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from locusframe.functions import tests_of_significance as T


def kernel(fn: Callable[..., float], *cols: Column | str) -> Column:
    """fn applied to the rows of a small result; null in, null out."""

    @F.pandas_udf(DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series, strict=True)], dtype="float64")

    return run(*cols)


def fisher_p(a, b, c, d, alternative: str = "two-sided") -> Column:
    """p value of Fisher's exact test of each row's table, all rows of a batch at once; null in, null out."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        cells = np.column_stack([x.to_numpy(float) for x in (a, b, c, d)])
        ok = ~np.isnan(cells).any(axis=1)
        out = np.full(len(cells), None, object)
        if ok.any():
            out[ok] = T.fisher_many(*cells[ok].T, alternative=alternative)
        return pd.Series(out, dtype="float64")

    return run(a, b, c, d)


def odds_interval(a, b, c, d, level: float = 0.95) -> Column:
    """Conditional odds ratio of each row's table and the ends of its exact interval, as an array of three; null in, null out."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        tables = np.column_stack([x.to_numpy(float) for x in (a, b, c, d)])
        ok = np.flatnonzero(~np.isnan(tables).any(axis=1))
        out = [None] * len(tables)
        if len(ok):
            for i, r in zip(ok, T.odds_intervals(*tables[ok].T, level=level), strict=True):
                out[i] = [None if np.isnan(v) else float(v) for v in r]
        return pd.Series(out, dtype=object)

    return run(a, b, c, d)


def bh_adjust(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within `by`; null p values are left out and stay null."""
    part = [F.col(p).isNull(), *by]
    w = Window.partitionBy(*part).orderBy(F.desc(p))
    n = F.count(p).over(Window.partitionBy(*part))
    # ties take the largest rank: the least of p n / rank over equal and larger p
    rank = n - F.row_number().over(w) + 1
    d = df.withColumn("_q", F.col(p) * n / rank)
    least = F.min("_q").over(Window.partitionBy(*part).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0)))).drop("_q")


def value_ranks(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """counts (by, value, c rows each) with rank, the average rank of the value's rows within `by`.

    Beyond KENDALL_CELLS distinct values these are cut into blocks at quantiles
    (of each group, with `by`); ranks are counted within blocks from the sums of
    the blocks before, so a whole column meets in no task.
    """
    block = "__block"
    n = max(1, min(KENDALL_BLOCKS, -(-counts.count() // KENDALL_CELLS)))
    at = [i / n for i in range(1, n)]
    if n == 1:
        d = counts.withColumn(block, F.lit(0))
    elif by:
        cuts = counts.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), at, 100 * n).alias("__cut"))
        v = F.col(value).cast("double")
        d = counts.join(cuts, list(by)).withColumn(block, F.size(F.filter("__cut", lambda x: x < v)) + F.size(F.filter("__cut", lambda x: x <= v))).drop("__cut")
    else:
        cut = counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", at, 0.2 / n)
        d = counts.withColumn(block, _block(value, sorted(set(cut))))
    own = Window.partitionBy(*by, block).orderBy(value)
    if n == 1:
        d = d.withColumn("__before", F.lit(0))
    else:
        sums = d.groupBy(*by, block).agg(F.sum("c").alias("__c"))  # 2 KENDALL_BLOCKS rows a group at most
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        d = d.join(sums.select(*by, block, before.alias("__before")), [*by, block])
    up_to = F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("rank", F.col("__before") + up_to - (F.col("c") - 1) / 2).drop("__before", block)


def two_groups(df: DataFrame, flag: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n1, m1, v1 (where flag) and n2, m2, v2 (where not) of value, with least and most over both."""
    x, a = F.col(value).cast("double"), F.coalesce(flag, F.lit(False))
    aggs = []
    for k, p in ((1, a), (2, ~a)):
        v = F.when(p, x)
        aggs += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.var_samp(v).alias(f"v{k}")]
    d = df.where(F.col(value).isNotNull())
    return (d.groupBy(*by) if by else d.groupBy()).agg(*aggs, F.min(x).alias("least"), F.max(x).alias("most"))


def welch_columns(stats: DataFrame) -> DataFrame:
    se = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    df = F.pow(se, F.lit(2.0)) / (F.pow(F.col("v1") / F.col("n1"), F.lit(2.0)) / (F.col("n1") - 1) + F.pow(F.col("v2") / F.col("n2"), F.lit(2.0)) / (F.col("n2") - 1))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (se > 0)
    d = stats.withColumns({"t": F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(se)), "df": F.when(ok, df)})
    return d.withColumn("p_value", kernel(lambda t, k: 2 * T.t_tail(abs(t), k), F.col("t"), F.col("df")))


def rank_sum(df: DataFrame, flag: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum statistic w of the flagged group (its rank sum less the least possible), n1, n2 and p_value."""
    f = F.coalesce(flag, F.lit(False))
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"), F.count(F.when(f, 1)).alias("c1"))
    d = value_ranks(per, value, by)
    n1, n2, c = F.sum("c1"), F.sum(F.col("c") - F.col("c1")), F.col("c")
    aggs = [F.coalesce(n1, F.lit(0)).alias("n1"), F.coalesce(n2, F.lit(0)).alias("n2"), (F.sum(F.col("c1") * F.col("rank")) - n1 * (n1 + 1) / 2).alias("w"), F.sum(c * (c * c - 1)).alias("ties")]
    a = (d.groupBy(*by) if by else d.groupBy()).agg(*aggs)
    p = kernel(lambda w, x, y, t: T.rank_sum(w, int(x), int(y), t) if x and y else float("nan"), F.col("w"), F.col("n1"), F.col("n2"), F.col("ties").cast("double"))
    return a.withColumn("p_value", p)


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """k groups, n values, ss_between, ss_within, f and p_value."""
    per = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("c"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value) * (F.count("*") - 1), F.lit(0.0)).alias("w"))
    a = per.agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum("w").alias("ss_within"), F.sum(F.col("c") * F.col("m")).alias("s"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("q"))
    a = a.withColumn("ss_between", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    f = (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("k")))
    a = a.withColumn("f", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ss_within") > 0), f))
    return a.select("k", "n", "ss_between", "ss_within", "f", kernel(lambda x, k, n: T.f_tail(x, k - 1, n - k), F.col("f"), F.col("k").cast("double"), F.col("n").cast("double")).alias("p_value"))


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """g1, g2, diff and p_value of all pairs of groups (Tukey's honest significant differences)."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value) * (F.count("*") - 1), F.lit(0.0)).alias("w"))
    all_ = per.agg(F.count("*").alias("k"), (F.sum("w") / (F.sum("n") - F.count("*"))).alias("ms"), (F.sum("n") - F.count("*")).alias("df"))
    x, y = per.select(F.col(group).alias("g1"), F.col("n").alias("n1"), F.col("m").alias("m1")), per.select(F.col(group).alias("g2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    d = x.join(y, F.col("g1") < F.col("g2")).crossJoin(F.broadcast(all_))  # a row per pair of group names
    q = F.abs(F.col("m2") - F.col("m1")) / F.sqrt(F.col("ms") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return d.select("g1", "g2", (F.col("m2") - F.col("m1")).alias("diff"), kernel(lambda q, k, f: T.studentized_range_tail(q, int(k), f), q, F.col("k").cast("double"), F.col("df").cast("double")).alias("p_value"))


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], rank: bool = False, adjust: str | None = None, drop_constant: bool = False) -> DataFrame:
    """a, b, n, r and p_value of each pair of columns, over rows where both are present (Pearson, or Spearman by rank).

    adjust adds p_adjusted over all pairs: BH or bonferroni. With drop_constant
    columns that do not vary take no part; otherwise their r is null. Columns
    without nulls are ranked once each, others anew for the rows of each pair.
    """
    if adjust not in (None, "BH", "bonferroni"):
        raise ValueError("adjust must be BH or bonferroni")
    if drop_constant or rank:
        names = list(dict.fromkeys([*left, *right]))
        seen = df.agg(F.count("*"), *[F.count(c) for c in names], *[F.min(c) != F.max(c) for c in names]).first()
        whole = {c for c, n in zip(names, seen[1 : len(names) + 1], strict=True) if n == seen[0]}
        if drop_constant:
            varies = {c for c, v in zip(names, seen[len(names) + 1 :], strict=True) if v}
            left, right = ([c for c in x if c in varies] for x in (left, right))
            if not left or not right:
                raise ValueError("no column that varies is left")
    pairs = [(a, b) for a in left for b in right]
    out = None
    if rank and whole.issuperset([*left, *right]):
        d, used = df, list(dict.fromkeys([*left, *right]))
        for i, c in enumerate(used):
            ranks = value_ranks(df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("c")), "v").select(F.col("v").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"))
            d = d.join(ranks, F.col(c) == F.col(f"_v{i}")).drop(f"_v{i}")
        return correlations(d.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(used)]), left, right, adjust=adjust)
    if rank:  # ranks are taken over the rows in which both are present, so each pair is ranked for itself
        for a, b in pairs:
            cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
            ranks = lambda v: value_ranks(cells.groupBy(v).agg(F.sum("c").alias("c")), v).select(v, F.col("rank").alias(f"r{v}"))  # noqa: B023,E731
            d = cells.join(ranks("x"), "x").join(ranks("y"), "y")
            n, total = F.sum("c"), lambda *v: F.sum(F.col("c").cast("double") * v[0] * v[1])
            mid = (F.col("rx"), F.col("ry"))
            both = d.agg(n.alias("n"), *[total(x, F.lit(1.0)).alias(k) for k, x in zip(("sx", "sy"), mid, strict=True)], total(mid[0], mid[1]).alias("xy"), total(mid[0], mid[0]).alias("xx"), total(mid[1], mid[1]).alias("yy"))
            vx, vy = (F.col(q) - F.col(s_) * F.col(s_) / F.col("n") for q, s_ in (("xx", "sx"), ("yy", "sy")))
            r = F.when((vx > 0) & (vy > 0), (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
            one = both.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce("n", F.lit(0)).alias("n"), r.alias("r"))
            out = one if out is None else out.unionByName(one)
    else:
        aggs = []
        for i, (a, b) in enumerate(pairs):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            size = F.stddev_pop(x) * F.stddev_pop(y)
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.when(size > 0, F.covar_pop(x, y) / F.when(size > 0, size)).alias("r")).alias(f"_{i}"))
        one = df.agg(*aggs)
        out = one.select(F.explode(F.array(*[f"_{i}" for i in range(len(pairs))])).alias("x")).select("x.*")
    out = out.withColumn("p_value", kernel(lambda r, n: T.correlation_p(r, int(n)), F.col("r"), F.col("n").cast("double")))
    if adjust == "BH":
        return bh_adjust(out, "p_value", out="p_adjusted")
    return out if adjust is None else out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * F.count("p_value").over(Window.partitionBy(F.lit(1)))))  # a row per pair of columns


#: Distinct (a, b) cells of a block in `kendall`, and blocks of a column at most.
KENDALL_CELLS, KENDALL_BLOCKS = 50_000, 300


def _block(column: str, bounds: Sequence[float]) -> Column:
    """Number of a value's block: odd for the values of a bound itself, even for those between two bounds."""

    @F.pandas_udf(LongType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v, "left") + np.searchsorted(bounds, v, "right"))

    return run(F.col(column).cast("double"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b of two numeric columns; null if one of them does not vary.

    Concordant less discordant pairs come from merge counts over the distinct
    (a, b) cells. Both columns are cut into blocks at quantiles: pairs within a
    block of a are counted there, pairs of different blocks of a in their common
    block of b, and all others from the counts of the grid of blocks. A bound is
    a block of its own, in which nothing is left to count, so a frequent value
    does not fill a task.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    n = max(1, min(KENDALL_BLOCKS, -(-cells.count() // KENDALL_CELLS)))
    cut = cells.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).approxQuantile(["x", "y"], [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [[], []]
    d = cells.withColumns({"xb": _block("x", sorted(set(cut[0]))), "yb": _block("y", sorted(set(cut[1])))})

    def counted(x: str, y: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: pd.DataFrame({"s": [T.concordance(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["c"].to_numpy())]})

    grid = d.groupBy("xb", "yb").agg(F.sum("c").alias("c")).toPandas()  # (2 KENDALL_BLOCKS)^2 rows at most
    across = T.concordance(grid["xb"].to_numpy(), grid["yb"].to_numpy(), grid["c"].to_numpy())
    within = d.where("xb % 2 = 0").groupBy("xb").applyInPandas(counted("x", "y"), "s long")
    within = within.unionByName(d.where("yb % 2 = 0").groupBy("yb").applyInPandas(counted("xb", "y"), "s long"))
    s = within.agg((F.coalesce(F.sum("s"), F.lit(0)) + F.lit(across)).alias("s"))
    tie = lambda k, n: cells.groupBy(k).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(n))
    n0 = cells.agg((F.sum("c") * (F.sum("c") - 1) / 2).alias("n0"))
    d = s.crossJoin(tie("x", "tx")).crossJoin(tie("y", "ty")).crossJoin(n0)
    free = F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))
    return d.select((F.col("s") / F.when(free > 0, free)).alias("tau"))


def group_enrichment(df: DataFrame, groups: Sequence[str], numeric: Sequence[str] = (), logical: Sequence[str] = (), by: Sequence[str] = (), reference: str | None = None, method: str = "t") -> DataFrame:
    """Each level of each group column against all other rows (or against the level `reference`), for each variable.

    grp_var, grp, enrich_var, type (continuous or logical), n1, n2, measure1,
    measure2, measure_observed, statistic, p_value, fdr (within grp_var,
    enrich_var and by), odds, odds_low and odds_high. A logical variable compares
    shares by Fisher's test, with the conditional odds ratio and its exact 95 %
    interval; a numeric one means by Welch's test or, with method wilcox, ranks.
    measure_observed is the ratio of the measures, those of a numeric variable
    taken above the least value compared.
    """
    if method not in ("t", "wilcox"):
        raise ValueError("method must be t or wilcox")
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(g).alias("grp_var"), F.col(g).cast("string").alias("grp")) for g in groups])).alias("g"), *numeric, *logical).select(*by, "g.*", *numeric, *logical).where("grp IS NOT NULL")
    values = [F.struct(F.lit(v).alias("enrich_var"), F.lit("continuous").alias("type"), F.col(v).cast("double").alias("x")) for v in numeric]
    values += [F.struct(F.lit(v).alias("enrich_var"), F.lit("logical").alias("type"), F.col(v).cast("int").cast("double").alias("x")) for v in logical]
    long = long.select(*by, "grp_var", "grp", F.explode(F.array(*values)).alias("v")).select(*by, "grp_var", "grp", "v.*").where("x IS NOT NULL")
    keys = [*by, "grp_var", "enrich_var", "type"]
    # Moments of each level, then those of the other levels pooled around the mean of all, so that large values lose nothing.
    per = long.groupBy(*keys, "grp").agg(F.count("*").alias("n1"), F.sum("x").alias("s1"), F.avg("x").alias("m1"), F.coalesce(F.var_samp("x") * (F.count("*") - 1), F.lit(0.0)).alias("q1"), F.min("x").alias("lo1"))
    w = Window.partitionBy(*keys)
    if reference is None:
        d = per.withColumn("_a", F.avg("m1").over(w)).withColumn("_d", F.col("m1") - F.col("_a"))
        d = d.withColumns({"lo": F.min("lo1").over(w), "n2": F.sum("n1").over(w) - F.col("n1"), "s2": F.sum("s1").over(w) - F.col("s1"), "_e": F.sum(F.col("n1") * F.col("_d")).over(w) - F.col("n1") * F.col("_d")})
        d = d.withColumn("_q", F.sum(F.col("q1") + F.col("n1") * F.col("_d") * F.col("_d")).over(w) - F.col("q1") - F.col("n1") * F.col("_d") * F.col("_d"))
        d = d.withColumns({"m2": F.col("_a") + F.col("_e") / F.col("n2"), "q2": F.greatest(F.lit(0.0), F.col("_q") - F.col("_e") * F.col("_e") / F.col("n2"))})
    else:
        d = per.withColumns({f"{c}2": F.max(F.when(F.col("grp") == reference, F.col(f"{c}1"))).over(w) for c in ("n", "s", "m", "q", "lo")}).where(F.col("grp") != reference)
        d = d.withColumn("lo", F.least("lo1", "lo2"))
    d = d.where("n2 > 0")
    for k in (1, 2):
        n = F.col(f"n{k}")
        d = d.withColumns({f"measure{k}": F.col(f"m{k}"), f"v{k}": F.when(n > 1, F.col(f"q{k}") / (n - 1))})
    se = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    df_ = se * se / (F.pow(F.col("v1") / F.col("n1"), F.lit(2.0)) / (F.col("n1") - 1) + F.pow(F.col("v2") / F.col("n2"), F.lit(2.0)) / (F.col("n2") - 1))
    t = F.when(se > 0, (F.col("measure1") - F.col("measure2")) / F.sqrt(se))
    odds = F.when((F.col("n1") - F.col("s1")) * F.col("s2") != 0, F.col("s1") * (F.col("n2") - F.col("s2")) / ((F.col("n1") - F.col("s1")) * F.col("s2")))
    number = F.col("type") == "continuous"
    least = F.when(number, F.col("lo")).otherwise(0.0)
    d = d.withColumn("measure_observed", F.when(F.col("measure2") != least, (F.col("measure1") - least) / (F.col("measure2") - least)))
    d = d.withColumn("statistic", F.when(number, t).otherwise(odds)).withColumn("_df", F.when(number & (se > 0), df_))
    if method == "wilcox":
        d = d.drop("statistic").join(_level_ranks(long, keys, reference), [*keys, "grp"], "left").withColumn("statistic", F.when(number, F.col("_w")).otherwise(odds))

    def p_of(kind, stat, df1, n1, s1, n2, s2):
        if kind == "logical":
            return T.fisher_many([s1], [n1 - s1], [s2], [n2 - s2])[0]
        return 2 * T.t_tail(abs(stat), df1) if stat == stat and df1 == df1 else float("nan")

    @F.pandas_udf(DoubleType())
    def p_value(kind: pd.Series, stat: pd.Series, df1: pd.Series, n1: pd.Series, s1: pd.Series, n2: pd.Series, s2: pd.Series) -> pd.Series:
        return pd.Series([p_of(*x) for x in zip(kind, stat.astype(float), df1.astype(float), n1, s1, n2, s2, strict=True)], dtype="float64")

    if method == "wilcox":
        ranks = kernel(lambda w, x, y, t: T.rank_sum(w, int(x), int(y), t), F.col("_w"), F.col("n1"), F.col("n2"), F.col("_ties").cast("double"))
        d = d.withColumn("_p", F.when(number, ranks))
    own = F.nanvl(p_value("type", F.col("statistic"), F.col("_df"), "n1", "s1", "n2", "s2"), F.lit(None).cast("double"))
    d = d.withColumn("p_value", F.when(number, F.col("_p")).otherwise(own) if method == "wilcox" else own)
    count = lambda c: F.when(~number, c).cast("double")
    d = d.withColumn("_o", odds_interval(*[count(c) for c in (F.col("s1"), F.col("n1") - F.col("s1"), F.col("s2"), F.col("n2") - F.col("s2"))]))
    told = [F.col("_o")[i].alias(c) for i, c in enumerate(("odds", "odds_low", "odds_high"))]
    return bh_adjust(d, "p_value", keys).select(*keys, "grp", "n1", "n2", "measure1", "measure2", "measure_observed", "statistic", "p_value", "fdr", *told)


def _level_ranks(long: DataFrame, keys: Sequence[str], reference: str | None) -> DataFrame:
    """keys, grp, _w (rank-sum statistic of a level of a numeric variable against the rest or the reference) and _ties."""
    cells = long.where("type = 'continuous'").groupBy(*keys, "grp", "x").agg(F.count("*").alias("c"))
    if reference is None:
        pool = value_ranks(cells.groupBy(*keys, "x").agg(F.sum("c").alias("c")), "x", keys)
        ties = pool.groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("_ties"))
        own = cells.join(pool.select(*keys, "x", "rank"), [*keys, "x"]).groupBy(*keys, "grp").agg(F.sum(F.col("c") * F.col("rank")).alias("_r"), F.sum("c").alias("_n"))
        d = own.join(ties, list(keys))
    else:
        levels = cells.where(F.col("grp") != reference)
        other = levels.select(*keys, "grp").distinct().join(cells.where(F.col("grp") == reference).drop("grp"), list(keys))
        both = levels.withColumn("c1", F.col("c")).unionByName(other.withColumn("c1", F.lit(0).cast("long"))).groupBy(*keys, "grp", "x").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1"))
        r = value_ranks(both, "x", [*keys, "grp"])
        d = r.groupBy(*keys, "grp").agg(F.sum(F.col("c1") * F.col("rank")).alias("_r"), F.sum("c1").alias("_n"), F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("_ties"))
    return d.select(*keys, "grp", (F.col("_r") - F.col("_n") * (F.col("_n") + 1) / 2).alias("_w"), "_ties")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, and the row and column totals of a table of counts."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    return d.withColumns({"row_total": F.sum("n").over(Window.partitionBy("a")), "col_total": F.sum("n").over(Window.partitionBy("b"))})


def pairwise_fisher(df: DataFrame, flag: str, group: str) -> DataFrame:
    """g1, g2, counts, p_value and fdr of a logical variable between all pairs of groups; null where a margin is 0."""
    per = df.where(F.col(group).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(F.col(flag).cast("int")).cast("long").alias("t"), F.sum(1 - F.col(flag).cast("int")).cast("long").alias("f"))
    x, y = per.toDF("g1", "t1", "f1"), per.toDF("g2", "t2", "f2")
    d = x.join(y, F.col("g1") < F.col("g2"))  # a row per pair of group names
    ok = (F.col("t1") + F.col("t2") > 0) & (F.col("f1") + F.col("f2") > 0)
    p = fisher_p(*[F.when(ok, F.col(c)).cast("double") for c in ("t1", "f1", "t2", "f2")])
    return bh_adjust(d.withColumn("p_value", p), "p_value")


def feature_association(df: DataFrame, signatures: Sequence[str], numeric: Sequence[str] = (), logical: Sequence[str] = (), min_n: float = 0.01, rank: bool = False, test: str | Callable[..., float] = "wilcox") -> DataFrame:
    """signature, feature, type, count, measure, p_value and fdr (within type): correlations (Spearman's by rank), and differences of means between a feature's classes.

    test of the classes: wilcox (rank sums), t (Welch), or a function of n1, m1,
    v1, n2, m2, v2 (count, mean and sample variance where the feature holds and
    where not) that returns p; it sees moments, as a column fits no task. Measure
    and p are null if a class is rarer than min_n, a share below 1 or a number.
    """
    if not callable(test) and test not in ("wilcox", "t"):
        raise ValueError("test must be wilcox, t or a function of the moments of two classes")
    out = None
    if numeric:
        c = correlations(df, signatures, numeric, rank)
        out = c.select(F.col("a").alias("signature"), F.col("b").alias("feature"), F.lit("co").alias("type"), F.col("n").alias("count"), F.col("r").alias("measure"), "p_value")
    if logical:  # one pass: the table is read once, each row told for every signature and feature
        cells = lambda names, kind: F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast(kind).alias("v")) for c in names]))
        d = df.select(cells(signatures, "double").alias("s"), *logical).select(F.col("s.name").alias("signature"), F.col("s.v").alias("x"), cells(logical, "boolean").alias("f"))
        d = d.select("signature", F.col("f.name").alias("feature"), "x", F.col("f.v").alias("flag")).where("x IS NOT NULL AND flag IS NOT NULL")
        by = ["signature", "feature"]
        moments = two_groups(d, F.col("flag"), "x", by)
        if test == "wilcox":
            e = moments.join(rank_sum(d, F.col("flag"), "x", by).select(*by, F.col("p_value").alias("p")), by)
        elif test == "t":
            e = welch_columns(moments).withColumnRenamed("p_value", "p")
        else:  # classes of one row have no variance: it is 0 for the function
            told = [F.coalesce(F.col(c), F.lit(0.0)) if c[0] == "v" else F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]
            e = moments.withColumn("p", kernel(test, *[c.cast("double") for c in told]))
        least = min_n * (F.col("n1") + F.col("n2")) if min_n < 1 else F.lit(min_n)
        enough = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("n1") > 0) & (F.col("n2") > 0)
        classes = e.select(*by, F.lit("ca").alias("type"), (F.col("n1") + F.col("n2")).alias("count"), F.when(enough, F.col("m1") - F.col("m2")).alias("measure"), F.when(enough, F.col("p")).alias("p_value"))
        out = classes if out is None else out.unionByName(classes)
    return bh_adjust(out, "p_value", ["type"])


def strand_bias(counts: DataFrame) -> DataFrame:
    """Per sample and component T against U (sample, component, strand, n): totals, enrichment T / U, Fisher's p_value and fdr within the sample."""
    per = counts.groupBy("sample", "component").agg(F.sum(F.when(F.col("strand") == "T", F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("strand") == "U", F.col("n")).otherwise(0)).alias("u"))
    w = Window.partitionBy("sample")
    d = per.withColumns({"t_total": F.sum("t").over(w), "u_total": F.sum("u").over(w)}).withColumn("enrichment", F.when(F.col("u") != 0, F.col("t") / F.col("u")))
    p = fisher_p(*[c.cast("double") for c in (F.col("u_total") - F.col("u"), F.col("t_total") - F.col("t"), F.col("u"), F.col("t"))])
    return bh_adjust(d.withColumn("p_value", p), "p_value", ["sample"])
