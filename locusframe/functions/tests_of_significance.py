"""Distribution functions and exact tests, in plain numpy and math."""

from __future__ import annotations

import math

import numpy as np


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> tuple[float, float]:
    """p value and conditional maximum-likelihood odds ratio of the table [[a, b], [c, d]]."""
    m, n, k = a + c, b + d, a + b
    lo, hi = max(0, k - n), min(k, m)
    x = np.arange(lo, hi + 1)
    logs = np.array([log_choose(m, int(i)) + log_choose(n, k - int(i)) for i in x])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    at = a - lo
    if alternative == "greater":
        value = p[at:].sum()
    elif alternative == "less":
        value = p[: at + 1].sum()
    else:
        value = p[p <= p[at] * (1 + 1e-7)].sum()
    if a == lo:
        odds = 0.0
    elif a == hi:
        odds = math.inf
    else:  # the mean of the noncentral hypergeometric distribution meets a
        def mean(log_w: float) -> float:
            q = logs + x * log_w
            q = np.exp(q - q.max())
            return float((x * q).sum() / q.sum())

        left, right = -60.0, 60.0
        for _ in range(200):
            mid = (left + right) / 2
            left, right = (mid, right) if mean(mid) < a else (left, mid)
        odds = math.exp((left + right) / 2)
    return float(min(1.0, value)), odds


_SMALL = np.r_[0.0, np.cumsum(np.log(np.arange(1, 1024)))]


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Logarithms of factorials of whole numbers, from a table and beyond it by Stirling's series."""
    x = np.maximum(n, 1023).astype(float)
    far = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 1024, _SMALL[np.minimum(n, 1023)], far)


def fisher_many(a, b, c, d, alternative: str = "two-sided", cells: int = 1 << 20) -> np.ndarray:
    """p values of many tables [[a, b], [c, d]]; about `cells` terms of their distributions are held at a time."""
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    m, n, k = a + c, b + d, a + b
    lo, size = np.maximum(0, k - n), np.minimum(k, m) - np.maximum(0, k - n) + 1
    out = np.empty(len(a))
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, "right")))
        rows = np.arange(at, to)
        starts = np.r_[0, np.cumsum(size[rows])[:-1]]
        r = np.repeat(rows, size[rows])
        x = lo[r] + np.arange(len(r)) - np.repeat(starts, size[rows])
        logs = -(log_factorial(x) + log_factorial(m[r] - x) + log_factorial(k[r] - x) + log_factorial(n[r] - k[r] + x))
        p = np.exp(logs - np.repeat(np.maximum.reduceat(logs, starts), size[rows]))
        if alternative == "greater":
            told = x >= a[r]
        elif alternative == "less":
            told = x <= a[r]
        else:
            told = p <= p[starts + a[rows] - lo[rows]][r - at] * (1 + 1e-7)
        out[at:to] = np.add.reduceat(p * told, starts) / np.add.reduceat(p, starts)
        at = to
    return np.minimum(out, 1.0)


def odds_intervals(a, b, c, d, level: float = 0.95, cells: int = 1 << 20) -> np.ndarray:
    """Conditional maximum-likelihood odds ratio and the ends of its exact interval for many tables [[a, b], [c, d]]: an array of three columns.

    The odds are where the mean of the noncentral hypergeometric distribution
    of the first cell meets a; the ends are where a tail from a on has half of
    1 - level. All tables of a batch are halved at once; about `cells` terms are
    held at a time. A table with an empty margin has the odds nan and the
    interval from 0 to infinity.
    """
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    m, n, k = a + c, b + d, a + b
    lo, hi = np.maximum(0, k - n), np.minimum(k, m)
    out = np.empty((len(a), 3))
    order = np.argsort(hi - lo, kind="stable")
    at, tail = 0, (1 - level) / 2
    while at < len(order):
        most = 1
        while at + most < len(order) and (most + 1) * (hi - lo + 1)[order[at + most]] <= cells:
            most += 1
        i = order[at : at + most]
        at += most
        x = lo[i, None] + np.arange((hi - lo)[i].max() + 1)
        inside = x <= hi[i, None]
        y = np.minimum(x, hi[i, None])
        logs = -sum(log_factorial(v) for v in (y, m[i, None] - y, k[i, None] - y, n[i, None] - k[i, None] + y))
        logs = np.where(inside, logs, -np.inf)

        def solved(value, target: np.ndarray, rises: bool) -> np.ndarray:
            left, right = np.full(len(i), -700.0), np.full(len(i), 700.0)
            for _ in range(70):
                mid = (left + right) / 2
                q = logs + x * mid[:, None]  # noqa: B023
                q = np.exp(q - q.max(axis=1, keepdims=True))
                low = (value(q / q.sum(axis=1, keepdims=True)) < target) == rises
                left, right = np.where(low, mid, left), np.where(low, right, mid)
            return np.exp((left + right) / 2)

        first, last, empty = a[i] == lo[i], a[i] == hi[i], lo[i] == hi[i]
        odds = solved(lambda p: (p * x).sum(axis=1), a[i], True)  # noqa: B023
        lower = solved(lambda p: np.where(x >= a[i, None], p, 0).sum(axis=1), np.full(len(i), tail), True)  # noqa: B023
        upper = solved(lambda p: np.where(x <= a[i, None], p, 0).sum(axis=1), np.full(len(i), tail), False)  # noqa: B023
        out[i, 0] = np.where(empty, np.nan, np.where(first, 0.0, np.where(last, np.inf, odds)))
        out[i, 1], out[i, 2] = np.where(first, 0.0, lower), np.where(last, np.inf, upper)
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    p = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return p if t > 0 else 1 - p


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def welch(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float, float]:
    """t, df and two-sided p; NaN where the groups have no variance or fewer than two values."""
    if n1 < 2 or n2 < 2 or v1 / n1 + v2 / n2 <= 0:
        return math.nan, math.nan, math.nan
    se = v1 / n1 + v2 / n2
    t = (m1 - m2) / math.sqrt(se)
    df = se**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return t, df, 2 * t_tail(abs(t), df)


def exceeds(n: int, mean: float, sd: float, threshold: float) -> float:
    """One-sided one-sample t-test that the mean exceeds the threshold; NaN without variance."""
    if n < 2 or not sd or sd != sd:
        return math.nan
    return t_tail((mean - threshold) / (sd / math.sqrt(n)), n - 1)


def rank_sum(w: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of the rank-sum statistic (ranks of the first group less their least sum); ties is the sum of t^3 - t over tied values.

    Exact for groups under 50 without ties, otherwise normal with the
    corrections for ties and continuity.
    """
    if n1 < 50 and n2 < 50 and ties == 0:
        counts = np.zeros(n1 * n2 + 1)
        counts[0] = 1
        # coefficients of the Gaussian binomial
        for i in range(1, n1 + 1):
            up = n2 + i
            for j in range(n1 * n2, up - 1, -1):
                counts[j] -= counts[j - up]
            for j in range(i, n1 * n2 + 1):
                counts[j] += counts[j - i]
        p = counts / counts.sum()
        low = p[: int(w) + 1].sum() if w <= n1 * n2 / 2 else p[int(w) :].sum()
        return float(min(1.0, 2 * low))
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if sigma == 0:
        return math.nan
    z = w - n1 * n2 / 2
    z = (z - math.copysign(0.5, z) * (z != 0)) / sigma
    return 2 * min(normal_tail(z), normal_tail(-z))


def correlation_p(r: float, n: int) -> float:
    if n < 3 or r != r:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return 2 * t_tail(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) for k means, by numeric integration over the range and the standard deviation."""
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    erf = np.vectorize(math.erf)

    def cdf_known(w: np.ndarray) -> np.ndarray:
        big = 0.5 * (1 + erf(z / math.sqrt(2)))
        low = 0.5 * (1 + erf((z[None] - w[:, None]) / math.sqrt(2)))
        y = k * phi[None] * (big[None] - low) ** (k - 1)
        return np.trapezoid(y, z, axis=1)

    if df > 5000:
        return float(max(0.0, 1 - cdf_known(np.array([q]))[0]))
    s = np.linspace(max(1e-3, 1 - 6 / math.sqrt(df)), 1 + 8 / math.sqrt(df), 161)
    logd = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    dens = np.exp(logd)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(dens * cdf_known(q * s), s) / np.trapezoid(dens, s))))


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    order = np.argsort(-p, kind="stable")
    n = len(p)
    out = np.empty(n)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)))
    return out


def concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Concordant less discordant pairs of points (x, y) of weight c: the sum of c c' sign(x - x') sign(y - y') over pairs, in n log n steps for each bit of n."""
    if len(x) < 2:
        return 0
    (ux, k), r, c = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)[1], np.asarray(c, dtype=np.int64)
    order = np.argsort(k, kind="stable")
    k, r, c, total = k[order], r[order], c[order], 0
    for bit in range(int(r.max()).bit_length()):
        # two y differ in this bit first where all higher bits are equal: one group; those with bit 0 are the lesser y
        o = np.argsort(r >> (bit + 1), kind="stable")
        group, w, high = (r >> (bit + 1))[o], c[o], ((r >> bit) & 1)[o]
        low = np.concatenate([[0], np.cumsum(np.where(high == 0, w, 0))])
        key = group * len(ux) + k[o]
        less = low[np.searchsorted(key, key, "left")] - low[np.searchsorted(group, group, "left")]
        more = low[np.searchsorted(group, group, "right")] - low[np.searchsorted(key, key, "right")]
        total += int((w * high * (less - more)).sum())
    return total
