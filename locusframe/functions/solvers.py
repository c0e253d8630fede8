"""Numeric kernels: constrained least squares, factorisations, assignment and clustering. Plain numpy, no Spark."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    ata, atb = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n + 20):
        w = atb - ata @ x
        free = np.flatnonzero(~passive)
        if not len(free) or w[free].max() <= tol * max(1.0, np.abs(atb).max()):
            break
        passive[free[w[free].argmax()]] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if (s[at] > tol).all():
                x = s
                break
            low = at[s[at] <= tol]
            step = min((x[i] / (x[i] - s[i]) if x[i] != s[i] else 0.0) for i in low)
            x = x + step * (s - x)
            passive[at[x[at] <= tol]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def simplex_ls(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least squares with e >= 0 and sum(e) = 1, by active sets over the multipliers."""
    k = p.shape[1]
    g, d = p.T @ p + 1e-12 * np.eye(k), p.T @ m
    active = np.zeros(k, bool)  # held at 0
    e = np.full(k, 1.0 / k)
    for _ in range(50 * k + 50):
        at = np.flatnonzero(~active)
        n = len(at)
        kkt = np.zeros((n + 1, n + 1))
        kkt[:n, :n], kkt[:n, n], kkt[n, :n] = g[np.ix_(at, at)], 1, 1
        sol = np.linalg.lstsq(kkt, np.r_[d[at], 1.0], rcond=None)[0]
        goal = np.zeros(k)
        goal[at] = sol[:n]
        if (goal[at] >= -1e-12).all():
            e = np.maximum(goal, 0)
            slack = g @ e - d + sol[n]
            worst = np.flatnonzero(active & (slack < -1e-10))
            if not len(worst):
                break
            active[worst[slack[worst].argmin()]] = False
            continue
        down = at[goal[at] < e[at]]
        ratio = e[down] / (e[down] - goal[down])
        step = min(1.0, ratio.min())
        e = e + step * (goal - e)
        active[down[ratio <= step + 1e-15]] = True
        e[active] = 0
    return e / e.sum() if e.sum() > 0 else e


def anneal(p: np.ndarray, m: np.ndarray, seed: int = 1, steps: int = 4000, enough: float = -1.0) -> np.ndarray:
    """Shares that minimise |m - p e|, by simulated annealing on the simplex; it ends at the first cost up to `enough`."""
    rng = np.random.default_rng(seed)
    k = p.shape[1]
    e = np.full(k, 1.0 / k)
    cost = np.linalg.norm(m - p @ e)
    best, least = e, cost
    for i in range(steps):
        if least <= enough:
            break
        heat = (1 - i / steps) ** 2
        x = np.maximum(e + rng.normal(0, 0.3 * heat + 0.003, k) * (rng.random(k) < 0.4), 0)
        if x.sum() <= 0:
            continue
        x /= x.sum()
        c = np.linalg.norm(m - p @ x)
        if c < cost or rng.random() < np.exp(-(c - cost) / (0.05 * heat * max(least, 1e-9) + 1e-12)):
            e, cost = x, c
            if c < least:
                best, least = x, c
    return best


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 0 else 0.0


METHODS = ("QP", "NNLS", "SA")


def fit_one(counts: np.ndarray, p: np.ndarray, method: str = "QP", auto_reduce: bool = False, seed: int = 1) -> np.ndarray:
    """Shares of the signatures (columns of p, each with sum 1) in a catalogue; all 0 for an empty one."""
    total = counts.sum()
    if total <= 0:
        return np.zeros(p.shape[1])
    m = counts / total

    def solve(at: np.ndarray) -> np.ndarray:
        e = np.zeros(p.shape[1])
        x = {"QP": lambda q: simplex_ls(q, m), "NNLS": lambda q: nnls(q, m), "SA": lambda q: anneal(q, m, seed)}[method](p[:, at])
        e[at] = x / x.sum() if x.sum() > 0 else x
        return e

    every = np.arange(p.shape[1])
    e = solve(every)
    if auto_reduce and cosine(m, p @ e) < 0.95:
        for low in np.arange(0.001, 0.502, 0.01):
            at = np.flatnonzero(e >= low)
            if not len(at) or len(at) == np.count_nonzero(e):
                continue
            other = solve(at)
            if cosine(m, p @ other) - cosine(m, p @ e) < 0.01:
                break
            e = other
    return e


def absolute(shares: np.ndarray, total: float, threshold: float = 0.0, kind: str = "absolute") -> np.ndarray:
    e = np.where(shares <= threshold, 0.0, shares)
    return np.round(e * total if kind == "absolute" else e, 6)


def bootstrap(counts: np.ndarray, p: np.ndarray, seed: int, method: str = "QP") -> tuple[np.ndarray, np.ndarray]:
    """Exposure of one multinomial resample of a catalogue to its own total, and the resample."""
    total = int(round(counts.sum()))
    if total <= 0:
        return np.zeros(p.shape[1]), counts
    draw = np.random.default_rng(seed).multinomial(total, counts / counts.sum())
    return fit_one(draw.astype(float), p, method, seed=seed) * total, draw


def suboptimal(counts: np.ndarray, p: np.ndarray, seed: int, factor: float = 1.05) -> np.ndarray:
    """An exposure whose error is within factor times the least one, from a random start of the annealing; all 0 for an empty catalogue."""
    total = counts.sum()
    if total <= 0:
        return np.zeros(p.shape[1])
    m = counts / total
    best = np.linalg.norm(m - p @ simplex_ls(p, m))
    return anneal(p, m, seed, enough=factor * best) * total


def attribute_stepwise(counts: np.ndarray, p: np.ndarray, flag: np.ndarray, loss: float = 0.01, gain: float = 0.05) -> tuple[np.ndarray, float]:
    """Exposure and cosine: of the allowed signatures (flag 1) those go whose removal costs up to `loss` of the cosine; global ones (flag 2) come in that gain over `gain`."""
    allowed, far = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)

    def fitted(at: np.ndarray) -> tuple[np.ndarray, float]:
        e = np.zeros(p.shape[1])
        if len(at):
            e[at] = fit_one(counts, p[:, at]) * counts.sum()
        return e, cosine(counts, p @ e)

    e, now = fitted(allowed)
    kept = np.array([i for i in allowed if fitted(allowed[allowed != i])[1] - now < -loss], int)
    if len(kept):
        e, now = fitted(kept)
    base = kept if len(kept) < len(allowed) else allowed
    more = [i for i in far if fitted(np.sort(np.r_[base, i]))[1] - (now if len(base) else 0.0) > gain]
    if more:
        base = np.sort(np.r_[base, more])
        e, now = fitted(base)
    return (e, now) if len(base) else fitted(allowed)


def attribute_bootstrap(counts: np.ndarray, p: np.ndarray, flag: np.ndarray, seed: int, n: int = 100, share: float = 0.01, by_proportion: bool = False) -> tuple[np.ndarray, float]:
    """Median exposure of the allowed signatures over n resamples, and the cosine; 0 where the exposure is not significantly over a share of the total."""
    from locusframe.functions.tests_of_significance import exceeds

    at, total = np.flatnonzero(flag == 1), counts.sum()
    e = np.zeros(p.shape[1])
    if not len(at) or total <= 0:
        return e, 0.0
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(int(round(total)), counts / total, n)
    reps = np.stack([fit_one(d.astype(float), p[:, at]) * d.sum() for d in draws])
    limit = share * total
    low = (reps < limit).mean(axis=0)
    sd = reps.std(axis=0, ddof=1) if n > 1 else np.zeros(len(at))
    p_value = low if by_proportion else np.array([exceeds(n, m, s, limit) if s > 0 else q for m, s, q in zip(reps.mean(axis=0), sd, low, strict=True)])
    e[at] = np.where(p_value > 0.05, 0.0, np.median(reps, axis=0))
    return e, cosine(counts, p @ e)


def kl(v: np.ndarray, y: np.ndarray) -> float:
    return float((np.where(v > 0, v * np.log(np.maximum(v, 1e-300) / y), 0) - v + y).sum())


def nmf(v: np.ndarray, k: int, seed: int, n_iter: int = 2000, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """W, H and the divergence of multiplicative updates for the Kullback-Leibler divergence."""
    rng = np.random.default_rng(seed)
    v = v + 1e-12
    w, h = rng.random((v.shape[0], k)) * v.max() + 1e-9, rng.random((k, v.shape[1])) + 1e-9
    last = np.inf
    for i in range(n_iter):
        h *= (w.T @ (v / (w @ h + 1e-300))) / w.sum(axis=0)[:, None]
        w *= ((v / (w @ h + 1e-300)) @ h.T) / h.sum(axis=1)
        w, h = np.maximum(w, 1e-16), np.maximum(h, 1e-16)
        if i % 20 == 19:
            now = kl(v, w @ h)
            if last - now < tol * abs(last):
                break
            last = now
    return w, h, kl(v, w @ h)


def bayes_nmf(v: np.ndarray, k0: int, seed: int, prior: str = "L1KL", n_iter: int = 200_000, tol: float = 1e-7, a0: float = 10.0, b: float = 5.0, phi: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """W, H and log posterior of a factorisation with automatic relevance determination; columns of W that the data don't need shrink to 0.

    prior: L1KL (exponential on both), L2KL (half-normal on both) or L1W.L2H
    (exponential on W, half-normal on H).
    """
    rng = np.random.default_rng(seed)
    if prior == "L1W.L2H":
        v = v - v.min()
    v = v + 1e-50
    n, m = v.shape
    w, h = rng.random((n, k0)) * np.sqrt(v.mean() + 1e-12), rng.random((k0, m)) * np.sqrt(v.mean() + 1e-12)
    tiny = 1e-50

    def scale_terms() -> np.ndarray:
        if prior == "L1KL":
            return (w.sum(axis=0) + h.sum(axis=1) + b0) / c
        if prior == "L2KL":
            return (0.5 * (w**2).sum(axis=0) + 0.5 * (h**2).sum(axis=1) + b0) / c
        return (w.sum(axis=0) + 0.5 * (h**2).sum(axis=1) + b0) / c

    c, b0 = {
        "L1KL": (n + m + a0 + 1, np.sqrt((a0 - 1) * (a0 - 2) * v.mean() / k0)),
        "L2KL": ((n + m) / 2 + a0 + 1, 3.14 * (a0 - 1) * v.mean() / (2 * k0)),
        "L1W.L2H": (n + m / 2 + a0 - 1, b),
    }[prior]
    lam = scale_terms()
    for _ in range(n_iter):
        r = v / (w @ h + tiny)
        if prior == "L1KL":
            h *= (w.T @ r) / (w.sum(axis=0)[:, None] + phi / lam[:, None] + tiny)
            w *= ((v / (w @ h + tiny)) @ h.T) / (h.sum(axis=1)[None] + phi / lam[None] + tiny)
        elif prior == "L2KL":
            h *= np.sqrt((w.T @ r) / (w.sum(axis=0)[:, None] + phi * h / lam[:, None] + tiny))
            w *= np.sqrt(((v / (w @ h + tiny)) @ h.T) / (h.sum(axis=1)[None] + phi * w / lam[None] + tiny))
        else:
            h *= (w.T @ r) / (w.sum(axis=0)[:, None] + h / lam[:, None] + tiny)
            w *= ((v / (w @ h + tiny)) @ h.T) / (h.sum(axis=1)[None] + 1 / lam[None] + tiny)
        new = scale_terms()
        change = np.abs(new - lam).max() / np.abs(lam).max()
        lam = new
        if change < tol:
            break
    y = w @ h + tiny
    penalty = ((lam * c) / lam).sum() + c * np.log(lam).sum()
    return w, h, -(kl(v, y) + penalty)


def scale_solution(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W with each column weighted by its signature's contribution, H with each row weighted by its signature's size."""
    return w * h.sum(axis=1), h * w.sum(axis=0)[:, None]


def kept_signatures(w: np.ndarray) -> np.ndarray:
    return np.flatnonzero(w.sum(axis=0) > 1)


def attribute(v: np.ndarray, w: np.ndarray, allowed: np.ndarray | None = None, n_iter: int = 2000) -> np.ndarray:
    """H for fixed W by multiplicative updates; allowed (signatures x samples) masks what may be present."""
    h = np.full((w.shape[1], v.shape[1]), v.mean() + 1e-9)
    if allowed is not None:
        h = h * allowed
    for _ in range(n_iter):
        h *= (w.T @ (v / (w @ h + 1e-50))) / (w.sum(axis=0)[:, None] + 1e-50)
    return h


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            open_ = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, open_ - 1] - u[i0] - v[open_]
            better = cur < low[open_]
            low[open_[better]], way[open_[better]] = cur[better], j0
            j1 = open_[low[open_].argmin()]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def align_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each run (components x K) the column that belongs to each signature of the first, all runs joined nearest first.

    The run nearest to those placed already is matched to their mean, so that
    one odd run does not drag others with it.
    """
    unit = [r / np.maximum(np.linalg.norm(r, axis=0), 1e-12) for r in runs]
    k = unit[0].shape[1]
    order: list[np.ndarray | None] = [None] * len(runs)
    order[0] = np.arange(k)
    mean, placed = unit[0].copy(), 1
    while placed < len(runs):
        best = None
        for i, x in enumerate(unit):
            if order[i] is not None:
                continue
            cost = 1 - (mean / np.maximum(np.linalg.norm(mean, axis=0), 1e-12)).T @ x
            at = cost.argmin(axis=1)
            if len(set(at.tolist())) < k:
                at = assignment(cost)
            total = cost[np.arange(k), at].sum()
            if best is None or total < best[0]:
                best = (total, i, at)
        _, i, at = best
        order[i] = at
        mean = mean + unit[i][:, at]
        placed += 1
    return order


def silhouette(dist: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """(b - a) / max(a, b) of each item; 0 for one alone in its cluster. An item of weight w stands for w equal ones."""
    weight = np.ones(len(label)) if weight is None else np.asarray(weight, float)
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return np.zeros(len(label))
    member = np.zeros((len(label), len(names)))
    member[np.arange(len(label)), at] = weight
    size, total = member.sum(axis=0), dist @ member  # sums of distances to each cluster
    rows = np.arange(len(label))
    a = total[rows, at] / np.maximum(size[at] - 1, 1)
    mean = total / size
    mean[rows, at] = np.inf
    b = mean.min(axis=1)
    most = np.maximum(a, b)
    return np.where((size[at] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)


def _chains(n: int, nearest, merge) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a reducible linkage, lowest first; new clusters are numbered from n on.

    Chains of nearest neighbours: a pair that are each other's nearest is merged
    wherever it is met, so a merge costs a few rows of distances instead of all;
    the merges are put in order of height afterwards. nearest(i) is the row of
    distances of cluster i, infinite to itself and to what is merged away;
    merge(i, j) makes one cluster of both under the name i.
    """
    alive, chain, found = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = nearest(chain[-1])
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        i = chain.pop()
        chain.pop()
        i, j = min(i, j), max(i, j)
        found.append((i, j, float(row[i if row[i] < np.inf else j])))
        merge(i, j)
        alive[j] = False
    # a merge names the least item of each side; in order of height these become clusters
    name, out = list(range(n)), []
    for i, j, h in sorted(found, key=lambda m: m[2]):
        while name[i] < 0:
            i = -name[i] - 1
        while name[j] < 0:
            j = -name[j] - 1
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j], h))
        name[i], name[j] = n + len(out) - 1, -i - 1
    return out


def hclust(dist: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (see _chains) of average linkage. An item of weight w stands for w equal ones."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weight is None else np.asarray(weight, float).copy()

    def merge(i: int, j: int) -> None:
        both = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = both, both
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]

    return _chains(n, d.__getitem__, merge)


def cosine_linkage(unit: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (see _chains) of average linkage of the rows, unit vectors, by cosine distance: the mean over the pairs of two clusters is 1 less the product of their mean vectors, so no distances are held."""
    mean, size, gone = unit.astype(float).copy(), np.ones(len(unit)), np.zeros(len(unit))

    def nearest(i: int) -> np.ndarray:
        row = np.maximum(1 - mean @ mean[i], 0) + gone
        row[i] = np.inf
        return row

    def merge(i: int, j: int) -> None:
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        gone[j] = np.inf

    return _chains(len(unit), nearest, merge)


def cosine_silhouette(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Silhouette of the rows, unit vectors, by cosine distance, from the clusters' sums of vectors; 0 for one alone in its cluster."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return np.zeros(len(label))
    member = np.eye(len(names))[at]
    size, rows = member.sum(axis=0), np.arange(len(label))
    total = size - unit @ (unit.T @ member)
    a = (total[rows, at] - (1 - (unit * unit).sum(axis=1))) / np.maximum(size[at] - 1, 1)
    mean = total / size
    mean[rows, at] = np.inf
    b = mean.min(axis=1)
    most = np.maximum(a, b)
    return np.where((size[at] > 1) & (most > 1e-15), (b - a) / np.where(most > 1e-15, most, 1), 0.0)


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x, from their dot products."""
    x = x - x.mean(axis=0)
    square = (x * x).sum(axis=1)
    d = square[:, None] + square[None] - 2 * x @ x.T
    d = np.sqrt(np.maximum(d, 0, out=d), out=d)
    np.fill_diagonal(d, 0)
    return d


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    members = {i: [i] for i in range(n)}
    for step, (a, b, _) in enumerate(merges[: n - k]):
        members[n + step] = members.pop(a) + members.pop(b)
    label = np.zeros(n, int)
    for g, m in enumerate(sorted(members.values(), key=min)):
        label[m] = g
    return label


def cophenetic(dist: np.ndarray, merges: list[tuple[int, int, float]], weight: np.ndarray | None = None) -> float:
    """Correlation, over all pairs of items, of their distance and the height at which they meet; 1 where either is constant. An item of weight w stands for w equal ones."""
    n = len(dist)
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    height, members = np.zeros((n, n)), {i: [i] for i in range(n)}
    for step, (a, b, h) in enumerate(merges):
        x, y = members.pop(a), members.pop(b)
        height[np.ix_(x, y)] = height[np.ix_(y, x)] = h
        members[n + step] = x + y
    at = np.triu_indices(n, 1)
    w = np.append(weight[at[0]] * weight[at[1]], (weight * (weight - 1) / 2).sum())  # at last the pairs of equal items
    x, y = np.append(dist[at], 0.0), np.append(height[at], 0.0)
    x, y, w = x[w > 0], y[w > 0], w[w > 0]
    if len(w) == 0 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 1.0
    x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
    return float((w * x * y).sum() / np.sqrt((w * x * x).sum() * (w * y * y).sum()))


def bottom_up_groups(x: np.ndarray, size: int) -> np.ndarray:
    """Groups of equal size (the last may be smaller): the first subtree of a dendrogram that has enough items, then those of a dendrogram of the rest."""
    dist = distances(x)
    label, left, g = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left) > size:
        members = {i: [i] for i in range(len(left))}
        for step, (a, b, _) in enumerate(hclust(dist[np.ix_(left, left)])):
            members[len(left) + step] = both = members.pop(a) + members.pop(b)
            if len(both) >= size:
                label[left[both[:size]]] = g
                break
        left, g = np.flatnonzero(label < 0), g + 1
    label[left] = g
    return label
