"""What has no cap: long secrets and deep brackets, many labelled rows, many equal items; and plain versions of the learners."""

import random
import time

import numpy as np
import pytest

from locusframe.llm import decontaminate, labelled, quality, secrets, toxicity

WORTH = "k3Jx9Qz7Lm2Pw8Rt5Vy"


def literal(text):
    return [text[s:e] for s, e, k in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 60])
def test_brackets_of_any_depth(depth):
    text = "secret: {" + "a: {" * depth + f'value: "{WORTH}"' + "}" * (depth + 1)
    assert literal(text) == [WORTH]
    blocks = "secret:\n" + "".join("  " * (i + 1) + f"k{i}:\n" for i in range(depth)) + "  " * (depth + 1) + f"value: {WORTH}\n"
    assert literal(blocks) == [WORTH]
    assert literal(blocks + f"other: {WORTH}\n") == [WORTH]  # what stands beside it inherits nothing


@pytest.mark.parametrize("more", [0, 40, 80, 500, 5000])
def test_names_of_any_length(more):
    assert WORTH in literal(f'secret{"x" * more} = "{WORTH}"')
    assert WORTH in literal(f'"secret{"x" * more}": "{WORTH}"')
    assert WORTH in literal(f"<secret{'x' * more}> {WORTH}\n</secret{'x' * more}>")
    assert WORTH in literal(f'{{"{"a " * more}secret": "{WORTH}"}}')


@pytest.mark.parametrize("text", [f"setenv API_SECRET {WORTH}", f'define("DB_PASSWORD", "{WORTH}")', f'{{"my secret": "{WORTH}"}}', f'secret: str = "{WORTH}"', f'<set name="secret" value="{WORTH}"/>', f'<secret x="1">{WORTH}</secret>'])
def test_targets_of_every_kind(text):
    assert WORTH in literal(text)


def test_long_literals_are_scored_whole():
    rnd = random.Random(1)
    noise = "".join(rnd.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=4000))
    ends = [secrets.literals(f'secret = "{v}"') for v in ("a" * 4096 + noise, (noise + "a" * 4096))]
    assert all(len(x) == 1 for x in ends) and ends[0][0][2] == ends[1][0][2]


@pytest.mark.parametrize("shape", ['password="abc"<a>x{}', '{}secret{}= "a"', "<secret{}", "secret: {{{}", "key {} key", "passpass{}", '"secret{}', "setenv {}", "<key>{}<key>", "token = |\n{}x"])
@pytest.mark.parametrize("fill", [" ", "key", "{ ", "<key ", "'"])
def test_secrets_in_linear_time(shape, fill):
    took = []
    for n in (10_000, 160_000):
        text = "password = 'x'\n" + shape.replace("{{", "\0").replace("{}", fill * (n // len(fill))).replace("\0", "{")
        began = time.perf_counter()
        secrets.scan(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.3  # 256 times if quadratic


def test_labelled_rows_are_bounded(spark):
    rnd = random.Random(2)
    docs = [(0, f"text {i}") for i in range(300)] + [(0, "the same")] * 50 + [(i, f"doc {i}") for i in range(1, 30)] + [(None, "x"), (3, None)]
    d = spark.createDataFrame(rnd.sample(docs, len(docs)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    whole = labelled.training_texts(d, labels, "quality", 10_000).collect()
    assert len(whole) > 350 and all(r.y == (1 if r.doc_id == 0 else r.doc_id % 2) for r in whole)
    for bound in (1, 17, 200, 352):
        got = [labelled.training_texts(x, labels, "quality", bound).collect() for x in (d, d.repartition(7))]
        assert len(got[0]) == bound and sorted(map(repr, got[0])) == sorted(map(repr, got[1])) and set(map(repr, got[0])) <= set(map(repr, whole))


def test_equal_short_items_cost_once():
    words = [f"w{i % 12}".encode() for i in range(3000)]
    items = [(str(i), b" ".join(words[:12])) for i in range(3000)]
    m = decontaminate.Matcher(items)
    began = time.perf_counter()
    hits, found = m.spans(words)
    assert time.perf_counter() - began < 0.1 and decontaminate.united(hits) == [(0, 3000)] and len(found) == 3000 and len(hits) <= 3000
    m = decontaminate.Matcher([(str(i), b" ".join(words[:40])) for i in range(500)])
    began = time.perf_counter()
    assert len(m.spans(words)[1]) == 500 and time.perf_counter() - began < 0.1


def plain_grow(x, y, trees, depth, bins, rate, ridge):
    """Boosting by trying every bound of every feature for every node; scores of the rows."""
    prior = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [np.arange(len(y))]
        for _ in range(depth):
            split = []
            for rows in leaves:
                best = (1e-9, None)
                for j, cs in enumerate(cuts):
                    for c in cs:
                        left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
                split += best[1] or (rows, rows[:0])
            leaves = split
        for rows in leaves:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_grow_as_by_trial(seed):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(80, 2)), rng.integers(0, 3, 80)]
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=80) > 0).astype(float)
    options = {"trees": 4, "depth": 3, "bins": 8, "rate": 0.4, "ridge": 1.0}
    assert np.allclose(quality.grow(x, y, **options).score(x), plain_grow(x, y, **options), atol=1e-9)


def test_toxicity_fit_is_at_the_least_loss():
    rng = np.random.default_rng(4)
    x = (rng.random((120, 6)) < 0.4).astype(np.float32)
    y = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(size=120) > 0.8).astype(float)
    change = np.zeros((6, 6))
    change[0, 0] = 0.5  # a group term that swaps change
    weight = np.where(y > 0, 0.3 / y.mean(), 0.7 / (1 - y.mean())) / len(y)

    def loss(w, b, fair):
        m = x @ w + b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * ridge * w @ w + fair * w @ change @ w)

    ridge, held = 0.01, {}
    for fair in (0.0, 2.0):
        w, b = toxicity.fit(x, y, change, steps=4000, fair=fair, ridge=ridge)
        for i in range(7):
            for step in (-1e-3, 1e-3):
                v = w + step * (np.arange(6) == i)
                assert loss(v, b + step * (i == 6), fair) > loss(w, b, fair) - 1e-7
        held[fair] = abs(w[0])
    assert held[2.0] < 0.7 * held[0.0]
