"""Sign-constrained ridge by active sets: against trying every set, and by the conditions of an optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelift.operators import fit as X


def problems(B, p, seed, rows=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(B, rows, p)) + 0.8 * rng.normal(size=(B, rows, 1))
    y = np.einsum("brp,bp->br", x, rng.normal(size=(B, p))) + rng.normal(size=(B, rows))
    x -= x.mean(axis=1, keepdims=True)
    return np.einsum("bri,brj->bij", x, x) / rows, np.einsum("bri,br->bi", x, y) / rows, rng


@pytest.mark.parametrize("p", [1, 3, 7, 10])
def test_active_sets_equal_every_set(p):
    C, c, rng = problems(60, p, p)
    lam = rng.choice([1e-3, 0.1, 1.0, 50.0], 60)
    for signs in (np.ones(p), -np.ones(p), rng.choice([-1, 0, 1], p)):
        assert np.allclose(X._active(C, c, lam, signs), X._enumerated(C, c, lam, signs), atol=1e-8)


@pytest.mark.parametrize("p", [20, 40])
def test_conditions_of_an_optimum(p):
    C, c, rng = problems(200, p, p, rows=60)
    lam, signs = rng.choice([0.01, 1.0], 200), rng.choice([-1, 0, 1, 1], p)
    w = X.solve_signed(C, c, lam, signs)
    slope = c - np.einsum("bij,bj->bi", C, w) - lam[:, None] * w
    assert (w * signs >= 0).all() and (w == 0).any()
    assert np.abs(slope[:, signs == 0]).max(initial=0) < 1e-8 and np.abs(slope * w).max() < 1e-7
    assert ((slope * signs)[:, signs != 0][w[:, signs != 0] == 0] <= 1e-8).all()


def test_dependent_and_flat_columns_without_a_penalty():
    C, c, _ = problems(20, 8, 3)
    C[:, 5], C[:, :, 5], c[:, 5] = C[:, 4], C[:, :, 4], c[:, 4]
    C[:, 5, 5], C[:, 4, 5], C[:, 5, 4] = C[:, 4, 4], C[:, 4, 4], C[:, 4, 4]
    C[:, 7], C[:, :, 7], c[:, 7] = 0.0, 0.0, 0.0
    lam, signs = np.zeros(20), np.array([1, -1, 1, 1, 1, 1, 0, 1])
    value = lambda w: np.einsum("bi,bij,bj->b", w, C, w) - 2 * (c * w).sum(axis=1)
    got = X._active(C, c, lam, signs)
    assert np.allclose(value(got), value(X._enumerated(C, c, lam, signs)), atol=1e-8) and (got[:, 7] == 0).all()
    assert X._active(C[:0], c[:0], lam[:0], signs).shape == (0, 8)


def test_twenty_features_per_group(spark):
    names = [f"x{i}" for i in range(20)]
    d = spark.range(600).select((F.col("id") % 3).alias("g"), *[(F.rand(i + 1) * 4).alias(n) for i, n in enumerate(names)])
    d = d.withColumn("y", 3 * F.col("x0") - 2 * F.col("x1") + 5 * F.col("x2"))
    rows = X.constrained_ridge(d, ["g"], "y", {n: 1 for n in names}, 0.001).collect()
    assert len(rows) == 3
    for r in rows:
        coefs = np.array([r[f"coef_{n}"] for n in names])
        assert (coefs >= 0).all() and (coefs == 0).any()
