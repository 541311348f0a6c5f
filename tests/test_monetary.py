"""The monetary split against every cut tried in exact fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelift.operators import rfm as R


def best_high(values):
    """How many values lie above the best cut between distinct values; of equal cuts the lowest."""
    x = sorted(float(np.log1p(v)) if v > -1 else -1.0 for v in values)
    whole, left, top, high = sum(map(Fraction, x)), Fraction(0), None, 0
    for k in range(1, len(x)):
        left += Fraction(x[k - 1])
        if x[k] > x[k - 1]:
            score = Fraction(k * (len(x) - k)) * (left / k - (whole - left) / (len(x) - k)) ** 2
            if top is None or score > top:
                top, high = score, len(x) - k
    return high


def split(spark, values):
    d = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "Outlet_ID string, AOV double").repartition(3)
    return R.monetary_split(d)


RNG = random.Random(9)
CASES = {
    "values 1e-9 apart": [10.0] * 7 + [10.0 + 1e-8] * 5,
    "three within a cell": [10.0] * 20 + [10.0 + 2e-8] * 20 + [10.0 + 3e-8] * 3,
    "ties at the cut": [1.0] * 30 + [2.0] * 300 + [40.0] * 30 + [2.0 + 1e-9] * 9,
    "a dense cell at the cut": [1.0] * 500 + [3.0 + k * 1e-9 for k in range(200)] + [9.0] * 500,
    "spread": [RNG.lognormvariate(3, 2) for _ in range(400)],
    "two clusters touching": [5 + RNG.random() * 1e-6 for _ in range(300)],
    "losses": [-5.0, -1.0, -0.5, 0.0] * 5 + [100.0] * 7,
}


@pytest.mark.parametrize("name", CASES)
def test_split_is_the_best_cut(spark, name):
    values = CASES[name]
    got = split(spark, values).collect()
    high = [r.AOV for r in got if r.M_label == "High"]
    assert len(high) == best_high(values)
    assert not high or min(high) > max(r.AOV for r in got if r.M_label == "Low")


def test_few_equal_and_no_values(spark):
    few = {r.AOV: r.M_label for r in split(spark, [1.0, 2.0, 2.0 + 1e-9, 8.0, 9.0]).collect()}
    assert few == {1.0: "Low", 2.0: "Low", 2.0 + 1e-9: "High", 8.0: "High", 9.0: "High"}
    assert split(spark, [4.0] * 15).where("M_label = 'High'").count() == 0
    assert [r.M_label for r in split(spark, [None, None]).collect()] == [None, None]
    assert split(spark, [1.0]).limit(0).count() == 0
    assert R.monetary_cut(split(spark, [float(k) for k in range(1, 30)]).where(F.lit(False))).first().n is None
