"""Quantiles by selection against sorted arrays."""

import math

import numpy as np
import pytest
from vicinage.operators import selection

AT = (0.0, 0.1, 0.55, 0.75, 0.9, 1.0)


def found(spark, values, at=AT):
    return [r["value"] for r in selection.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", at).collect()]


def test_quantiles_of_even_tied_and_very_different_values(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 16)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=301), np.repeat([1.0, 2.0, 7.0], 40), np.concatenate([rng.random(50) * 1e-9, [1e300, -1e300, 1.7e308, -1.7e308]]), np.array([4.0])):
        given = [float(v) for v in rng.permutation(x)] + [None, math.nan]
        assert np.allclose(found(spark, given, (0.1, 0.55, 0.9)), np.quantile(x, (0.1, 0.55, 0.9)), rtol=1e-12, atol=0)


def test_absent_and_infinite_values(spark):
    assert found(spark, [None, math.nan]) == [None] * len(AT)
    assert found(spark, [-math.inf, 1.0, 2.0, 3.0, math.inf], (0.0, 0.1, 0.25, 0.5, 0.625, 1.0)) == [-math.inf, -math.inf, 1.0, 2.0, 2.5, math.inf]
    with pytest.raises(ValueError):
        found(spark, [1.0], (1.5,))
