"""Preprocessing, registration and weight names."""

import numpy as np
import pandas as pd
import pytest

from cohortgeo.functions import pixels as P


def test_resize():
    x = np.arange(12, dtype=float).reshape(1, 3, 4, 1)
    assert np.allclose(P.resize_bilinear(x, 3, 4), x)
    assert np.allclose(P.resize_bilinear(x, 6, 8).mean(), x.mean())
    line = P.resize_bilinear(np.array([0.0, 1.0]).reshape(1, 1, 2, 1), 1, 4).ravel()
    assert np.allclose(line, [0, 0.25, 0.75, 1])


def test_preprocess():
    out = P.preprocess(np.full((1, 720, 1280, 3), 255, np.uint8))
    assert out.shape == (1, 384, 384, 3) and out.dtype == np.float32
    assert np.allclose(out[0, 0, 0], (1 - np.array(P.MEAN)) / P.DEVIATION, atol=1e-6)
    for bad in (np.zeros((2, 4, 4, 3)), np.zeros((1, 4, 4)), np.zeros((1, 4, 4, 4))):
        with pytest.raises(ValueError):
            P.preprocess(bad)


def test_phase_shift():
    a = np.random.default_rng(0).normal(size=(32, 48))
    for shift in ((3, -5), (0, 0), (-7, 11)):
        assert P.phase_shift(a, np.roll(a, shift, (0, 1))) == shift


def test_clean_state():
    given = {"module.backbone.a": 1, "b": 2}
    assert P.clean_state(given) == {"a": 1, "b": 2} and "module.backbone.a" in given
    with pytest.raises(ValueError):
        P.clean_state({"module.a": 1, "a": 2})


def test_seam(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 5)], "observation_id string, size int")
    use = lambda row, x: pd.DataFrame({"observation_id": [row["observation_id"]], "pixels": [int(x.size)]})
    got = P.map_decoded(rows, lambda row: np.zeros((1, row["size"], row["size"], 3)), use, "observation_id string, pixels long").collect()
    assert sorted(map(tuple, got)) == [("a", 12), ("b", 75)]
