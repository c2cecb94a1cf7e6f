"""Gradients against differences, and that training lowers the loss."""

import numpy as np
import pytest

from cohortgeo.operators import training as T
from cohortgeo.operators.linalg import Readout, unit_rows


@pytest.mark.parametrize("name", Readout.NAMES)
def test_gradients(name):
    r = np.random.default_rng(1)
    metric = Readout(name, 6, 4, 3)
    for k, v in metric.weights.items():
        metric.weights[k] = v + 0.1 * r.normal(size=v.shape)
    x = [r.normal(size=(9, 6)) for _ in range(3)]
    assert np.allclose(T.forward_backward(metric, x[0])[0], metric(x[0]))
    _, grad = T.margin_loss(metric, *x, margin=0.5)
    assert set(grad) == set(metric.weights)
    for k, v in metric.weights.items():
        for at in list(np.ndindex(v.shape))[:12]:
            e = 1e-6
            old = v[at]
            v[at] = old + e
            up = T.margin_loss(metric, *x, margin=0.5)[0]
            v[at] = old - e
            down = T.margin_loss(metric, *x, margin=0.5)[0]
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def planted(n=400, d=8):
    """The state moves along the first coordinate, the nuisance along the others."""
    r = np.random.default_rng(4)
    a = r.normal(size=(n, d))
    return {
        "anchor": a, "nuisance": a + np.concatenate([np.zeros((n, 1)), r.normal(size=(n, d - 1))], 1), "state": a + np.concatenate([r.normal(size=(n, 1)) + 0.3, np.zeros((n, d - 1))], 1),
        "group": np.array([f"g{i % 20}" for i in range(n)]), "transition": np.array([f"g{i % 20}t{i % 100}" for i in range(n)]),
    }


def test_training_lowers_the_loss_and_repeats():
    data = planted()
    metric, losses = T.fit(data, "positive_diagonal", steps=150, rate=0.05, batch=64)
    assert np.mean(losses[-20:]) < 0.8 * np.mean(losses[:20])
    again, _ = T.fit(data, "positive_diagonal", steps=150, rate=0.05, batch=64)
    assert np.array_equal(metric.weights["scale"], again.weights["scale"])


def test_batches_hold_a_transition_once():
    data = planted()
    i = next(T.batches(data, 64, np.random.default_rng(0)))
    assert len(set(data["transition"][i])) == len(i)


def test_sample_and_metamorphic_rotation(spark):
    r = np.random.default_rng(6)
    q, _ = np.linalg.qr(r.normal(size=(5, 5)))
    x = r.normal(size=(40, 5))
    rows = [(i, i + 1, i + 2, f"g{i % 3}", f"t{i % 7}", x[i].tolist(), x[i + 1].tolist(), x[i + 2].tolist()) for i in range(38)]
    schema = "anchor_observation_id long, nuisance_observation_id long, state_observation_id long, dependency_group_id string, transition_id string, anchor_v array<double>, nuisance_v array<double>, state_v array<double>"
    f = spark.createDataFrame(rows, schema)
    a, b = T.sample(f, 20), T.sample(f.repartition(5), 20)
    assert len(a["anchor"]) == 20 and np.array_equal(a["anchor"], b["anchor"])
    turned = [unit_rows(v @ q) for v in (a["anchor"], a["state"])]
    assert np.allclose((turned[0] * turned[1]).sum(1), (unit_rows(a["anchor"]) * unit_rows(a["state"])).sum(1))
    with pytest.raises(ValueError):
        T.sample(f.limit(0))


def test_probe():
    r = np.random.default_rng(7)
    probe = T.MlpProbe(5, 3, 4, 1)
    x, y = r.normal(size=(11, 5)), r.integers(0, 3, 11)
    keep = (r.random((11, 4)) >= 0.3) / 0.7
    _, grad = probe.loss(x, y, keep)
    for k, v in probe.weights.items():
        for at in np.ndindex(v.shape):
            old = v[at]
            v[at] = old + 1e-6
            up = probe.loss(x, y, keep)[0]
            v[at] = old - 1e-6
            down = probe.loss(x, y, keep)[0]
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    x = r.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # beyond a linear probe
    fitted = T.fit_probe(x, y, np.arange(300) % 30, hidden=32, steps=400, rate=0.02)
    assert (fitted(x).argmax(1) == y).mean() > 0.9


def test_probe_sample(spark):
    f = spark.createDataFrame([(i, [float(i), 1.0], i % 2, f"g{i % 3}") for i in range(20)], "id long, v array<double>, y int, g string")
    a, b = T.probe_sample(f, "id", "v", "y", "g", 7), T.probe_sample(f.repartition(4), "id", "v", "y", "g", 7)
    assert a[0].shape == (7, 2) and np.array_equal(a[0], b[0])
