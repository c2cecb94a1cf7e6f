"""Training of metric readouts by the margin triplet loss (L6, L8), in numpy on the driver.

The triplets come from a bounded sample of training rows (`most`, by a hash of their ids, so the same at each run): readouts have at most
some hundred thousand weights, and rows beyond that bound change little. A batch draws dependency groups uniformly, then a transition of
each, then one of its triplets; a transition stands at most once in a batch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortgeo.operators.linalg import Readout, _ERF, _layer_norm

MOST = 50_000


def sample(gathered: DataFrame, most: int = MOST) -> dict[str, np.ndarray]:
    """Vectors of anchor, nuisance and state, and each triplet's group and transition, of at most `most` triplets."""
    roles = ("anchor", "nuisance", "state")
    mark = F.xxhash64(*[F.col(f"{r}_observation_id").cast("string") for r in roles])
    rows = gathered.orderBy(mark, *[f"{r}_observation_id" for r in roles]).limit(most).select("dependency_group_id", "transition_id", *[f"{r}_v" for r in roles]).collect()
    if not rows:
        raise ValueError("there is no triplet to train on")
    out = {r: np.array([row[f"{r}_v"] for row in rows], float) for r in roles}
    out["group"] = np.array([str(row["dependency_group_id"]) for row in rows])
    out["transition"] = np.array([f"{row['dependency_group_id']}\x1f{row['transition_id']}" for row in rows])
    return out


def forward_backward(metric: Readout, x: np.ndarray, upstream=None):
    """Unit rows of the readout; with `upstream` (their gradient) also the gradient of each weight."""
    p, name = metric.weights, metric.name
    kept: dict[str, np.ndarray] = {}
    if name == "identity":
        y = x
    elif name == "positive_diagonal":
        y = x * (np.log1p(np.exp(p["scale"])) + 1e-6)
    else:
        kept["norm"] = _layer_norm(x, 1.0, 0.0)
        kept["h"] = kept["norm"] * p["gain"] + p["bias"]
        if name == "linear_residual":
            z = kept["h"] @ p["w"].T + p["c"]
        else:
            kept["a"] = kept["h"] @ p["down"].T + p["c"]
            kept["phi"] = 0.5 * (1 + _ERF(kept["a"] / math.sqrt(2)))
            kept["r"] = kept["a"] * kept["phi"]
            z = kept["r"] @ p["up"].T + p["e"]
        kept["z"] = z
        y = z if name == "non_residual_mlp" else x + p["alpha"] * z
    size = np.linalg.norm(y, axis=1, keepdims=True)
    u = y / size
    if upstream is None:
        return u, {}
    gy = (upstream - u * (u * upstream).sum(1, keepdims=True)) / size
    g: dict[str, np.ndarray] = {}
    if name == "positive_diagonal":
        g["scale"] = (gy * x).sum(0) / (1 + np.exp(-p["scale"]))
    elif name != "identity":
        if "alpha" in p:
            g["alpha"] = np.array([(gy * kept["z"]).sum()])
        gz = gy * p["alpha"] if "alpha" in p else gy
        if name == "linear_residual":
            g["w"], g["c"], gh = gz.T @ kept["h"], gz.sum(0), gz @ p["w"]
        else:
            g["up"], g["e"] = gz.T @ kept["r"], gz.sum(0)
            a = kept["a"]
            ga = (gz @ p["up"]) * (kept["phi"] + a * np.exp(-a * a / 2) / math.sqrt(2 * math.pi))
            g["down"], g["c"], gh = ga.T @ kept["h"], ga.sum(0), ga @ p["down"]
        g["gain"], g["bias"] = (gh * kept["norm"]).sum(0), gh.sum(0)
    return u, g


def margin_loss(metric: Readout, anchor: np.ndarray, nuisance: np.ndarray, state: np.ndarray, margin: float = 0.1):
    """Mean hinge of margin + d_n - d_s, and the gradient of each weight."""
    if not 0 <= margin <= 2:
        raise ValueError("margin must be in [0, 2]")
    a, n, s = (forward_backward(metric, v)[0] for v in (anchor, nuisance, state))
    hinge = margin - (a * n).sum(1) + (a * s).sum(1)
    on = (hinge > 0)[:, None] / len(anchor)
    total: dict[str, np.ndarray] = {}
    for x, up in ((anchor, (s - n) * on), (nuisance, -a * on), (state, a * on)):
        for k, v in forward_backward(metric, x, up)[1].items():
            total[k] = total.get(k, 0) + v
    return float(np.maximum(hinge, 0).mean()), total


def batches(data: dict[str, np.ndarray], size: int, rng: np.random.Generator):
    """Endless index arrays."""
    by: dict[str, dict[str, np.ndarray]] = {}
    for i, (g, t) in enumerate(zip(data["group"], data["transition"])):
        by.setdefault(g, {}).setdefault(t, []).append(i)
    groups = sorted(by)
    order = {g: sorted(by[g]) for g in groups}
    while True:
        seen, out = set(), []
        for g in rng.integers(0, len(groups), 4 * size):
            names = order[groups[g]]
            t = names[rng.integers(0, len(names))]
            if t not in seen:
                seen.add(t)
                rows = by[groups[g]][t]
                out.append(rows[rng.integers(0, len(rows))])
                if len(out) == size:
                    break
        yield np.array(out)


def fit(data: dict[str, np.ndarray], name: str, bottleneck: int = 256, margin: float = 0.1, steps: int = 200, rate: float = 3e-4, decay: float = 1e-4, batch: int = 512, seed: int = 20260820) -> tuple[Readout, list[float]]:
    """AdamW; the trained readout and the loss of each step. The same seed gives the same weights."""
    metric = Readout(name, data["anchor"].shape[1], bottleneck, seed)
    first = {k: np.zeros_like(v) for k, v in metric.weights.items()}
    second = {k: np.zeros_like(v) for k, v in metric.weights.items()}
    losses = []
    draw = batches(data, batch, np.random.default_rng(seed))
    for step in range(1, steps + 1):
        i = next(draw)
        loss, grad = margin_loss(metric, data["anchor"][i], data["nuisance"][i], data["state"][i], margin)
        losses.append(loss)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w = metric.weights[k]
            metric.weights[k] = w * (1 - rate * decay) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return metric, losses


class MlpProbe:
    """X11: one hidden layer with GELU and softmax over classes 0 to C - 1."""

    def __init__(self, dimension: int, classes: int, hidden: int = 256, seed: int = 0):
        r = np.random.default_rng(seed)
        self.weights = {
            "down": r.uniform(-1, 1, (hidden, dimension)) / math.sqrt(dimension), "c": np.zeros(hidden),
            "up": r.uniform(-1, 1, (classes, hidden)) / math.sqrt(hidden), "e": np.zeros(classes),
        }

    def loss(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and gradients; keep: dropout mask of the hidden layer, scaled."""
        p = self.weights
        a = x @ p["down"].T + p["c"]
        phi = 0.5 * (1 + _ERF(a / math.sqrt(2)))
        h = a * phi * (1 if keep is None else keep)
        z = h @ p["up"].T + p["e"]
        z = z - z.max(1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        rows = np.arange(len(y))
        gz = q.copy()
        gz[rows, y] -= 1
        gz /= len(y)
        ga = (gz @ p["up"]) * (1 if keep is None else keep) * (phi + a * np.exp(-a * a / 2) / math.sqrt(2 * math.pi))
        return float(-np.log(q[rows, y]).mean()), {"up": gz.T @ h, "e": gz.sum(0), "down": ga.T @ x, "c": ga.sum(0)}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        a = x @ p["down"].T + p["c"]
        return (a * 0.5 * (1 + _ERF(a / math.sqrt(2)))) @ p["up"].T + p["e"]


def fit_probe(x: np.ndarray, y: np.ndarray, group: np.ndarray, hidden: int = 256, steps: int = 300, rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.1, batch: int = 256, seed: int = 20260820) -> MlpProbe:
    """AdamW; a batch draws groups uniformly, then an observation of each."""
    probe, rng = MlpProbe(x.shape[1], int(y.max()) + 1, hidden, seed), np.random.default_rng(seed)
    members = [np.flatnonzero(group == g) for g in np.unique(group)]
    first = {k: np.zeros_like(v) for k, v in probe.weights.items()}
    second = {k: np.zeros_like(v) for k, v in probe.weights.items()}
    for step in range(1, steps + 1):
        i = np.array([m[rng.integers(0, len(m))] for m in (members[g] for g in rng.integers(0, len(members), batch))])
        _, grad = probe.loss(x[i], y[i], (rng.random((batch, hidden)) >= dropout) / (1 - dropout))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            probe.weights[k] = probe.weights[k] * (1 - rate * decay) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return probe


def probe_sample(rows: DataFrame, key: str, vector: str, label: str, group: str, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and groups of at most `most` rows, those of least hash."""
    taken = rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most).select(vector, label, group).collect()
    if not taken:
        raise ValueError("there is no row to train on")
    return np.array([r[0] for r in taken], float), np.array([r[1] for r in taken], int), np.array([str(r[2]) for r in taken])
