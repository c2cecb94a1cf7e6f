"""Times single-threaded NumPy and pandas runs of headline queries at $BENCH_SF_DIR, cold and warm, reading the Parquet files each time.

Each function computes what the query of its name returns; `python baseline.py` prints one JSON line like bench.py's. It uses no Spark.
"""

from __future__ import annotations

import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "ARROW_NUM_THREADS"):
    os.environ[_name] = "1"

import hashlib
import json
import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def table(name: str, columns: list[str] | None = None) -> pd.DataFrame:
    return pq.read_table(f"{FOLDER}/{name}.parquet", columns=columns, use_threads=False).to_pandas()


def embeddings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = table("embeddings")
    return e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float), e["label"].to_numpy()


def triplets() -> pd.DataFrame:
    """Anchor, nuisance and state of the test's triplets, with their cosine distances."""
    ids, v, label = embeddings()
    order = np.argsort(ids)
    ids, v, label = ids[order], v[order], label[order]
    t = pd.DataFrame({"a": ids, "y": label})
    t["n"] = t.groupby("y")["a"].shift(-1)
    t = t.dropna()
    t["n"] = t["n"].astype(int)
    t["s"] = (t["a"] + 1) % len(ids)
    place = pd.Series(np.arange(len(ids)), ids)
    t = t[t["s"].isin(place.index)]
    a, n, s = (place[t[c]].to_numpy() for c in "ans")
    t, keep = t[label[s] != t["y"].to_numpy()], label[s] != t["y"].to_numpy()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, n, s = a[keep], n[keep], s[keep]
    return t.assign(d_n=1 - (u[a] * u[n]).sum(1), d_s=1 - (u[a] * u[s]).sum(1), t=t["a"] % 7)


def nested(t: pd.DataFrame, x: np.ndarray) -> float:
    t = t.assign(x=x)
    return t.groupby(["y", "t", "a"])["x"].mean().groupby(["y", "t"]).mean().groupby("y").mean().mean()


def sns_all():
    t = triplets()
    delta = (t["d_s"] - t["d_n"]).to_numpy()
    return nested(t, np.where(delta > 1e-6, 1.0, np.where(np.abs(delta) <= 1e-6, 0.5, 0.0)))


def margin_nested():
    t = triplets()
    return nested(t, ((t["d_s"] - t["d_n"]) / (t["d_s"] + t["d_n"] + 1e-8)).to_numpy())


def motion_scaler_fit():
    _, v, _ = embeddings()
    return np.percentile(np.concatenate([v[:, :4], np.ones((len(v), 1))], 1), [25, 50, 75], axis=0)


def motion_mismatch():
    t = triplets()
    ids, v, _ = embeddings()
    m = np.concatenate([v[:, :4], np.ones((len(v), 1))], 1)
    place = pd.Series(np.arange(len(ids)), ids)
    a, n, s = (m[place[t[c]].to_numpy()] for c in "ans")
    return np.linalg.norm(n - s, axis=1), np.linalg.norm(np.abs(n - a) - np.abs(s - a), axis=1)


def auroc_rank():
    t = triplets()
    d = np.concatenate([t["d_n"], t["d_s"]])
    r = pd.Series(d).rank().to_numpy()
    n = len(t)
    return (r[n:].sum() - n * (n + 1) / 2) / (n * n)


def label_runs():
    e = table("events", ["user_id", "ts", "event_id", "event_type"]).sort_values(["user_id", "ts", "event_id"])
    frame = e.groupby("user_id").cumcount()
    new = (e["event_type"] != e["event_type"].shift()) | (e["user_id"] != e["user_id"].shift())
    return pd.DataFrame({"u": e["user_id"], "run": new.cumsum(), "label": e["event_type"], "f": frame}).groupby(["u", "run"]).agg(label=("label", "first"), start=("f", "min"), end=("f", "max"))


def phase_triplets():
    e = table("events", ["user_id", "ts", "event_id", "event_type", "props"]).sort_values(["user_id", "ts", "event_id"])
    e["frame"] = e.groupby("user_id").cumcount()
    e = e[e["event_type"].isin(["view", "purchase"])].copy()
    k = e["props"].map(lambda p: json.loads(p)["k"])
    e["asset"] = k % 5
    e["sha"] = [hashlib.sha256(f"{u}-{x}".encode()).hexdigest() for u, x in zip(e["user_id"], k)]
    e = e[e.groupby("sha")["event_type"].transform("nunique") == 1]
    both = e.groupby(["user_id", "asset", "event_type"]).size().unstack(fill_value=0)
    keys = both[(both >= 2).all(axis=1)].index
    e = e[pd.MultiIndex.from_frame(e[["user_id", "asset"]]).isin(keys)].sort_values(["frame", "event_id"])
    return e.groupby(["user_id", "asset", "event_type"])["event_id"].agg(lambda x: tuple(x[:2]))


def dependency_groups():
    d = table("documents", ["doc_id", "text"])
    parent = dict.fromkeys(d["doc_id"])
    for i in parent:
        parent[i] = i

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for i, text in zip(d["doc_id"], d["text"]):
        values = [("h", hashlib.sha256((text or "").encode()).digest())] + ([("v", i // 6)] if i % 3 == 0 else [])
        for v in values:
            a, b = find(i), find(first.setdefault(v, i))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in parent]


def covariance_moments():
    return np.cov(embeddings()[1].T, ddof=0)


def region_pool():
    ids, v, y = embeddings()
    w = (ids % 5) / 4.0
    out = {}
    for label in np.unique(y):
        x, o = v[y == label], w[y == label][:, None]
        out[label] = ((o * x).sum(0) / (o.sum() + 1e-8), x.mean(0), ((1 - o) * x).sum(0) / ((1 - o).sum() + 1e-8))
    return out


def retrieval_recall():
    ids, v, y = embeddings()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ranks = []
    for at in range(0, len(u), 512):
        s = np.round(u[at : at + 512] @ u.T, 12)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        own = y[at : at + 512, None] == y[None]
        best = np.where(own, s, -np.inf).max(1, keepdims=True)
        ranks.append((s > best).sum(1) + 1)
    ranks = np.concatenate(ranks)
    return (ranks <= 1).mean(), (ranks <= 5).mean(), (1 / ranks).mean()


def balanced_accuracy_group_macro():
    rows = table("labels").merge(table("documents", ["doc_id", "source", "n_chars"]), on="doc_id")
    rows["p"] = (rows["n_chars"] > 1000).astype(int)
    return rows.assign(hit=rows["quality"] == rows["p"]).groupby(["source", "quality"])["hit"].mean().groupby("source").mean().mean()


def chunks():
    e = table("events", ["ts", "event_type", "value"])
    t = e["ts"].astype("datetime64[us]").astype("int64") / 1e6
    parts = [e.assign(start=(t // 3 - j) * 3)[t < (t // 3 - j) * 3 + 4] for j in (0, 1)]
    return pd.concat(parts).groupby(["event_type", "start"])["value"].agg(["size", "sum"])


QUERIES = (
    sns_all, margin_nested, motion_scaler_fit, motion_mismatch, auroc_rank, label_runs, phase_triplets, region_pool, dependency_groups, covariance_moments, retrieval_recall, balanced_accuracy_group_macro,
    chunks,
)


def main() -> None:
    took: dict[str, dict[str, float]] = {"cold": {}, "warm": {}}
    for kind in took:
        for f in QUERIES:
            began = time.perf_counter()
            f()
            took[kind][f.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "single_thread_seconds", "unit": "sec", "queries": took, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
