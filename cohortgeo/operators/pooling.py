"""Region pooling over token tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortgeo.functions import boxes as B
from cohortgeo.operators.linalg import summed


def box_occupancy(boxes: DataFrame, key: str = "observation_id", frame: str = "frame", crop: int = B.CROP, patch: int = B.PATCH, tubelet: int = B.TUBELET) -> DataFrame:
    """(key, t, i, j, occupancy) of cells that a box touches, the mean over a tubelet's frames. No pixel is made: only cells that the
    box spans are listed. boxes: key, frame (from 0), box struct in the crop; a still image has `tubelet` 1."""
    if crop % patch:
        raise ValueError("the crop must be whole cells")
    box = F.col("box")
    last = crop // patch - 1
    span = lambda lo, size: F.sequence(
        F.greatest(F.lit(0), F.floor(F.floor(lo) / patch)).cast("int"), F.least(F.lit(last), F.floor((F.ceil(lo + size) - 1) / patch)).cast("int")
    )
    cells = (
        boxes.where(box.isNotNull())
        .select(key, F.floor(F.col(frame) / tubelet).alias("t"), "box", F.explode(span(box["y"], box["h"])).alias("i"))
        .select(key, "t", "box", "i", F.explode(span(box["x"], box["w"])).alias("j"))
    )
    return cells.groupBy(key, "t", "i", "j").agg((F.sum(B.cell_overlap(box, F.col("i"), F.col("j"), patch)) / tubelet).alias("occupancy"))


def region_pools(
    tokens: DataFrame, key: str = "observation_id", vector: str = "embedding", weight: str = "occupancy", least_mass: float = 1.0, epsilon: float = 1e-8, mask: str | None = None
) -> DataFrame:
    """(key, mass, context_mass, tokens, box, full, context) pools from one pass over a token table; with `mask`, the column
    of another weight, also mask_mass and the pool `mask`.

    Weights are clamped to [0, 1]. A mass under `least_mass` gives a null pool and a `reason`, never a zero vector; a weight that isn't finite
    raises. Tasks add up whole vectors by observation before anything is dealt.
    """
    def clamped(name: str):
        w = F.col(name).cast("double")
        bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("occupancy must be finite")).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))

    weighed = tokens.select(F.col(key).alias("k"), clamped(weight).alias("w"), *([clamped(mask).alias("m")] if mask else []), F.col(vector).cast("array<double>").alias("v"))

    def parts(batch: pd.DataFrame) -> np.ndarray:
        x, w = np.stack(batch["v"].to_numpy()), batch["w"].to_numpy()[:, None]
        shares = [w, 1 - w, np.ones_like(w), *([batch["m"].to_numpy()[:, None]] if mask else [])]
        return np.concatenate([np.concatenate([s * x, s], 1) for s in shares], 1)

    sums = summed(weighed, ["k"], [c for c in weighed.columns if c != "k"], parts)
    flat = sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("z"))  # a row for each column of the pools
    pools = ["box", "context", "full", *(["mask"] if mask else [])]
    width = (F.size("z") / len(pools)).cast("int")
    masses = {"box": "mass", "context": "context_mass", "full": "tokens", "mask": "mask_mass"}
    made = flat.select("k", *[F.slice("z", F.lit(i) * width + 1, width - 1).alias(p) for i, p in enumerate(pools)], *[F.element_at("z", F.lit(i + 1) * width).alias(masses[p]) for i, p in enumerate(pools)])

    def pool(name: str):
        if name == "full":
            return F.transform("full", lambda x: x / F.col("tokens"))
        return F.when(F.col(masses[name]) >= least_mass, F.transform(name, lambda x: x / (F.col(masses[name]) + epsilon)))

    reason = F.when(F.col("mass") < least_mass, "region_below_minimum_mass").when(F.col("context_mass") < least_mass, "context_below_minimum_mass")
    if mask:
        reason = reason.when(F.col("mask_mass") < least_mass, "mask_below_minimum_mass")
    extra = ["mask_mass", pool("mask").alias("mask")] if mask else []
    return made.select(
        F.col("k").alias(key), "mass", "context_mass", F.col("tokens").cast("long").alias("tokens"), pool("box").alias("box"), pool("full").alias("full"), pool("context").alias("context"), *extra, reason.alias("reason")
    )


def erase(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Normalised pixels [..., H, W, 3] with 0 where the mask [..., H, W] holds."""
    return np.where(np.asarray(mask, bool)[..., None], 0.0, pixels).astype(pixels.dtype)


def fill_polygons(polygons: list, height: int, width: int) -> np.ndarray:
    """Union of polygons, each filled by the even-odd rule at pixel centres, row by row."""
    mask = np.zeros((height, width), bool)
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        x, y, x2, y2 = p[:, 0], p[:, 1], np.roll(p[:, 0], -1), np.roll(p[:, 1], -1)
        for row in range(max(int(np.floor(y.min())), 0), min(int(np.ceil(y.max())), height)):
            at = row + 0.5
            cross = (y <= at) != (y2 <= at)
            edges = np.sort(x[cross] + (at - y[cross]) * (x2[cross] - x[cross]) / (y2[cross] - y[cross]))
            for a, b in zip(edges[::2], edges[1::2]):
                mask[row, max(int(np.ceil(a - 0.5)), 0) : max(int(np.floor(b - 0.5)) + 1, 0)] ^= True
    return mask


def crop_mask(mask: np.ndarray, crop: int = B.CROP) -> np.ndarray:
    """R5 for masks: nearest resize of the short side and centre crop."""
    h, w = mask.shape
    rh, rw, top, left = B.crop_window(h, w, crop)
    rows = np.minimum(((np.arange(crop) + top) * (h / rh)).astype(int), h - 1)
    columns = np.minimum(((np.arange(crop) + left) * (w / rw)).astype(int), w - 1)
    return mask[np.ix_(rows, columns)]


def polygon_occupancy(
    rows: DataFrame, key: str = "observation_id", frame: str = "frame", polygons: str = "polygons", height: str = "image_height", width: str = "image_width", crop: int = B.CROP, patch: int = B.PATCH, tubelet: int = B.TUBELET,
    empty: str = "raise",
) -> DataFrame:
    """(key, t, i, j, occupancy) of polygon masks. A frame without a polygon, or whose mask lies outside the crop, raises, or
    gives no cell with empty="skip"; polygon_reasons tells which those are. Pixels stay in a task."""
    if empty not in ("raise", "skip"):
        raise ValueError("empty must be raise or skip")
    kind = rows.schema[key].dataType.simpleString()
    n = crop // patch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for k, t, mask in _masks(batch, crop):
                if mask is None or not mask.any():
                    if empty == "raise":
                        raise ValueError(f"{k}, frame {t}: " + ("no polygon" if mask is None else "the mask is outside the crop"))
                    continue
                share = mask.reshape(n, patch, n, patch).mean((1, 3))
                i, j = np.nonzero(share)
                parts.append(pd.DataFrame({"k": k, "t": t // tubelet, "i": i, "j": j, "o": share[i, j]}))
            if parts:
                yield pd.concat(parts)

    cells = _shaped(rows, key, frame, polygons, height, width).mapInPandas(run, f"k {kind}, t long, i int, j int, o double")
    return cells.groupBy(F.col("k").alias(key), "t", "i", "j").agg((F.sum("o") / tubelet).alias("occupancy"))


def polygon_reasons(rows: DataFrame, key: str = "observation_id", frame: str = "frame", polygons: str = "polygons", height: str = "image_height", width: str = "image_width", crop: int = B.CROP) -> DataFrame:
    """R2's code for masks: (key, frame, reason): no_polygon, mask_outside_encoder_crop, or null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, t, "no_polygon" if m is None else None if m.any() else "mask_outside_encoder_crop") for k, t, m in _masks(batch, crop)]
            yield pd.DataFrame(found, columns=["k", "t", "reason"])

    return _shaped(rows, key, frame, polygons, height, width).mapInPandas(run, f"k {kind}, t long, reason string").toDF(key, frame, "reason")


def _shaped(rows: DataFrame, key: str, frame: str, polygons: str, height: str, width: str) -> DataFrame:
    return rows.select(F.col(key).alias("k"), F.col(frame).cast("long").alias("t"), F.col(polygons).alias("p"), F.col(height).alias("h"), F.col(width).alias("w"))


def _masks(batch: pd.DataFrame, crop: int) -> Iterator[tuple]:
    """(key, frame, mask in the crop; None without a polygon) of each row."""
    for k, t, p, h, w in zip(batch["k"], batch["t"], batch["p"], batch["h"], batch["w"]):
        yield k, t, None if p is None or not len(p) else crop_mask(fill_polygons(p, int(h), int(w)), crop)
