"""Frame preprocessing and registration in numpy, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortgeo.functions.boxes import CROP, crop_window

#: Channel means and deviations that RGB frames are normalised by.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FRAMES = (1, 16)


def resize_bilinear(frames: np.ndarray, height: int, width: int) -> np.ndarray:
    """[T, H, W, C] to a new size, pixel centres aligned, without antialiasing."""

    def axis(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(new) + 0.5) * (old / new) - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), old - 1)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, wy = axis(frames.shape[1], height)
    x0, x1, wx = axis(frames.shape[2], width)
    rows = frames[:, y0] * (1 - wy)[:, None, None] + frames[:, y1] * wy[:, None, None]
    return rows[:, :, x0] * (1 - wx)[:, None] + rows[:, :, x1] * wx[:, None]


def preprocess(frames: np.ndarray, crop: int = CROP) -> np.ndarray:
    """RGB frames [T, H, W, 3], 1 or 16, to normalised floats [T, crop, crop, 3]: short side resized, centre cropped."""
    frames = np.asarray(frames)
    if frames.ndim != 4 or frames.shape[3] != 3 or frames.shape[0] not in FRAMES:
        raise ValueError("frames must be [1 or 16, H, W, 3]")
    rh, rw, top, left = crop_window(*frames.shape[1:3], crop)
    x = frames.astype(np.float64)
    if frames.dtype == np.uint8 or x.max(initial=0) > 1:
        x = x / 255
    x = resize_bilinear(x, rh, rw)
    x = x[:, top : top + crop, left : left + crop]
    return ((x - MEAN) / DEVIATION).astype(np.float32)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The (row, column) shift that moves image a onto b, by phase correlation, to whole pixels."""
    if a.shape != b.shape or a.ndim != 2:
        raise ValueError("two images of one shape are asked for")
    cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    at = np.unravel_index(int(peak.argmax()), a.shape)
    return tuple(float(i - n if i > n // 2 else i) for i, n in zip(at, a.shape))


def clean_state(state: Mapping[str, object], prefixes=("module.", "backbone.")) -> dict[str, object]:
    """Names without the prefixes, taken off in order; the mapping given is left as it is, a collision raises."""
    out: dict[str, object] = {}
    for name, value in state.items():
        for p in prefixes:
            name = name.removeprefix(p)
        if name in out:
            raise ValueError(f"two weights come to the name {name}")
        out[name] = value
    return out


def map_decoded(rows: DataFrame, decode: Callable[[dict], np.ndarray], use: Callable[[dict, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """S10's seam: `decode` makes frames of a row (which decoder is the caller's choice), `use` rows of them; pixels stay in the task, those of
    one row at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = {c: batch[c].tolist() for c in batch}
            for values in zip(*columns.values()):
                row = dict(zip(columns, values))
                yield use(row, decode(row))

    return rows.mapInPandas(run, schema)
