"""Box geometry as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

CROP, PATCH, TUBELET = 384, 16, 2


@dataclass(frozen=True)
class CropGeometry:
    """R1 as columns: resized height and width, and the offsets of the centre crop."""

    source_h: Column
    source_w: Column
    resized_h: Column
    resized_w: Column
    top: Column
    left: Column
    crop: int


def crop_window(height: int, width: int, crop: int = CROP) -> tuple[int, int, int, int]:
    """R1 in plain numbers: resized height and width, top and left of the crop."""
    if height <= 0 or width <= 0:
        raise ValueError("image sizes must be positive")
    short = int(crop * 256 / 224)
    rh, rw = (int(short * height / width), short) if height > width else (short, int(short * width / height))
    return rh, rw, round((rh - crop) / 2.0), round((rw - crop) / 2.0)


def crop_geometry(height: Column, width: Column, crop: int = CROP) -> CropGeometry:
    """The short side becomes int(crop * 256 / 224), the long one is truncated, offsets round half to even. Non-positive sizes raise."""
    short = int(crop * 256 / 224)
    bad = (height <= 0) | (width <= 0)
    h = F.when(bad, F.raise_error(F.lit("image sizes must be positive")).cast("double")).otherwise(height.cast("double"))
    w = width.cast("double")
    tall = h > w
    rh = F.when(tall, F.floor(F.lit(short) * h / w)).otherwise(F.lit(short)).cast("double")
    rw = F.when(tall, F.lit(short)).otherwise(F.floor(F.lit(short) * w / h)).cast("double")
    return CropGeometry(h, w, rh, rw, F.rint((rh - crop) / 2.0), F.rint((rw - crop) / 2.0), crop)


def transform_box(x: Column, y: Column, w: Column, h: Column, g: CropGeometry) -> Column:
    """R2: struct (x, y, w, h) in the crop, clipped to it; null where the box is empty before or after."""
    sx, sy = g.resized_w / g.source_w, g.resized_h / g.source_h
    crop = F.lit(float(g.crop))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(crop, v))
    x0, y0 = clip(x * sx - g.left), clip(y * sy - g.top)
    x1, y1 = clip((x + w) * sx - g.left), clip((y + h) * sy - g.top)
    ok = (w > 0) & (h > 0) & (x1 > x0) & (y1 > y0)
    return F.when(ok, F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def token_mass(box: Column, patch: int = PATCH) -> Column:
    """Cells of patch * patch pixels that the rasterized box covers, in area; 0 for an empty box."""
    x, y, w, h = (box[k] for k in "xywh")
    area = (F.ceil(x + w) - F.floor(x)) * (F.ceil(y + h) - F.floor(y))
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(area / F.lit(float(patch * patch)))


def cell_overlap(box: Column, i: Column, j: Column, patch: int = PATCH) -> Column:
    """R6 for a box: the share of cell (row i, column j) that the rasterized box covers."""
    x0, x1 = F.floor(box["x"]), F.ceil(box["x"] + box["w"])
    y0, y1 = F.floor(box["y"]), F.ceil(box["y"] + box["h"])
    along = lambda lo, hi, k: F.greatest(F.lit(0), F.least(hi, (k + 1) * patch) - F.greatest(lo, k * patch))
    return along(x0, x1, j) * along(y0, y1, i) / F.lit(float(patch * patch))


def sequence_frame(filename: Column) -> tuple[Column, Column]:
    """`name_12.jpg` is sequence `name`, frame 12."""
    pattern = r"^(.*)_(\d+)\.[^.]*$"
    return F.regexp_extract(filename, pattern, 1), F.regexp_extract(filename, pattern, 2).try_cast("long")


def valid_polygons(polygons: Column) -> Column:
    """Components of at least six and an even number of coordinates."""
    return F.filter(polygons, lambda c: (F.size(c) >= 6) & (F.size(c) % 2 == 0))


def token_position(index: Column, total: int) -> Column:
    """Struct (t, i, j) of a flat token index, for 576 (one frame) or 4,608 (eight tubelets) tokens of a 24 by 24 grid."""
    if total not in (576, 4608):
        raise ValueError(f"no token grid has {total} tokens")
    return F.struct(F.floor(index / 576).cast("int").alias("t"), F.floor(index % 576 / 24).cast("int").alias("i"), (index % 24).cast("int").alias("j"))
