"""Boxes: overlap, squares, tiles, normalisation and non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .scalars import round_half_up, to_fixed


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x, y, w, h; 0 if they don't overlap."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    both = w * h
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise((both / (a.w * a.h + b.w * b.h - both)).cast("double"))


def square_box(box: Column, padding: float, width: Column, height: Column) -> Column:
    """A square around the box's centre with padding, moved rather than shrunk at the image's edges; whole pixels."""
    wanted = F.least(F.greatest(box.w, box.h) * F.lit(1 + 2 * padding), width.cast("double"), height.cast("double"))
    side = round_half_up(wanted)
    zero = F.lit(0).cast("long")
    x = F.greatest(zero, F.least(round_half_up(box.x + box.w / 2 - wanted / 2), width.cast("long") - side))
    y = F.greatest(zero, F.least(round_half_up(box.y + box.h / 2 - wanted / 2), height.cast("long") - side))
    return F.struct(*(v.cast("int").alias(n) for v, n in ((x, "x"), (y, "y"), (side, "w"), (side, "h"))))


def normalise_box(box: Column, width: Column, height: Column, digits: int = 4, even: bool = False) -> Column:
    """x, y from 0 and w, h up to 1, as shares of the image. even: see to_fixed."""

    def low(v: Column) -> Column:
        return to_fixed(F.greatest(F.lit(0.0), v), digits, even)

    def high(v: Column) -> Column:
        return to_fixed(F.least(F.lit(1.0), v), digits, even)

    return F.array(low(box.x / width), low(box.y / height), high(box.w / width), high(box.h / height))


def rescale_box(box: Column, scale: Column | float, dx: Column | float = 0, dy: Column | float = 0) -> Column:
    """A box of a tile or a smaller copy in whole pixels of the original: moved by the tile's place, then scaled."""
    scale, dx, dy = (v if isinstance(v, Column) else F.lit(v) for v in (scale, dx, dy))
    values = {"x": (box.x + dx) * scale, "y": (box.y + dy) * scale, "w": box.w * scale, "h": box.h * scale}
    return F.struct(*(round_half_up(v).cast("int").alias(n) for n, v in values.items()))


def tile_grid(sizes: DataFrame, id_col: str = "id", width_col: str = "width", height_col: str = "height", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A row per tile of each image: id, tx, ty, x, y, w, h. Images that one tile covers have none.

    Each tile is padded by a share of its size; tiles of 32 pixels or less are left out.
    """
    grid = sizes.select(F.col(id_col).alias("id"), F.col(width_col).cast("double").alias("W"), F.col(height_col).cast("double").alias("H"))
    for edge, n in (("W", "nx"), ("H", "ny")):
        grid = grid.withColumn(n, F.greatest(F.lit(1), F.ceil(F.col(edge) / cfg.tile_target_px)).cast("int"))
    grid = grid.where("nx * ny > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("ty"))
    for edge, n, at, low, size in (("W", "nx", "tx", "x", "w"), ("H", "ny", "ty", "y", "h")):
        base = F.col(edge) / F.col(n)
        pad = base * cfg.tile_overlap
        grid = grid.withColumn(low, F.greatest(F.lit(0).cast("long"), F.floor(F.col(at) * base - pad)))
        grid = grid.withColumn(size, F.least(F.col(edge).cast("long"), F.ceil((F.col(at) + 1) * base + pad)) - F.col(low))
    return grid.where("w > 32 and h > 32").select("id", "tx", "ty", *(F.col(c).cast("int").alias(c) for c in "xywh"))


def non_maximum_suppression(boxes: DataFrame, threshold: float = DEFAULT.merge_iou) -> DataFrame:
    """Of boxes (photo, position, x, y, w, h, rank) those that no kept box of higher rank in the photo overlaps by more than threshold.

    Equal ranks go by position, then by the box. A photo's boxes are folded in order in one row, since each depends on those kept before.
    """
    fields = ["position", "x", "y", "w", "h", "rank"]
    box = F.struct((-F.col("rank")).alias("order"), *fields)
    packed = boxes.groupBy("photo").agg(F.sort_array(F.collect_list(box)).alias("b"))
    none = F.slice("b", 1, 0)

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b)))

    return packed.select("photo", F.explode(F.aggregate("b", none, step)).alias("k")).select("photo", *(f"k.{f}" for f in fields))


def iou_pairs(boxes: DataFrame, at_least: float = 0.0) -> DataFrame:
    """photo, a, b, iou of overlapping pairs of boxes within photos, a < b by position."""
    box = F.struct(*"xywh")
    left = boxes.select("photo", F.col("position").alias("a"), box.alias("ba"))
    right = boxes.select(F.col("photo").alias("photo_b"), F.col("position").alias("b"), box.alias("bb"))
    pairs = left.join(right, (F.col("photo") == F.col("photo_b")) & (F.col("a") < F.col("b")))
    return pairs.select("photo", "a", "b", iou(F.col("ba"), F.col("bb")).alias("iou")).where(F.col("iou") > at_least)


def detection_rank(source: Column, score: Column) -> Column:
    """The order in which overlapping detections win: the finer source (its long edge in pixels) first, then the score."""
    return source * 1000 + score * 100
