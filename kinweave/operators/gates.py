"""Quality gates: each face is charged to the first gate that it fails."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


def reject_reason(cfg: EngineConfig = DEFAULT) -> Column:
    """Null where a face passes."""
    return F.when(F.col("score") < cfg.min_face_confidence, F.lit("confidence")).when(F.col("native_width") < cfg.min_face_size, F.lit("size")).when(F.col("frontality") < cfg.min_face_frontality, F.lit("frontality"))


def flag(faces: DataFrame, ignored: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """faces with reject_reason; ignored (face_id) is the first gate."""
    flagged = faces.withColumn("reject_reason", reject_reason(cfg))
    if ignored is not None:
        flagged = flagged.join(ignored.select("face_id", F.lit(True).alias("__ignored")).distinct(), "face_id", "left")
        flagged = flagged.withColumn("reject_reason", F.when(F.col("__ignored"), F.lit("ignored")).otherwise(F.col("reject_reason"))).drop("__ignored")
    return flagged


def passing(faces: DataFrame, ignored: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return flag(faces, ignored, cfg).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejections(faces: DataFrame, ignored: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """reason, n: how many faces each gate stops; `passed` counts the rest."""
    return flag(faces, ignored, cfg).groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def detections(boxes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Detections that are sure and large enough, at most the configured number a photo, best first."""
    from pyspark.sql import Window

    best = Window.partitionBy("photo").orderBy(F.desc("score"), "position")
    kept = boxes.where((F.col("score") >= cfg.detect_min_confidence) & (F.col("w") >= cfg.detect_min_size))
    return kept.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= cfg.max_faces_per_photo).drop("rn")


def flatten(photos: DataFrame, photo_col: str = "id", faces_col: str = "faces") -> DataFrame:
    """A row per face of nested analyses."""
    return photos.select(F.col(photo_col).alias("photo_id"), F.explode(faces_col).alias("face")).select("photo_id", "face.*")


def without(rows: DataFrame, key: str, gone: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose key isn't listed. A list comes from a configuration, so it is a literal; a table is anti-joined."""
    if isinstance(gone, DataFrame):
        return rows.join(gone, key, "left_anti")
    gone = list(gone)
    return rows.where(~F.coalesce(F.col(key).isin(gone), F.lit(False))) if gone else rows
