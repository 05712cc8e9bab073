"""Every tunable of the engine, with the comparison that uses it."""

from __future__ import annotations

import dataclasses
import hashlib
import json


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    photo_pattern: str = r"(?i)^t-(\d+)\.jpg$"
    decode_long_edge: int = 4096
    detect_long_edge: int = 1600
    detect_min_confidence: float = 0.3  # kept if >=
    detect_min_size: int = 40  # kept if >=
    max_faces_per_photo: int = 60
    min_face_confidence: float = 0.62  # rejected if <
    min_face_size: int = 110
    min_face_frontality: float = 0.12
    tile_target_px: int = 1400
    tile_overlap: float = 0.18
    tiling_min_long_edge: int = 2200
    merge_iou: float = 0.35  # duplicate if >
    refine_below_px: int = 140
    refine_padding: float = 0.6
    refine_size: int = 384
    refine_min_confidence: float = 0.2
    similarity: float = 0.46  # merged if average <=
    same_photo: float = 0.34  # instead, when clusters share a photo
    review_margin: float = 0.12  # reviewed if similarity < average <= similarity + margin
    exact_max_faces: int = 4000  # more: single linkage below micro first
    micro: float = 0.4
    consolidate: float = 0.36  # centroid distance <=
    consolidate_review: float = 0.44
    small_groups: int = 3
    review_small: float = 0.58
    min_raw_pair: float = 0.46
    strong_pair: float = 0.40
    min_strong_pairs: int = 2
    min_strong_coverage: float = 0.5
    impure_max_members: int = 4
    impure_distance: float = 0.40  # impure if >
    min_photos: int = 2  # parked if <
    min_faces: int = 2
    min_quality: float = 0.72
    ledger_overlap: float = 0.25
    weight_size: float = 0.3
    weight_detection: float = 0.25
    weight_frontality: float = 0.2
    weight_sharpness: float = 0.15
    weight_centrality: float = 0.1
    size_saturation: float = 400.0
    sharpness_saturation: float = 42.0
    hamming_dupe: int = 6  # duplicate if <=
    fail_ratio_abort: float = 0.2  # abort if >=

    def detection_fingerprint(self) -> str:
        """Changes with any setting that changes what analysis of a photo gives."""
        keys = ("decode_long_edge", "detect_long_edge", "detect_min_confidence", "detect_min_size", "max_faces_per_photo", "tile_target_px", "tile_overlap", "tiling_min_long_edge", "merge_iou", "refine_below_px", "refine_padding", "refine_size", "refine_min_confidence")
        return "v1|" + "|".join(f"{k}={json.dumps(getattr(self, k))}" for k in keys)

    def digest(self) -> str:
        return hashlib.sha1(self.detection_fingerprint().encode()).hexdigest()


DEFAULT = EngineConfig()
