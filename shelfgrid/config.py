"""Tunable parameters of the jobs, with the defaults of the service they describe."""

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackConfig:
    min_score: float = 0.50
    min_width: int = 55
    min_height: int = 45
    min_area: int = 2_000
    max_area: int = 500_000
    min_aspect: float = 0.18
    max_aspect: float = 7.0
    nms_iou: float = 0.50
    nms_containment: float = 0.86
    max_frame_gap: int = 36
    edge_frame_gap: int = 72
    min_match_score: float = 0.27
    min_match_iou: float = 0.04
    distance_factor: float = 3.2
    min_detections: int = 2
    max_per_frame: int | None = None  # the service keeps 40
    merge_gap: int = 72
    merge_score: float = 0.34
    frame_width: int = 3840
    frame_height: int = 2160
    edge_margin: int = 180

    @property
    def cut_gap(self) -> int:
        """Frame gap that neither matching nor fragment merging can bridge."""
        return max(self.max_frame_gap, self.edge_frame_gap, self.merge_gap)


@dataclass(frozen=True)
class DetectConfig:
    frame_width: int = 3840
    frame_height: int = 2160
    min_area_ratio: float = 0.0003
    max_area_ratio: float = 0.18
    min_aspect: float = 0.20
    max_aspect: float = 6.0
    min_score: float = 0.50
    max_candidates: int | None = None  # the service keeps 80
    merge_iou: float = 0.45
    merge_containment: float = 0.85
    diverse_iou: float = 0.50
    diverse_containment: float = 0.82


@dataclass(frozen=True)
class ParserConfig:
    min_word_confidence: float = 10.0
    min_block_confidence: float = 0.15
    min_promo_confidence: float = 0.35
    min_reference_score: float = 55.0
