"""Parameters of the operators and pipelines, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from .errors import InvalidK, InvalidParam

MAX_K = 15


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise InvalidK(f"k is {k}; 1 to {MAX_K} are possible")
    return k


class ClusterMode(Enum):
    """How rough clusters are made."""

    EXACT = "exact"
    SKETCH_PRECLUSTER = "sketch-precluster"
    SKETCH_ONLY = "sketch-only"

    @classmethod
    def of(cls, name: str | ClusterMode) -> ClusterMode:
        if isinstance(name, cls):
            return name
        # Other spellings of the modes.
        known = {
            "exact": cls.EXACT,
            "sketch": cls.SKETCH_PRECLUSTER,
            "precluster": cls.SKETCH_PRECLUSTER,
            "sketch-precluster": cls.SKETCH_PRECLUSTER,
            "sketch_precluster": cls.SKETCH_PRECLUSTER,
            "sketch-only": cls.SKETCH_ONLY,
            "sketch_only": cls.SKETCH_ONLY,
        }
        mode = known.get(str(name).strip().lower())
        if mode is None:
            raise InvalidParam(f"no cluster mode is called {name!r}")
        return mode


@dataclass(frozen=True)
class FadParams:
    k: int = 6
    neighbor_threshold: float = 1.0
    min_count: int = 2
    use_sketch: bool = True
    sketch_size: int = 512
    sketch_prefilter_threshold: float = 0.03
    canonical: bool = True
    verbose: bool = False


@dataclass(frozen=True)
class AlignParams:
    match_score: int = 2
    mismatch_score: int = -2
    gap_score: int = -3
    band: int = 16
    homo_gap_score: int | None = None


@dataclass(frozen=True)
class ConsensusParams:
    k: int = 6
    min_base_fraction: float = 0.5
    polish_rounds: int = 1
    max_consensus_reads: int = 512
    max_centroid_candidates: int = 64
    max_centroid_comparisons: int = 256
    align: AlignParams = field(default_factory=AlignParams)


@dataclass(frozen=True)
class DpMeansParams:
    radius: float = 0.01
    max_iter: int = 30


@dataclass(frozen=True)
class RadParams:
    """sketch_radius, sketch_max_iter and sketch_fallback_exact are accepted and have no effect."""

    k: int = 6
    canonical: bool = True
    rough_radius: float = 0.01
    rough_max_iter: int = 10
    min_cluster_size: int = 1
    cluster_mode: ClusterMode = ClusterMode.SKETCH_PRECLUSTER
    fine_split: bool = True
    fine_split_max_depth: int = 4
    fine_split_top_kmers: int = 128
    fine_split_min_var: float = 0.05
    fine_split_radius: float = 0.01
    fine_split_max_iter: int = 10
    fine_split_min_features: int = 8
    fine_split_drop_homopolymer_kmers: bool = True
    run_fad_clean: bool = True
    use_sketch: bool = True
    sketch_size: int = 512
    sketch_prefilter_threshold: float = 0.03
    sketch_top_k: int = 32
    sketch_max_bins: int = 4096
    sketch_radius: float = 0.03
    sketch_max_iter: int = 8
    sketch_fallback_exact: bool = True
    consensus: ConsensusParams = field(default_factory=ConsensusParams)
    fad: FadParams = field(default_factory=lambda: FadParams(min_count=1))
    verbose: bool = False
