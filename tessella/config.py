"""Settings of an analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

HIERARCHICAL = ("ward.D2", "ward.D", "single", "complete", "average", "mcquitty", "centroid", "median", "flexible", "diana")
EUCLIDEAN_ONLY = ("kmeans", "fuzzy", "ward.D2", "ward.D", "centroid", "median", "gmm", "ward_relocate", "hybrid_kmeans", "hybrid_relocate")
METHODS = (*HIERARCHICAL, "kmeans", "pam", "fuzzy", "gmm", "ward_relocate", "hybrid_kmeans", "hybrid_relocate", "hybrid_pam")
DISTANCES = ("euclidean", "sqeuclidean", "minkowski", "manhattan", "maximum", "mahalanobis", "correlation", "cosine", "spearman", "gower", "jaccard", "simple_matching", "russell_rao", "chi_square", "phi_square")
COVARIANCES = ("EEE", "VVV", "EEI", "VVI", "EII", "VII", "BIC")


@dataclass(frozen=True)
class ClusterConfig:
    variables: tuple[str, ...]
    id: str
    illustrative: tuple[str, ...] = ()
    levels: dict[str, str] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    scaling: str = "z"
    missing: str = "complete"
    distance: str = "euclidean"
    method: str = "ward.D2"
    k_min: int = 2
    k_max: int = 6
    seed: int = 2026
    B: int = 200
    null: str = "permutation"
    subsample: bool = False
    fraction: float = 0.8
    donor_threshold: float = 0.5
    max_missing: float = 0.5
    nstart: int = 20
    max_iter: int = 100
    beta: float = -0.25
    hybrid_start: str = "ward.D2"
    hybrid_algorithm: str = "Hartigan-Wong"
    mi_m: int = 5
    mi_iter: int = 5
    covariance: str = "BIC"
    gap_B: int = 100
    representatives: int = 2000

    def __post_init__(self) -> None:
        def one_of(name: str, allowed: tuple[str, ...]) -> None:
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

        def within(name: str, low: float, high: float) -> None:
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

        if not self.variables:
            raise ValueError("at least one variable is needed")
        one_of("scaling", ("z", "none", "range", "robust"))
        one_of("missing", ("complete", "mean", "neighbor", "available", "multiple"))
        one_of("distance", DISTANCES)
        one_of("method", METHODS)
        one_of("null", ("permutation", "gaussian"))
        one_of("hybrid_start", HIERARCHICAL)
        one_of("hybrid_algorithm", ("Hartigan-Wong", "Lloyd", "MacQueen"))
        one_of("covariance", COVARIANCES)
        for name, low, high in (("k_min", 1, 30), ("k_max", 1, 30), ("B", 1, 10_000), ("max_missing", 0, 1), ("nstart", 1, 1000), ("max_iter", 1, 10_000), ("beta", -1, 0.999), ("mi_m", 2, 50), ("mi_iter", 1, 50), ("gap_B", 1, 1000), ("representatives", 10, 2000)):
            within(name, low, high)
        if self.k_min > self.k_max:
            raise ValueError("k_min must not exceed k_max")
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction must be above 0, up to 1")
        if self.donor_threshold < 0:
            raise ValueError("donor_threshold must be 0 or more")
        if self.weights:
            if len(self.weights) != len(self.variables):
                raise ValueError("one weight per variable is needed")
            if any(not 0 <= w < float("inf") for w in self.weights) or not any(self.weights):
                raise ValueError("weights must be finite, 0 or more, one of them positive")
        if self.method in EUCLIDEAN_ONLY and self.distance != "euclidean":
            raise ValueError(f"{self.method} needs Euclidean distance")
        if len(set(self.weights)) > 1 and self.distance in ("mahalanobis", "chi_square", "phi_square"):
            raise ValueError(f"variable weights cannot be combined with {self.distance} distance")
        if self.missing == "available" and self.distance != "gower":
            raise ValueError("available coordinates need Gower distance")
        if self.method.startswith("hybrid") and self.hybrid_start in ("ward.D2", "ward.D", "centroid", "median") and self.distance != "euclidean":
            raise ValueError("this start needs Euclidean distance")

    def weight(self) -> tuple[float, ...]:
        return self.weights or (1.0,) * len(self.variables)
