"""Parameters of the pipelines, checked when made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def as_json(config) -> dict:
    """A configuration as plain values for JSON: tuples as lists."""
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items()}


@dataclass(frozen=True)
class DetectionConfig:
    """Detection on one section: thresholds, grouping, density clustering, cleaning, merging, selection."""

    # The published defaults.
    threshold: float = 0.1
    gradient_ratio: float = 0.1
    normal_step: float = 1.0
    support_radius: int = 8
    min_keep_ratio: float = 0.999
    max_gap: int = 20
    eps: float = 10.0
    min_samples: int = 5
    second_eps: float = 10.0
    second_min_samples: int = 3
    local_window: int = 7
    smoothing_window: int = 5
    tau: float = 0.5
    delta: float = 0.001
    blend: float = 0.01
    max_shift: float = 0.05
    edge_margin: int = 2
    angle_threshold: float = 90.0
    max_rounds: int = 10
    merge_theta: float = 17.0
    merge_distance: float = 75.0
    merge_extrapolation: float = 8.0
    min_cluster_points: int = 30
    min_vertical_range: float = 30.0

    def __post_init__(self) -> None:
        _need(0 <= self.threshold <= 1, "threshold must lie in [0, 1]")
        _need(self.gradient_ratio >= 0 and self.normal_step >= 0, "gradient_ratio and normal_step must not be negative")
        _need(0 <= self.min_keep_ratio <= 1, "min_keep_ratio must lie in [0, 1]")
        _need(self.max_gap >= 0 and self.support_radius >= 0, "max_gap and support_radius must not be negative")
        _need(min(self.eps, self.second_eps) > 0 and min(self.min_samples, self.second_min_samples) >= 1, "eps and min_samples must be positive")
        _need(self.local_window >= 1 and self.smoothing_window >= 1 and self.edge_margin >= 0, "windows must be positive and edge_margin not negative")
        _need(self.delta > 0 and 0 <= self.blend <= 1, "delta must be positive and blend lie in [0, 1]")
        _need(self.max_shift >= 0 and self.max_rounds >= 0, "max_shift and max_rounds must not be negative")
        _need(min(self.merge_theta, self.merge_distance, self.merge_extrapolation) > 0, "merge limits must be positive")
        _need(self.min_cluster_points >= 1 and self.min_vertical_range >= 0, "min_cluster_points and min_vertical_range are out of range")


@dataclass(frozen=True)
class LinkConfig:
    """Linking lines of nearby sections into tracks and surfaces. Sections are numbered from the inline origin by the inline step."""

    # The published defaults.
    inline_origin: int = 300
    inline_step: int = 1
    inline_start: int = 300
    inline_end: int = 330
    section_scale: float = 1.0
    profile_scale: float = 1.0
    depth_scale: float = 1.0
    distance_weight: float = 0.03
    orientation_weight: float = 1.0
    max_gap: int = 5
    tau: float = 0.7
    min_lines: int = 3
    samples: int = 128
    sigma: tuple[float, float] = (1.0, 1.0)
    observed_weight: float = 0.25

    def __post_init__(self) -> None:
        _need(self.inline_step > 0, "inline_step must be positive")
        _need(self.inline_end >= self.inline_start, "inline_end must not precede inline_start")
        _need(self.distance_weight >= 0 and self.orientation_weight >= 0, "weights must not be negative")
        _need(0 < self.tau < 1, "tau must lie in (0, 1)")
        _need(self.max_gap >= 1 and self.min_lines >= 2 and self.samples >= 2, "max_gap, min_lines and samples are out of range")
        _need(min(self.axis_scales) > 0, "axis scales must be positive")
        _need(min(self.sigma) >= 0 and 0 <= self.observed_weight <= 1, "sigma must not be negative and observed_weight lie in [0, 1]")

    @property
    def axis_scales(self) -> tuple[float, float, float]:
        return self.section_scale, self.profile_scale, self.depth_scale


@dataclass(frozen=True)
class LineConfig:
    """One interpreted line: its section file, its picks and how their coordinates become pixels."""

    inline_id: int
    segy_path: str
    csv_path: str
    split: str | None = None
    section_index: int = 0
    x_col: int = 0
    z_col: int = 1
    fault_id_col: int | None = None
    x_offset: float = 0.0
    z_offset: float = 0.0
    x_scale: float = 1.0
    z_scale: float = 1.0
    label_shape_before_downsample: tuple[int, int] | None = None
    downsample_x: int = 1
    downsample_z: int = 1

    def __post_init__(self) -> None:
        _need(self.x_scale != 0 and self.z_scale != 0, "scales must not be zero")
        _need(self.downsample_x >= 1 and self.downsample_z >= 1, "downsampling must be at least 1")

    @classmethod
    def of(cls, given: dict) -> LineConfig:
        """From a JSON object: unknown fields and missing ones without a default are errors; split in lower case."""
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        missing = sorted({"inline_id", "segy_path", "csv_path"} - set(given))
        _need(not unknown and not missing, f"unknown fields {unknown}, missing fields {missing}")
        shape, split = given.get("label_shape_before_downsample"), given.get("split")
        return cls(**{**given, "label_shape_before_downsample": None if shape is None else tuple(shape), "split": None if split is None else str(split).lower()})


@dataclass(frozen=True)
class LabelConfig:
    """Labels, patches and their split. The inline strategy keeps whole inlines apart, the spatial one the tail of each source."""

    # The published defaults.
    ellipse: tuple[int, int] = (8, 4)
    patch_size: int = 256
    stride: int = 128
    positive_only: bool = True
    min_label_pixels: int = 1
    target_train: int = 200
    target_val: int = 40
    strategy: str = "inline"
    val_inlines: tuple[int, ...] = ()
    axis: str = "x"
    val_fraction: float = 0.2
    guard: int | None = None
    seed: int = 2026

    def __post_init__(self) -> None:
        _need(self.patch_size > 0 and self.stride > 0, "patch_size and stride must be positive")
        _need(self.target_train > 0 and self.target_val > 0, "target_train and target_val must be positive")
        _need(self.strategy in ("inline", "spatial") and self.axis in ("x", "z"), "strategy is inline or spatial, axis x or z")
        _need(self.strategy == "inline" or not self.val_inlines, "val_inlines need the inline strategy")
        _need(0 < self.val_fraction < 1, "val_fraction must lie in (0, 1)")
        _need(self.guard is None or self.guard >= 0, "guard must not be negative")
        _need(min(self.ellipse) > 0, "ellipse axes must be positive")

    @property
    def gap(self) -> int:
        """Pixels between train and validation patches of one source: the guard, or a patch if there is none."""
        return self.patch_size if self.guard is None else self.guard


@dataclass(frozen=True)
class TileConfig:
    """Tiling for scoring."""

    # The published defaults.
    patch: tuple[int, int] = (256, 256)
    overlap: int = 12

    def __post_init__(self) -> None:
        _need(len(self.patch) == 2 and all(x >= 16 and x % 16 == 0 for x in self.patch), "patch sides must be multiples of 16")
        _need(0 < self.overlap < min(self.patch), "overlap must be positive and smaller than a patch")
