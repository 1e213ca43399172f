"""Platform profiles: which file and columns hold what, and which labels are controls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column


@dataclass(frozen=True)
class Points:
    file: str
    x: str
    y: str
    z: str | None
    label: str
    id: str = "transcript_id"
    cell_id: str | None = None
    quality: str | None = None
    nuclear: str | None = None
    nuclear_value: object = 1


@dataclass(frozen=True)
class Outlines:
    file: str
    id: str
    x: str | None = None
    y: str | None = None
    geometry: str | None = None


@dataclass(frozen=True)
class Profile:
    """``extra_filter`` is the hook for a platform's own predicate on the canonical columns."""

    name: str
    points: Points
    outlines: Outlines
    control_prefixes: tuple[str, ...] = ()
    min_quality: float | None = None
    extra_filter: Callable[[], Column] | None = field(default=None, compare=False)

    def with_label(self, column: str) -> "Profile":
        """The same platform with another label column; profiles never change in place."""
        return replace(self, points=replace(self.points, label=column))


# vendors' file and column names and control probes.
_XENIUM_CONTROLS = ("NegControlProbe_", "antisense_", "NegControlCodeword", "BLANK_", "DeprecatedCodeword_", "UnassignedCodeword_")
_XENIUM_POINTS = Points("transcripts.parquet", "x_location", "y_location", "z_location", "feature_name", "transcript_id", "cell_id", "qv", "overlaps_nucleus", 1)
PROFILES = {
    "xenium": Profile("xenium", _XENIUM_POINTS, Outlines("nucleus_boundaries.parquet", "cell_id", "vertex_x", "vertex_y"), _XENIUM_CONTROLS, 20),
    "xenium_v2": Profile("xenium_v2", _XENIUM_POINTS, Outlines("cell_boundaries.parquet", "cell_id", "vertex_x", "vertex_y"), (*_XENIUM_CONTROLS, "Human_"), 20),
    "merscope": Profile("merscope", Points("detected_transcripts.parquet", "global_x", "global_y", "global_z", "gene", "transcript_id", "cell_id", None, "overlaps_nucleus", 1), Outlines("cellpose_nucleus_micron_space.parquet", "EntityID", geometry="Geometry"), ("Blank-", "BLANK")),
    "cosmx": Profile("cosmx", Points("transcripts.parquet", "x_global_px", "y_global_px", "z", "target", "transcript_id", "cell", None, "CellComp", "Nuclear"), Outlines("nucleus_boundaries.parquet", "cell", "x_global_px", "y_global_px"), ("NegPrb_", "SystemControl", "Negative")),
}


def load_profile(name: str) -> Profile:
    """By name, whatever its case; an unknown one raises FileNotFoundError."""
    try:
        return PROFILES[name.lower()]
    except KeyError:
        raise FileNotFoundError(f"no profile {name!r}; there are {', '.join(sorted(PROFILES))}") from None
