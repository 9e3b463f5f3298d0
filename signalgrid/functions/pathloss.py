"""Per-cell propagation arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FSPL_CONSTANT_DB = 147.55


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def _d(value: float) -> Column:
    return F.lit(float(value))


def distance_m(x="x", y="y", tx_x="tx_x", tx_y="tx_y", resolution_m="resolution_m", min_distance_m=0.25) -> Column:
    """Euclidean distance from the unrounded transmitter, floored at the minimum."""
    dx, dy = _c(x) - _c(tx_x), _c(y) - _c(tx_y)
    return F.greatest(F.sqrt(dx * dx + dy * dy) * _c(resolution_m), _c(min_distance_m).cast("double"))


def fspl_db(distance="distance_m", frequency="frequency_hz", min_distance_m: float = 1e-3) -> Column:
    """Free-space path loss in dB."""
    d = F.greatest(_c(distance), _d(min_distance_m))
    return 20.0 * F.log10(d) + 20.0 * F.log10(F.greatest(_c(frequency), _d(1.0))) - FSPL_CONSTANT_DB


def log_distance(distance="distance_m", d0: float = 1.0, min_distance_m: float = 0.25) -> Column:
    """Ten times the decades travelled beyond the reference distance."""
    return 10.0 * F.log10(F.greatest(_c(distance), _d(min_distance_m)) / _d(max(d0, 1e-6)))


def normalised(position, size) -> Column:
    """Pixel position scaled to [0, 1] over a raster side."""
    return _c(position) / F.greatest(F.lit(1), _c(size) - 1)


def edge_overflow(tx_x="tx_x", tx_y="tx_y", width="width", height="height", resolution_m="resolution_m",
                  tolerance_px: float = 5.0) -> dict[str, Column]:
    """How far a transmitter lies outside its raster, edge by edge."""
    zero = _d(0.0)
    left = F.greatest(-_c(tx_x), zero)
    right = F.greatest(_c(tx_x) - (_c(width) - 1), zero)
    top = F.greatest(-_c(tx_y), zero)
    bottom = F.greatest(_c(tx_y) - (_c(height) - 1), zero)
    worst = F.greatest(left, right, top, bottom)
    return {
        "over_left_px": left, "over_right_px": right, "over_top_px": top, "over_bottom_px": bottom,
        "max_clip_px": worst, "max_clip_m": worst * _c(resolution_m),
        "out_of_bounds": worst > 0,
        "within_tolerance": (worst > 0) & (worst <= tolerance_px),
        "would_reject": worst > tolerance_px,
    }


def snap_to_edge(position, size, tolerance_px: float = 5.0) -> Column:
    """Move a position just outside the raster to its nearest edge; null when too far."""
    p, last = _c(position).cast("double"), (_c(size) - 1).cast("double")
    return (
        F.when((p >= 0) & (p <= last), p)
        .when((p < 0) & (p >= -tolerance_px), 0.0)
        .when((p > last) & (p <= last + tolerance_px), last)
    )


def improvement_percent(base, value) -> Column:
    """Relative gain over a base value in percent; null for a zero or missing base."""
    b = _c(base)
    return 100.0 * (b - _c(value)) / F.nullif(b, F.lit(0.0))
