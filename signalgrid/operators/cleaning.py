"""Row-level cleaning rules and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def numeric(column) -> Column:
    """Text to number; anything unreadable is null."""
    return F.nanvl(_c(column).try_cast("double"), F.lit(None).cast("double"))


def wall_region(walls) -> Column:
    w = F.coalesce(_c(walls), F.lit(0))
    return F.when(w <= 0, "0_walls").when(w <= 2, "1-2_walls").otherwise("3+_walls")


# Accepted spellings (fixed values of the input contract).
LOS_WORDS = ("1", "true", "yes", "y", "los", "line_of_sight", "line-of-sight")
NLOS_WORDS = ("0", "false", "no", "n", "nlos", "non_los", "non-los", "nlos_")
BLANK_WORDS = ("", "nan", "none")


def los_label(column) -> Column:
    """Free-text visibility to LOS / NLOS; unknown words stay as they are, blanks become null."""
    raw = _c(column).cast("string")
    word = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull() | word.isin(*BLANK_WORDS), F.lit(None).cast("string"))
        .when(word.isin(*LOS_WORDS), "LOS")
        .when(word.isin(*NLOS_WORDS) | word.contains("nlos") | word.contains("non"), "NLOS")
        .when(word.contains("los"), "LOS")
        .otherwise(raw)
    )


def los_from_walls(walls: Sequence[str]) -> Column:
    total = sum((F.coalesce(F.col(w), F.lit(0.0)) for w in walls), F.lit(0.0))
    return F.when(total > 0, "NLOS").otherwise("LOS")


def frequency_hz(df: DataFrame, column: str, header: str, default_hz: float = 3.5e9) -> DataFrame:
    """Frequency column in Hz: unit from the header, else from the size of the column's median."""
    value = numeric(column)
    name = header.lower()
    unit = next((f for u, f in (("ghz", 1e9), ("mhz", 1e6), ("khz", 1e3), ("hz", 1.0)) if u in name), None)
    if unit is None:
        # A median over the whole column is found by narrowing, not by sorting in one task.
        from signalgrid.operators.percentiles import exact_percentiles

        one = df.select(value.alias("_f"), F.lit(0).alias("_k")).where("_f IS NOT NULL")
        found = exact_percentiles(one, ["_k"], "_f", {"m": 0.5}).select("m").first()
        median = found["m"] if found else None
        unit = 1.0 if median is None or median >= 1e6 else 1e6 if median >= 1e3 else 1e9
    return df.withColumn(column, F.coalesce(value * unit, F.lit(float(default_hz))))


def wall_mask(reflectance="reflectance", transmittance="transmittance", threshold: float = 1e-6) -> Column:
    return (F.abs(_c(reflectance)) > threshold) | (F.abs(_c(transmittance)) > threshold)


def usable_point(target="pl_db", distance="distance_m") -> Column:
    """Finite target and finite positive distance (NaN sorts above infinity)."""
    d = _c(distance)
    return F.coalesce((F.abs(_c(target)) < float("inf")) & (d > 0) & (d < float("inf")), F.lit(False))


def reject_reason(walls: Sequence[str], anomaly: dict[str, object] | None = None) -> Column:
    """First rule a point row breaks, or null: missing target or distance, missing walls, known anomaly."""
    missing_walls = F.lit(False)
    for w in walls:
        missing_walls = missing_walls | F.col(w).isNull()
    rule = F.when(~usable_point(), "invalid_path_loss_or_distance").when(missing_walls, "missing_wall_counts")
    if anomaly:
        hit = F.lit(True)
        for name, value in anomaly.items():
            hit = hit & (F.col(name) == F.lit(value))
        rule = rule.when(hit, "known_anomaly")
    return rule


def missing_columns(columns: Sequence[str]) -> Column:
    """Names of the null columns of a row, joined by commas."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
