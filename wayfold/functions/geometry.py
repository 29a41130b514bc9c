"""Distances and maps of the plane and the Poincare disk as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: The four matched radii and the largest of them.
RADII = (0.50, 0.70, 0.85, 0.95)


def euclidean(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return F.hypot(ux - vx, uy - vy)


def poincare(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """2 asinh(|u-v| / sqrt((1-|u|^2)(1-|v|^2))), accurate for near-coincident points (Spark's asinh isn't); null outside the open disk."""
    def gap(x: Column, y: Column) -> Column:
        r = F.hypot(x, y)
        return F.sqrt((1 - r) * (1 + r))

    z = F.hypot(ux - vx, uy - vy) / (gap(ux, uy) * gap(vx, vy))
    inside = (F.hypot(ux, uy) < 1) & (F.hypot(vx, vy) < 1)
    return F.when(inside, 2 * F.log1p(z + z * z / (1 + F.sqrt(1 + z * z))))


def distance(metric: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """By the name in metric: 'euclidean' or 'poincare'."""
    return F.when(metric == "poincare", poincare(ux, uy, vx, vy)).otherwise(euclidean(ux, uy, vx, vy))


def mobius_add(ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column]:
    dot, u2, v2 = ux * vx + uy * vy, ux * ux + uy * uy, vx * vx + vy * vy
    a, b, below = 1 + 2 * dot + v2, 1 - u2, 1 + 2 * dot + u2 * v2
    return (a * ux + b * vx) / below, (a * uy + b * vy) / below


def log_map(bx: Column, by: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Tangent vector at b that leads to p."""
    x, y = mobius_add(-bx, -by, px, py)
    r = F.hypot(x, y)
    scale = F.when(r > 0, (1 - bx * bx - by * by) * F.atanh(r) / r).otherwise(F.lit(0.0))
    return scale * x, scale * y


def exp_map(bx: Column, by: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    r = F.hypot(tx, ty)
    scale = F.when(r > 0, F.tanh(r / (1 - bx * bx - by * by)) / r).otherwise(F.lit(0.0))
    return mobius_add(bx, by, scale * tx, scale * ty)


def project_to_disk(x: Column, y: Column, epsilon: float = 1e-12) -> tuple[Column, Column]:
    """Radial clamp to norm 1 - epsilon."""
    r, safe = F.hypot(x, y), 1 - epsilon
    scale = F.when(r < safe, F.lit(1.0)).otherwise(F.lit(safe) / r)
    return x * scale, y * scale


def euclidean_tolerance(radius: Column) -> Column:
    return 64 * EPSILON * radius


def poincare_tolerance(radius: Column) -> Column:
    return 64 * EPSILON * F.greatest(F.lit(1.0), 4 * F.atanh(radius))


def scaled_tolerance(tolerance: float, radius: Column, largest: float = 0.95) -> Column:
    """The first protocol's rule for rescaled plane coordinates."""
    return F.lit(tolerance) * radius / F.lit(largest)


def interval_status(low: Column, high: Column, margin: float) -> list[Column]:
    """Five booleans of an interval in percentage points against +-margin: closed inside, strict outside."""
    inside = (low >= -margin) & (high <= margin)
    return [inside.alias("within_margin"), (low > 0).alias("positive"), (high < 0).alias("negative"), (low > margin).alias("above_margin"), (high < -margin).alias("below_margin")]


def interval_label(low: Column, high: Column, margin: float) -> Column:
    return (F.when((low >= -margin) & (high <= margin), "practically_equivalent").when(low > 0, "positive").when(high < 0, "negative").otherwise("unresolved"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Estimate with its status: a zero denominator is undefined, a null one not applicable."""
    return F.struct(
        F.try_divide(numerator.cast("double"), denominator.cast("double")).alias("estimate"),
        F.when(denominator.isNull(), "not_applicable").when(denominator == 0, "undefined").otherwise("defined").alias("status"),
        F.when(denominator.isNull(), "design_exclusion").when(denominator == 0, "undefined_zero_denominator").alias("na_reason"),
    )


def distance_band(d: Column) -> Column:
    return F.when(d <= 4, d.cast("string")).otherwise(">=5")
