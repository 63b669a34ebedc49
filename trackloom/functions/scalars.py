"""Scalar rules as Column expressions: typing, eligibility, pixel and position maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The position grid and sensor geometry.
X_START_MM = 20.0
X_END_MM = 100.0
MM_PER_FRAME = 0.2
FRAMES = 400
THERMAL_PIXEL_MM = 0.014
HEIGHT_PIXEL_MM = 0.003982
HEIGHT_UNIT_MM = 1e-6
MASK_HALF_MM = 0.40
CONTEXT_MM = 1.00
QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)
NORMAL_QUANTILES = (-1.6448536269514722, -0.6744897501960817, 0.0,
                    0.6744897501960817, 1.6448536269514722)
ISOTHERM_LEVELS = (1300, 1400, 1500, 1600, 1800)


def d(value: float) -> Column:
    """A DOUBLE literal."""
    return F.lit(float(value))


def truth(c: Column) -> Column:
    """Text to boolean: true, 1 and yes in any case; anything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def finite_number(c: Column, default: float | None = None) -> Column:
    """Text or number to DOUBLE; empty, 'Bad', NaN and infinities become the default."""
    v = c.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(ok, v).otherwise(F.lit(default).cast("double"))


def finite(c: Column) -> Column:
    return finite_number(c).isNotNull()


def sample_id(track: Column, segment: Column) -> Column:
    return F.format_string("T%d_F%03d", track, segment)


def natural_key(c: Column) -> Column:
    """Sort key in which digit groups compare as numbers ('tile2' before 'tile10')."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def width(left: Column, right: Column) -> Column:
    return finite_number(right) - finite_number(left)


def centre(left: Column, right: Column) -> Column:
    return (finite_number(left) + finite_number(right)) / 2


def powers(x: Column, degree: int) -> list[Column]:
    """x, x^2, ... by repeated products."""
    out = [x]
    for _ in range(degree - 1):
        out.append(out[-1] * x)
    return out


def position_mm(segment: Column) -> Column:
    """Centre of a grid bin."""
    return d(X_START_MM) + d(MM_PER_FRAME) * (segment + d(0.5))


def frame_position_mm(index: Column, stop: Column) -> Column:
    """Position of a raw frame, counted back from the end of the active run."""
    return d(X_END_MM) - ((stop - index) - d(0.5)) * d(MM_PER_FRAME)


def grid_bin(x: Column) -> Column:
    """Half-open bin number on the position grid."""
    return F.floor((x - d(X_START_MM)) / d(MM_PER_FRAME))


def region(x: Column, last_edge: float = 100.1) -> Column:
    """20 mm regions, left-closed; the last one also takes x = 100 and rounding beyond it."""
    return (
        F.when((x >= 20) & (x < 40), "20_40mm").when((x >= 40) & (x < 60), "40_60mm")
        .when((x >= 60) & (x < 80), "60_80mm").when((x >= 80) & (x < d(last_edge)), "80_100mm")
    )


def eligibility_reason(finite_ok: Column, ordered: Column, excluded: Column) -> Column:
    """First failing rule, '' when eligible."""
    return (
        F.when(~finite_ok, "estimator_nonfinite").when(~ordered, "invalid_boundary_order")
        .when(excluded, "estimator_exclusion").otherwise("")
    )


def support_policies(eligible: Column, local: Column, left: Column, right: Column) -> dict[str, Column]:
    """The four label policies over local and two-sided support fractions."""
    near = F.coalesce(local, d(0)) >= 0.5
    sides = (F.coalesce(left, d(0)) >= 0.5) & (F.coalesce(right, d(0)) >= 0.5)
    return {
        "all_finite_height_estimator_v1": eligible,
        "local_valid_ge_0p50": eligible & near,
        "side_support_ge_0p50": eligible & sides,
        "local_and_side_support_ge_0p50": eligible & near & sides,
    }


def pixel_position(x: Column, xmin: Column, xmax: Column, px: Column, increasing: Column) -> Column:
    return F.when(increasing, (x - xmin) / px).otherwise((xmax - x) / px)


def pixel_bounds(a: Column, b: Column, size: Column, retained: bool) -> tuple[Column, Column]:
    """Half-open pixel range of [a, b]: a mask rounds outward, kept context inward."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    lower = F.ceil(lo) if retained else F.floor(lo)
    upper = F.floor(hi) if retained else F.ceil(hi)
    return F.greatest(F.lit(0).cast("long"), lower), F.least(size.cast("long"), upper)


def bounds_text(a: Column, b: Column) -> Column:
    return F.concat_ws(":", a.cast("string"), b.cast("string"))


def mosaic_pixel(x: Column, px: Column) -> Column:
    return (x - d(X_START_MM)) / px


def tag_value(tag: Column, label: str) -> Column:
    """Number after 'label =' in an image text tag."""
    return F.regexp_extract(tag, rf"(?i){label}\s*=\s*([-+0-9.]+)", 1).try_cast("double")


def comparable_text(c: Column) -> Column:
    """NULL as '' and one path separator, for table comparison."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\\", "/"), F.lit(""))


def fixed_key(x: Column, decimals: int) -> Column:
    """Integer key of x rounded to n decimals."""
    return F.round(x * d(10 ** decimals)).cast("long")


def change(value: Column, base: Column) -> tuple[Column, Column]:
    """Absolute and relative change against a baseline."""
    return value - base, F.try_divide(value - base, base)


def pinball(y: Column, p: Column, q: float) -> Column:
    u = y - p
    return F.greatest(d(q) * u, d(q - 1) * u)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL for two rows or fewer or a constant side."""
    varies = (F.count(F.lit(1)) > 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(
        F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
