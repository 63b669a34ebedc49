"""Cross-track height profiles: window medians, smoothing, edges, support and labels.

A profile has the fixed number of rows of the sensor, so windows and arrays per
profile are bounded; profiles are spread over the cluster by their key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import centre, d, width
from trackloom.operators.joins import index_frame
from trackloom.operators.ordered import halo_blocks, rolling
from trackloom.operators.raster import gaussian_taps
from trackloom.session import attach, attach_one

# Profile regions in mm and smoothing limits.
CENTRAL = (0.50, 1.45)
LEFT_BAND = (0.05, 0.45)
RIGHT_BAND = (1.50, 1.85)
SIGMA_ROWS = 2.0
MIN_FINITE = 5
MIN_WEIGHT = 0.25
MIN_GRADIENT = 20
#: Rows of profiles that one task sorts at most, about; in small tables fewer, so that all slots work.
TASK_ROWS, SMALL_TASK_ROWS = 250_000, 10_000


def deal(rows: DataFrame, key: Sequence[str], n: int | None = None) -> DataFrame:
    """``rows`` dealt by ``key`` over as many tasks as their number ``n`` (counted if not given) takes.

    Profiles compress so well that partitions merged by their bytes hold millions of rows to sort.
    """
    n = rows.count() if n is None else n
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, math.ceil(n / TASK_ROWS), min(slots, n // SMALL_TASK_ROWS)), *key)


def window_profiles(cells: DataFrame, track: Sequence[str], x_um: str, half_um: Sequence[int],
                    size_um: int = 20_000, rows: int | None = None) -> DataFrame:
    """Median profile over the columns within each half width of every column.

    Sliding frames over integer micrometres on chunks with a halo: each cell is
    shuffled once, whatever the window width. Adds ``run`` (the half width). ``rows`` is
    about the number of cells, here and below counted if not given.
    """
    widest = max(half_um)
    halo = deal(halo_blocks(cells, track, x_um, widest, widest, size_um), [*track, "_chunk", "iy"], rows)
    base = Window.partitionBy(*track, "_chunk", "iy").orderBy(x_um)
    out = halo.withColumns({
        f"_z{h}": F.percentile("z", F.lit(0.5)).over(base.rangeBetween(-h, h)) for h in half_um})
    runs = F.array(*[F.struct(F.lit(h).alias("run"), F.col(f"_z{h}").alias("z")) for h in half_um])
    return out.where("_own").select(
        *track, x_um, "iy", "y_mm", F.explode(runs).alias("_r")).select(
        *track, x_um, "iy", "y_mm", F.col("_r.run").alias("run"), F.col("_r.z").alias("z"))


def slab_valid_fraction(cells: DataFrame, track: Sequence[str], x_um: str, half_um: int) -> DataFrame:
    """Valid share of all cells in the window around each column."""
    per = cells.groupBy(*track, x_um).agg(
        F.count("z").alias("_ok"), F.count(F.lit(1)).alias("_all"))
    halo = halo_blocks(per, track, x_um, half_um, half_um, 20_000)
    w = Window.partitionBy(*track, "_chunk").orderBy(x_um).rangeBetween(-half_um, half_um)
    share = F.sum("_ok").over(w) / F.sum("_all").over(w)
    return halo.withColumn("slab_valid_fraction", share).where("_own").select(
        *track, x_um, "slab_valid_fraction")


def side_detrend(profiles: DataFrame, key: Sequence[str], degree: int, rows: int | None = None) -> DataFrame:
    """Subtract a line or parabola fitted to the two side bands of each profile."""
    y, z = F.col("y_mm"), F.col("z")
    side = z.isNotNull() & (y.between(*[d(v) for v in LEFT_BAND]) | y.between(*[d(v) for v in RIGHT_BAND]))
    by = Window.partitionBy(*key)
    rows = deal(profiles, key, rows).withColumns({"_y0": F.avg(F.when(side, y)).over(by), "_z0": F.avg(F.when(side, z)).over(by)})
    u, v = y - F.col("_y0"), z - F.col("_z0")

    def total(e: Column) -> Column:
        return F.sum(F.when(side, e)).over(by)

    rows = rows.withColumns({"_n": total(d(1)), "_s2": total(u * u), "_s3": total(u * u * u),
                             "_s4": total(u * u * u * u), "_t1": total(u * v), "_t2": total(u * u * v)})
    s2, s3 = F.col("_s2"), F.col("_s3")
    if degree == 1:
        fit = F.col("_z0") + F.try_divide(F.col("_t1"), s2) * u
    else:
        q = F.col("_s4") - s2 * s2 / F.col("_n")
        det = s2 * q - s3 * s3
        b = F.try_divide(F.col("_t1") * q - F.col("_t2") * s3, det)
        c = F.try_divide(F.col("_t2") * s2 - F.col("_t1") * s3, det)
        fit = F.col("_z0") + b * u + c * (u * u - s2 / F.col("_n"))
    return rows.withColumn("z", z - fit).select(*profiles.columns)


def smooth(profiles: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """Gaussian smoothing that skips missing rows: key, iy, y_mm, z, smooth.

    Edges repeat in mirror order; a row keeps a value where enough weight is valid
    and the whole profile has at least five valid rows.
    """
    radius = int(4 * SIGMA_ROWS + 0.5)
    taps = gaussian_taps(SIGMA_ROWS, radius)[radius:]
    whole = Window.partitionBy(*key)
    rows = deal(profiles.select(*key, "iy", "y_mm", "z"), key, rows).withColumns({
        "_n": F.count(F.lit(1)).over(whole), "_valid": F.count("z").over(whole),
        "_i": F.row_number().over(whole.orderBy("iy")) - 1})
    # Mirror copies put every neighbour a frame can reach at its own position.
    i, n = F.col("_i"), F.col("_n")
    short = [p + 2 * n * m for m in range(-radius, radius + 1) for p in (i, -1 - i)]
    spots = F.when(n >= radius, F.array(i.cast("long"), -1 - i.cast("long"), 2 * n - 1 - i)).otherwise(F.array(*short))
    rows = rows.withColumn("_j", F.explode(F.filter(spots, lambda j: (j >= -radius) & (j < n + radius))))
    rows = rows.withColumns({"_v": F.coalesce("z", d(0)), "_w": F.col("z").isNotNull().cast("double")})
    line = whole.orderBy("_j")

    def blend(c: str) -> Column:
        out = d(taps[0]) * F.col(c)
        for k in range(1, radius + 1):
            out = out + d(taps[k]) * (F.lag(c, k).over(line) + F.lead(c, k).over(line))
        return out

    rows = rows.withColumns({"_num": blend("_v"), "_den": blend("_w")}).where(F.col("_j") == F.col("_i"))
    keep = (F.col("_valid") >= MIN_FINITE) & (F.col("_den") > d(MIN_WEIGHT))
    return rows.select(*key, "iy", "y_mm", "z", F.when(keep, F.col("_num") / F.col("_den")).alias("smooth"))


def filled_gradient(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Linear gap fill with edge hold, then the central gradient on uneven y."""
    by = Window.partitionBy(*key).orderBy("iy")
    back = by.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.desc("iy")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("smooth").isNotNull(), F.struct("y_mm", "smooth"))
    rows = rows.withColumns({"_a": F.last(known, True).over(back), "_b": F.last(known, True).over(ahead)})
    a, b, y = F.col("_a"), F.col("_b"), F.col("y_mm")
    line = a["smooth"] + F.try_divide((y - a["y_mm"]) * (b["smooth"] - a["smooth"]), b["y_mm"] - a["y_mm"])
    rows = rows.withColumn("filled", F.coalesce("smooth", line, a["smooth"], b["smooth"])).drop("_a", "_b")
    f, fp, fn = F.col("filled"), F.lag("filled").over(by), F.lead("filled").over(by)
    hs, hd = y - F.lag("y_mm").over(by), F.lead("y_mm").over(by) - y
    inner = (hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fp) / (hs * hd * (hs + hd))
    return rows.withColumn("gradient", F.coalesce(inner, (fn - f) / hd, (f - fp) / hs))


def edge_finder(profiles: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """Left and right edge per profile: steepest rise and fall in the central region.

    The first row wins ties; gradients equal to nine decimals are ties, since a filled
    gap is a straight line. Too few rows or crossed edges give NULL edges and say so.
    """
    rows = filled_gradient(smooth(profiles, key, rows), key)
    mid = 0.5 * sum(CENTRAL)
    y, g, iy = F.col("y_mm"), F.round("gradient", 9), F.col("iy")
    on_left, on_right = y.between(d(CENTRAL[0]), d(mid)), y.between(d(mid), d(CENTRAL[1]))
    best = rows.groupBy(*key).agg(
        F.count("z").alias("finite_count"), F.count("smooth").alias("_ok"),
        F.max(F.when(on_left, F.struct(g.alias("g"), (-iy).alias("i"), y.alias("y"), F.col("z")))).alias("_l"),
        F.min(F.when(on_right, F.struct(g.alias("g"), iy.alias("i"), y.alias("y"), F.col("z")))).alias("_r"))
    status = (F.when(F.col("_ok") < MIN_GRADIENT, "insufficient_finite_profile")
              .when(F.col("_r.i") <= -F.col("_l.i"), "boundaries_cross").otherwise("ok"))
    best = best.withColumn("status", status)
    ok = F.col("status") == "ok"
    left, right = F.when(ok, F.col("_l.y")), F.when(ok, F.col("_r.y"))
    return best.select(
        *key, "finite_count", "status", left.alias("left"), right.alias("right"),
        width(left, right).alias("width"), centre(left, right).alias("centre"),
        F.when(ok, F.abs(F.col("_l.g"))).alias("left_gradient"), F.when(ok, F.abs(F.col("_r.g"))).alias("right_gradient"),
        F.when(ok, F.col("_l.z")).alias("left_height"), F.when(ok, F.col("_r.z")).alias("right_height"))


def band_statistics(profiles: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """Median, scaled MAD, valid share and count of each side band, plus valid shares
    of the profile and its central region."""
    y = F.col("y_mm")
    side = (F.when(y.between(d(LEFT_BAND[0]), d(LEFT_BAND[1])), "left")
            .when(y.between(d(RIGHT_BAND[0]), d(RIGHT_BAND[1])), "right"))
    w = Window.partitionBy(*key, "_side")
    rows = deal(profiles, key, rows).withColumn("_side", side).withColumn("_med", F.percentile("z", F.lit(0.5)).over(w))
    rows = rows.withColumn("_mad", F.percentile(F.abs(F.col("z") - F.col("_med")), F.lit(0.5)).over(w))
    ok = F.col("z").isNotNull().cast("double")
    out = [F.avg(ok).alias("valid_fraction"),
           F.avg(F.when(y.between(d(CENTRAL[0]), d(CENTRAL[1])), ok)).alias("central_valid_fraction")]
    for s in ("left", "right"):
        own = F.col("_side") == s
        out += [F.max(F.when(own, F.col("_med"))).alias(f"{s}_baseline"),
                F.max(F.when(own, d(1.4826) * F.col("_mad"))).alias(f"{s}_noise"),
                F.avg(F.when(own, ok)).alias(f"{s}_valid_fraction"),
                F.count(F.when(own, F.col("z"))).alias(f"{s}_valid_count")]
    return rows.groupBy(*key).agg(*out)


def edge_support(profiles: DataFrame, edges: DataFrame, key: Sequence[str], radius: float = 0.10,
                 rows: int | None = None) -> DataFrame:
    """Around each edge: longest valid and missing run (mm), valid count, and the
    distance to the nearest missing row of the whole profile."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("at")) for s in ("left", "right")])
    spots = edges.where("status = 'ok'").select(*key, F.explode(sides).alias("_s")).select(*key, "_s.side", "_s.at")
    by = Window.partitionBy(*key).orderBy("iy")
    steps = deal(profiles, key, rows).withColumn("_dy", F.col("y_mm") - F.lag("y_mm").over(by))
    steps = steps.withColumn("_dy", F.percentile("_dy", F.lit(0.5)).over(Window.partitionBy(*key)))
    rows = steps.join(spots, list(key)).withColumns({
        "_ok": F.col("z").isNotNull(),
        "_near": (F.col("y_mm") >= F.col("at") - d(radius)) & (F.col("y_mm") <= F.col("at") + d(radius))})
    near = Window.partitionBy(*key, "side", "_near").orderBy("iy")
    same = Window.partitionBy(*key, "side", "_near", "_ok").orderBy("iy")
    rows = rows.withColumn("_island", F.row_number().over(near) - F.row_number().over(same))
    pieces = rows.groupBy(*key, "side", "_near", "_ok", "_island").agg(
        F.count(F.lit(1)).alias("_len"), F.max("_dy").alias("_dy"),
        F.min(F.when(~F.col("_ok"), F.abs(F.col("y_mm") - F.col("at")))).alias("_gap"))
    dy = F.max("_dy")
    good, hole = F.col("_near") & F.col("_ok"), F.col("_near") & ~F.col("_ok")
    zero = F.lit(0).cast("long")
    return pieces.groupBy(*key, "side").agg(
        (F.coalesce(F.max(F.when(good, F.col("_len"))), zero) * dy).alias("longest_valid_mm"),
        (F.coalesce(F.max(F.when(hole, F.col("_len"))), zero) * dy).alias("longest_gap_mm"),
        F.coalesce(F.sum(F.when(good, F.col("_len"))), zero).alias("support_count"),
        F.min("_gap").alias("nearest_missing_mm"))


def run_spread(edges: DataFrame, key: Sequence[str], run: str, base_run: str, widths: Sequence[str],
               alternates: Sequence[str], values: Sequence[str] = ("width", "centre")) -> DataFrame:
    """Spread of ``values``, as width and centre, over the aggregation widths (two or more needed), and
    the largest distance of the base run from the alternates; NULL without a base edge."""
    out = []
    for v in values:
        own = F.when(F.col(run).isin(*widths), F.col(v))
        base = F.max(F.when(F.col(run) == base_run, F.col(v)))
        known = base.isNotNull() & (F.count(own) >= 2)
        out.append(F.when(known, F.max(own) - F.min(own)).alias(f"{v}_sensitivity"))
        alt = F.when(F.col(run).isin(*alternates), F.col(v))
        out.append(F.greatest(F.max(alt) - base, base - F.min(alt)).alias(f"{v}_disagreement"))
    return edges.groupBy(*key).agg(*out)


def neighbour_continuity(edges: DataFrame, groups: Sequence[str], index: str, value: str) -> DataFrame:
    """Mean distance to the two adjacent positions and the MAD of the trio."""
    framed = index_frame(edges, groups, index, 1, 1, [value])
    near = F.filter(F.array(*[F.try_element_at("frame", F.col(index) + k)[value] for k in (-1, 1)]),
                    lambda v: v.isNotNull())
    framed = framed.withColumns({"_near": near})
    trio = F.array_sort(F.filter(F.concat(F.array(F.col(value)), F.col("_near")), lambda v: v.isNotNull()))

    def median(a: Column) -> Column:
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    framed = framed.withColumn("_trio", trio).withColumn("_mid", median(F.col("_trio")))
    spread = F.array_sort(F.transform("_trio", lambda v: F.abs(v - F.col("_mid"))))
    total = F.aggregate("_near", d(0), lambda acc, v: acc + F.abs(v - F.col(value)))
    return framed.select(
        *groups, index, F.size("_near").alias("neighbours"),
        F.when(F.col(value).isNotNull() & (F.size("_near") > 0), total / F.size("_near")).alias("neighbour_difference"),
        F.when(F.size("_trio") >= 2, median(spread)).alias("neighbourhood_mad"))


def repeated_values(rows: DataFrame, value: str, decimals: int = 6) -> DataFrame:
    """Count of equal rounded values; the largest value is the cap, flagged when seen
    three times or more. Counting is a partial aggregate over distinct values."""
    rows = rows.withColumn("_k", F.round(value, decimals))
    counts = rows.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("repeat_count"))
    cap = counts.groupBy().agg(F.max("_k").alias("_cap"))
    out = attach_one(attach(rows, counts, ["_k"]), cap)
    return out.withColumns({
        "repeat_count": F.coalesce("repeat_count", F.lit(0).cast("long")),
        "cap_flag": F.coalesce((F.col("_k") == F.col("_cap")) & (F.col("repeat_count") >= 3), F.lit(False)),
        "cap_distance": F.col("_cap") - F.col("_k")}).drop("_k", "_cap")


def valid_run_labels(fractions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges of the longest run of valid-share above its mid level, to sub-row precision.

    ``fractions`` has key, iy (0-based, dense), y_mm and v. The share is smoothed
    with a 5-row box that counts rows beyond the ends as zero; contrast, contact
    with the ends and the width decide eligibility.
    """
    by = Window.partitionBy(*key)
    line = by.orderBy("iy")
    rows = fractions.withColumn("_v", F.sum("v").over(line.rowsBetween(-2, 2)) / d(5))
    rows = rows.withColumns({"_p": F.percentile("_v", F.array(d(.10), d(.90))).over(by),
                             "_n": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("_thr", (F.col("_p")[0] + F.col("_p")[1]) / 2)
    rows = rows.withColumns({"_pv": F.lag("_v").over(line), "_py": F.lag("y_mm").over(line),
                             "_nv": F.lead("_v").over(line), "_ny": F.lead("y_mm").over(line),
                             "_above": F.col("_v") > F.col("_thr")})
    island = F.row_number().over(line) - F.row_number().over(Window.partitionBy(*key, "_above").orderBy("iy"))
    rows = rows.withColumn("_island", island)
    thr = F.col("_thr")
    cross_l = F.coalesce(F.col("_py") + F.try_divide(thr - F.col("_pv"), F.col("_v") - F.col("_pv")) * (F.col("y_mm") - F.col("_py")), F.col("y_mm"))
    cross_r = F.coalesce(F.col("y_mm") + F.try_divide(thr - F.col("_v"), F.col("_nv") - F.col("_v")) * (F.col("_ny") - F.col("y_mm")), F.col("y_mm"))
    rows = rows.withColumns({"_cl": cross_l, "_cr": cross_r})
    runs = rows.where("_above").groupBy(*key, "_island").agg(
        F.count(F.lit(1)).alias("len"), F.min(F.struct("iy", "_cl")).alias("s"), F.max(F.struct("iy", "_cr")).alias("e"))
    best = runs.groupBy(*key).agg(F.max(F.struct("len", (-F.col("s.iy")).alias("o"), "s", "e")).alias("b"))
    level = rows.groupBy(*key).agg(F.max("_n").alias("_n"), (F.max(F.col("_p")[1]) - F.max(F.col("_p")[0])).alias("contrast"))
    out = level.join(best, list(key), "left")
    w = F.col("b.e._cr") - F.col("b.s._cl")
    fits = ((F.col("contrast") >= d(0.40)) & (F.col("b.s.iy") >= 3) & (F.col("b.e.iy") <= F.col("_n") - 4)
            & (w >= d(0.2)) & (w <= d(1.8)))
    ok = F.coalesce(fits, F.lit(False))
    return out.select(*key, "contrast", ok.alias("eligible"), F.when(ok, w).alias("width"),
                      F.when(ok, F.col("b.s._cl")).alias("left"), F.when(ok, F.col("b.e._cr")).alias("right"))


def relief_and_area(profiles: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """p90 height and trapezoid area of each profile after the side-band line is removed."""
    rows = side_detrend(profiles, key, 1, rows).where(F.col("z").isNotNull())
    line = Window.partitionBy(*key).orderBy("iy")
    slab = (F.lead("y_mm").over(line) - F.col("y_mm")) * (F.lead("z").over(line) + F.col("z")) / 2
    return rows.withColumn("_s", slab).groupBy(*key).agg(
        F.percentile("z", F.lit(0.9)).alias("relief_p90"), F.sum("_s").alias("area"))


def contour_roughness(rows: DataFrame, groups: Sequence[str], index: str, b: str, x: str) -> DataFrame:
    """Edge roughness, waviness and deviation from the group's line along a dense index.

    Window lengths are ours: 2 mm and 10 mm means are 11 and 51 rows of the 0.2 mm
    grid, the spreads run over 11 and 51 rows, all cut at the ends.
    """
    s = rolling(rows, groups, index, 5, 5, {"_s2": F.avg(b)})
    s = rolling(s, groups, index, 25, 25, {"_s10": F.avg(b)})
    s = s.withColumns({"_fine": F.col(b) - F.col("_s2"), "_wave": F.col("_s2") - F.col("_s10")})
    s = rolling(s, groups, index, 5, 5, {"roughness": F.stddev_pop("_fine")})
    s = rolling(s, groups, index, 25, 25, {"waviness": F.stddev_pop("_wave")})
    line = rows.groupBy(*groups).agg(F.regr_slope(b, x).alias("_k"), F.regr_intercept(b, x).alias("_c"))
    s = attach(s, line, groups)
    return s.select(*groups, index, "roughness", "waviness",
                    F.abs(F.col(b) - (F.col("_c") + F.col("_k") * F.col(x))).alias("deviation"))
