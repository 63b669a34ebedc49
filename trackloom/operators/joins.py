"""Alignment joins: nearest, window and containment lookups, keyed merges, table comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import comparable_text, d
from trackloom.operators.ordered import BLOCK, assign_blocks, halo_blocks
from trackloom.session import attach, broadcast_if_small


def nearest_sides(probes: DataFrame, points: DataFrame, groups: Sequence[str], probe_x: str,
                  point_x: str, index: str, tie: str) -> DataFrame:
    """For each probe the last point at or before it and the first at or after it.

    Probes and points are merged along x and cut into blocks; a running max/min
    finds the neighbours inside a block and the per-block extremes carry them
    across. ``tie`` (an id of the probe) spreads many probes at one x. Adds
    ``before`` and ``after`` structs (x, index).
    """
    prior = F.struct(F.col(point_x).alias("x"), (-F.col(index)).alias("k"))
    later = F.struct(F.col(point_x).alias("x"), F.col(index).alias("k"))
    p = probes.select(*groups, F.col(probe_x).alias("_x"),
                      (F.pmod(F.xxhash64(tie), F.lit(1_000_000)) + 1).alias("_tie"),
                      F.struct(*probes.columns).alias("_probe"))
    q = points.select(*groups, F.col(point_x).alias("_x"), F.lit(0).cast("long").alias("_tie"),
                      prior.alias("_prior"), later.alias("_later"))
    both = p.unionByName(q, allowMissingColumns=True)
    blocked = assign_blocks(both, ["_x", "_tie"], groups=groups)
    inside = Window.partitionBy(*groups, BLOCK)
    up = inside.orderBy("_x", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.desc("_x"), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = blocked.df.withColumns({
        "_before": F.max("_prior").over(up), "_after": F.min("_later").over(down),
    }).where(F.col("_probe").isNotNull()).drop("_prior", "_later")
    if not blocked.single:
        edges = blocked.df.groupBy(*groups, BLOCK).agg(
            F.max("_prior").alias("_p"), F.min("_later").alias("_l"))
        by = Window.partitionBy(*groups)
        earlier = by.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        after = by.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        carry = edges.select(*groups, BLOCK, F.max("_p").over(earlier).alias("_cp"),
                             F.min("_l").over(after).alias("_cl"))
        found = attach(found, carry, [*groups, BLOCK]).withColumns({
            "_before": F.coalesce("_before", "_cp"), "_after": F.coalesce("_after", "_cl")})
    before = F.when(F.col("_before").isNotNull(), F.struct(
        F.col("_before.x").alias("x"), (-F.col("_before.k")).alias("k")))
    exact = before["x"] == F.col("_x")
    return found.select("_probe.*", before.alias("before"), F.when(
        exact, before).otherwise(F.col("_after")).alias("after"))


def nearest_position(probes: DataFrame, points: DataFrame, groups: Sequence[str], probe_x: str,
                     point_x: str, index: str, tie: str) -> DataFrame:
    """Nearest point inside [first, last]; equal distances take the lower index.

    Probes outside the support keep NULL answers.
    """
    sides = nearest_sides(probes, points, groups, probe_x, point_x, index, tie)
    x, lo, hi = F.col(probe_x), F.col("before"), F.col("after")
    inside = lo.isNotNull() & hi.isNotNull()
    pick = F.when(inside & (x - lo["x"] <= hi["x"] - x), lo).when(inside, hi)
    return sides.withColumn("_pick", pick).withColumns({
        "selected_x": F.col("_pick.x"), "selected_index": F.col("_pick.k"),
        "coordinate_error": F.abs(F.col("_pick.x") - x)}).drop("before", "after", "_pick")


def window_lookup(probes: DataFrame, points: DataFrame, groups: Sequence[str], probe_x: str,
                  point_x: str, index: str, half_width: float, tie: str) -> DataFrame:
    """Half-open index range of the points in [x-h, x+h]; the nearest point if none.
    Probes outside the support keep NULL answers and say so in ``status``.

    Three ordered lookups per probe (centre, window start, window end) replace a
    range join, so no probe/point pairs are formed.
    """
    spots = F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("at")) for k, e in (
        ("mid", F.col(probe_x)), ("lo", F.col(probe_x) - d(half_width)),
        ("hi", F.col(probe_x) + d(half_width)))])
    long = probes.select(*groups, tie, probe_x, F.explode(spots).alias("_s")).select(
        *groups, tie, probe_x, F.col("_s.kind").alias("kind"), F.col("_s.at").alias("at"))
    sides = nearest_sides(long, points, groups, "at", point_x, index, tie)

    def of(kind: str, side: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(side))).alias(f"{kind}_{side}")

    wide = sides.groupBy(*groups, tie, probe_x).agg(
        of("mid", "before"), of("mid", "after"), of("lo", "after"), of("hi", "before"))
    lo, hi, x = F.col("mid_before"), F.col("mid_after"), F.col(probe_x)
    inside = lo.isNotNull() & hi.isNotNull()
    near = F.when(inside & (x - lo["x"] <= hi["x"] - x), lo).when(inside, hi)
    start, stop = F.col("lo_after"), F.col("hi_before")
    has = start["k"] <= stop["k"]
    first, last = F.when(inside & has, start).otherwise(near), F.when(inside & has, stop).otherwise(near)
    status = F.when(~inside, "outside_support").when(has, "window").otherwise("nearest")
    return wide.select(
        *groups, tie, probe_x, near["x"].alias("selected_x"), F.abs(near["x"] - x).alias("coordinate_error"),
        first["k"].alias("index_start"), (last["k"] + 1).alias("index_end"),
        first["x"].alias("x_start"), last["x"].alias("x_end"), status.alias("status"))


def best_tiles(samples: DataFrame, tiles: DataFrame, key: Sequence[str], x: str, reach: float,
               tile_pixels: int, bin_mm: float, salts: int = 16, groups: Sequence[str] = ()) -> DataFrame:
    """The tile for each sample, and the tile that also holds x +- reach.

    ``key`` names each sample (a repeated key raises); tiles count only for samples of
    equal ``groups``.

    Tiles are copied to the bins they touch, samples have one bin, so the join is
    an equi-join on (bin, salt), broadcast only when a count shows the tiles small. The best tile has the largest distance of the
    point to its edges; the first in tile order wins ties. Samples without a tile
    keep NULL structs ``mapped`` and ``context`` (edge, order, tile_id, u).
    """
    if samples.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{list(key)} does not name the samples")
    left = samples.withColumns({
        "_bin": F.floor(F.col(x) / d(bin_mm)), "_salt": F.pmod(F.xxhash64(*key), F.lit(salts))})
    bins = F.sequence(F.floor(F.col("xmin") / d(bin_mm)), F.floor(F.col("xmax") / d(bin_mm)))
    right = tiles.withColumn("_bin", F.explode(bins)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    joined = left.join(broadcast_if_small(right), [*groups, "_bin", "_salt"], "left")
    u = (F.col(x) - F.col("xmin")) / F.col("px_mm")
    choice = F.struct(F.least(u, d(tile_pixels - 1) - u).alias("edge"),
                      (-F.col("tile_order")).alias("order"), F.col("tile_id"), u.alias("u"))
    holds = (F.col("xmin") <= F.col(x)) & (F.col("xmax") >= F.col(x))
    wide = (F.col("xmin") <= F.col(x) - d(reach)) & (F.col("xmax") >= F.col(x) + d(reach))
    rest = [F.any_value(c).alias(c) for c in samples.columns if c not in key]
    return joined.groupBy(*key).agg(
        *rest, F.max(F.when(holds, choice)).alias("mapped"), F.max(F.when(wide, choice)).alias("context"))


def tile_outcome() -> Column:
    return (
        F.when(F.col("mapped").isNull(), "outside_tiles")
        .when(F.col("context").isNull(), "context_not_supported").otherwise("available")
    )


def override_references(pilot: DataFrame, repeat: DataFrame, adjudicated: DataFrame, key: str,
                        stable_within: float = 0.05) -> DataFrame:
    """Pilot values, overridden by adjudicated ones, with a repeat-stability class.

    Inputs carry ``key``, left and right; missing rows mean no repeat or override.
    """
    r = repeat.select(key, F.col("left").alias("_rl"), F.col("right").alias("_rr"))
    a = adjudicated.select(key, F.col("left").alias("_al"), F.col("right").alias("_ar"),
                           F.lit(True).alias("_has"))
    out = pilot.join(r, key, "left").join(a, key, "left")
    has = F.col("_has").isNotNull()
    left = F.when(has, F.col("_al")).otherwise(F.col("left"))
    right = F.when(has, F.col("_ar")).otherwise(F.col("right"))
    diff = F.abs((F.col("right") - F.col("left")) - (F.col("_rr") - F.col("_rl")))
    return out.select(
        key, F.when(has, "adjudication_1").otherwise("pilot_1").alias("reference_source"),
        (right - left).alias("width"), ((left + right) / 2).alias("centre"),
        diff.alias("repeat_difference"),
        F.when(diff <= d(stable_within), "stable").when(diff > d(stable_within), "ambiguous")
        .otherwise("not_repeated").alias("stability"))


def tolerance_join(left: DataFrame, right: DataFrame, groups: Sequence[str], x: str, other_x: str,
                   tolerance: float, cell: float) -> DataFrame:
    """Pairs with |x - other_x| < tolerance; ``cell`` must exceed the tolerance."""
    touched = F.array_distinct(F.array(F.floor((F.col(other_x) - d(tolerance)) / d(cell)),
                                       F.floor((F.col(other_x) + d(tolerance)) / d(cell))))
    r = right.withColumn("_cell", F.explode(touched))
    out = left.withColumn("_cell", F.floor(F.col(x) / d(cell))).join(r, [*groups, "_cell"])
    return out.where(F.abs(F.col(x) - F.col(other_x)) < d(tolerance)).drop("_cell")


def index_frame(df: DataFrame, groups: Sequence[str], index: str, before: int, after: int,
                payload: Sequence[str], name: str = "frame") -> DataFrame:
    """Map index -> payload of the rows within [-before, +after] index steps.

    One shuffle on (group, chunk) serves every lag and lead, gaps included.
    """
    w = Window.partitionBy(*groups, "_chunk").orderBy(index).rangeBetween(-before, after)
    entries = F.collect_list(F.struct(F.col(index), F.struct(*payload))).over(w)
    halo = halo_blocks(df, groups, index, before, after)
    out = halo.withColumn(name, F.map_from_entries(entries))
    return out.where("_own").drop("_chunk", "_own")


def neighbour_status(df: DataFrame, groups: Sequence[str], index: str, covered: str,
                     payload: Sequence[str]) -> DataFrame:
    """Previous, own and next index of every row with a query status."""
    framed = index_frame(df, groups, index, 1, 1, [covered, *payload])
    long = framed.select(*groups, F.col(index).alias("centre_index"), "frame", F.explode(
        F.sequence(F.col(index) - 1, F.col(index) + 1)).alias(index))
    item = F.try_element_at("frame", F.col(index))
    status = (F.when(item.isNull(), "missing_frame").when(~item[covered], "outside_coverage")
              .otherwise("queryable"))
    return long.select(*groups, "centre_index", index, status.alias("query_status"),
                       *[item[c].alias(c) for c in payload])


def lag_panel(df: DataFrame, groups: Sequence[str], index: str, value: str,
              lags: Sequence[int]) -> DataFrame:
    """One row per (row, lag) whose shifted index exists; positive lags look ahead."""
    framed = index_frame(df, groups, index, -min(lags), max(lags), [value])
    shifts = F.array(*[F.lit(v) for v in lags])
    long = framed.withColumn("lag", F.explode(shifts))
    item = F.try_element_at("frame", F.col(index) + F.col("lag"))
    return (
        long.withColumn("_item", item).where(F.col("_item").isNotNull())
        .withColumn("shifted", F.col("_item")[value]).drop("_item", "frame")
        .withColumn("future", F.col("lag") > 0)
    )


def causal_context(df: DataFrame, groups: Sequence[str], index: str, value: str,
                   counts: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """Mean and change over the current and k previous indices; a missing one is
    replaced by the current row and flagged."""
    framed = index_frame(df, groups, index, max(counts), 0, [value])
    long = framed.withColumn("previous_count", F.explode(F.array(*[F.lit(c) for c in counts])))
    steps = F.sequence(F.col(index) - F.col("previous_count"), F.col(index))
    items = F.transform(steps, lambda i: F.try_element_at("frame", i)[value])
    filled = F.transform(items, lambda v: F.coalesce(v, F.col(value)))
    total = F.aggregate(filled, d(0), lambda acc, v: acc + v)
    return long.select(
        *groups, index, "previous_count", (total / F.size(filled)).alias("context_mean"),
        (F.col(value) - filled[0]).alias("context_change"),
        F.exists(items, lambda v: v.isNull()).alias("padded"))


def table_diff(left: DataFrame, right: DataFrame, key: Sequence[str], exact: Sequence[str] = (),
               tolerance: dict[str, float] | None = None, paths: Sequence[str] = ()) -> DataFrame:
    """Key-aligned differences, long form: key, field, category, expected, observed.

    ``exact`` fields compare null-safe, ``tolerance`` fields within a bound,
    ``paths`` after path normalisation. One-sided keys are a category of their own.
    """
    tolerance = tolerance or {}
    fields = [*exact, *tolerance, *paths]
    a = left.select(*key, F.struct(*fields).alias("_a"))
    b = right.select(*key, F.struct(*fields).alias("_b"))
    both = a.join(b, list(key), "full")

    def row(field: str, bad: Column, category: str) -> Column:
        return F.when(bad, F.struct(
            F.lit(field).alias("field"), F.lit(category).alias("category"),
            F.col("_a")[field].cast("string").alias("expected"),
            F.col("_b")[field].cast("string").alias("observed")))

    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rules = []
    for f in exact:
        rules.append(row(f, present & ~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), "exact"))
    for f, tol in tolerance.items():
        gap = F.abs(F.col("_a")[f] - F.col("_b")[f])
        same = F.coalesce(gap <= d(tol), F.col("_a")[f].isNull() & F.col("_b")[f].isNull())
        rules.append(row(f, present & ~same, "tolerance"))
    for f in paths:
        rules.append(row(f, present & (comparable_text(F.col("_a")[f]) != comparable_text(F.col("_b")[f])), "path"))

    def one_sided(missing: str, category: str) -> Column:
        empty = F.lit(None).cast("string")
        return F.when(F.col(missing).isNull(), F.struct(
            F.lit("row").alias("field"), F.lit(category).alias("category"),
            empty.alias("expected"), empty.alias("observed")))

    rules += [one_sided("_b", "missing_right"), one_sided("_a", "missing_left")]
    return both.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("_r")).select(
        *key, "_r.*")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("field", "category").agg(F.count(F.lit(1)).alias("mismatches"))


def first_mismatches(diff: DataFrame, key: Sequence[str], n: int = 50) -> DataFrame:
    return diff.orderBy(*key, "field", "category").limit(n)


def fold_roles(samples: DataFrame, track: str, tracks: Sequence) -> DataFrame:
    """One row per (fold, sample): the fold's own track validates, the rest train."""
    out = samples.withColumn("fold", F.explode(F.array(*[F.lit(v) for v in tracks])))
    return out.withColumn("role", F.when(
        F.col(track) == F.col("fold"), "validation").otherwise("train"))


def role_leaks(roles: DataFrame, track: str) -> DataFrame:
    """Per (fold, track): number of roles; more than one is a leak."""
    return roles.groupBy("fold", track).agg(
        F.countDistinct("role").alias("roles"), F.count(F.lit(1)).alias("n")).withColumn(
        "leak", F.col("roles") > 1)


def multiset_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in a and only in b (with multiplicity); both zero means equal.

    Counting per distinct row with map-side combine keeps hot values harmless.
    """
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    net = both.groupBy(*cols).agg(F.sum("_s").alias("_net"))
    zero = F.lit(0).cast("long")
    return net.groupBy().agg(
        F.coalesce(F.sum(F.greatest(F.col("_net"), zero)), zero).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), zero)), zero).alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def prediction_consistency(df: DataFrame, sample: Sequence[str], model: str, target: str) -> DataFrame:
    """Samples whose model count or target differs from the rest (violations only)."""
    per = df.groupBy(*sample).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(model).alias("models"),
        F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    return per.groupBy().agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("rows") != F.col("models")).alias("duplicate_rows"),
        F.count_if(F.col("_lo") != F.col("_hi")).alias("target_conflicts"),
        (F.max("models") - F.min("models")).alias("model_count_range"))
