"""Linear, quantile and logistic models from distributed sums.

A fit needs one pass: the moments Sum z_i z_j of z = (1, features, target) per
track. Training moments of any fold are the total minus the held-out tracks, so
folds, feature subsets and penalties cost no further pass; a small vectorised
solve turns each moment row into coefficients. Iterative fits make one aggregate
pass per step over a table written once.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.scalars import d
from trackloom.operators.labels import training_folds
from trackloom.operators.metrics import sorted_quantiles
from trackloom.operators.ordered import quantile_columns
from trackloom.session import attach, attach_one, bounded, materialize, pack

# Workers get the small solvers with the task, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pairs(p: int) -> list[tuple[int, int]]:
    """Upper triangle of the (1, features, target) moment matrix."""
    return [(i, j) for i in range(p + 2) for j in range(i, p + 2)]


def feature_centres(df: DataFrame, features: Sequence[str]) -> list[float]:
    """One mean per feature, subtracted before summing to keep the sums accurate."""
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return [float(v) if v is not None else 0.0 for v in row]


def moments(df: DataFrame, groups: Sequence[str], features: Sequence[str], y: str,
            centres: Sequence[float]) -> DataFrame:
    """Moment sums per group as columns _m0, _m1, ... (partial aggregation only).

    Rows with a missing feature or target take no part in any sum, so all sums are over
    the same rows; ``vector_ridge`` imputes instead.
    """
    z = [d(1)] + [F.col(f) - d(c) for f, c in zip(features, centres)] + [F.col(y)]
    sums = [F.sum(z[i] * z[j]).alias(f"_m{k}") for k, (i, j) in enumerate(_pairs(len(features)))]
    return df.where(_complete([*features, y])).groupBy(*groups).agg(*sums)


def _complete(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def _require_complete(df: DataFrame, columns: Sequence[str]) -> None:
    if df.where(~_complete(columns)).limit(1).count():
        raise ValueError(f"missing values in {list(columns)}: impute or drop them before the fit")


def _moment_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_m")]


def leave_one_out(per_track: DataFrame, track: str) -> DataFrame:
    """Training moments per held-out track: total minus the track's own."""
    cols = _moment_columns(per_track)
    total = per_track.agg(*[F.sum(c).alias("t" + c) for c in cols])
    rows = attach_one(per_track, total)
    return rows.select(F.col(track).alias("held_out"), *[(F.col("t" + c) - F.col(c)).alias(c) for c in cols])


def leave_two_out(per_track: DataFrame, track: str) -> DataFrame:
    """Training moments per (outer, inner) pair of distinct held-out tracks.

    The pairs are those of whole tracks, the folds of nested validation; rows are
    never paired.
    """
    cols = _moment_columns(per_track)
    outer = leave_one_out(per_track, track)
    ids = per_track.agg(F.collect_set(track).alias("_ids"))
    inner = attach_one(outer, ids).withColumn("inner", F.explode("_ids")).where(
        F.col("inner") != F.col("held_out")).drop("_ids")
    own = per_track.select(F.col(track).alias("inner"), *[F.col(c).alias("o" + c) for c in cols])
    return inner.join(own, "inner").select(
        "held_out", "inner", *[(F.col(c) - F.col("o" + c)).alias(c) for c in cols])


def with_specs(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Each moment row once per model spec (spec_id, use: feature indices, alpha, complexity)."""
    items = F.array(*[F.struct(
        F.lit(s["spec_id"]).alias("spec_id"), F.array(*[F.lit(i) for i in s["use"]]).cast("array<int>").alias("use"),
        d(s.get("alpha", 0.0)).alias("alpha"), F.lit(s.get("complexity", 0)).alias("complexity")) for s in specs])
    return df.withColumn("_spec", F.explode(items)).select("*", "_spec.*").drop("_spec")


def _symmetric(m: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p + 2, p + 2))
    for v, (i, j) in zip(m, _pairs(p)):
        out[i, j] = out[j, i] = v
    return out


def _ridge(full: np.ndarray, use: Sequence[int], alpha: float, penalise_intercept: bool,
           floor: float, target: np.ndarray | None = None) -> np.ndarray:
    """Raw-space (intercept, coefficient per feature; 0 where unused) from moments.

    ``target`` is the moment vector of the fitted target with (1, features); the
    last row of the matrix by default.
    """
    p = full.shape[0] - 2
    t = full[: p + 1, p + 1] if target is None else target
    n, out = full[0, 0], np.zeros(p + 1)
    idx = [i + 1 for i in use]
    mean = full[0, idx] / n
    cov = full[np.ix_(idx, idx)] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(scale < floor, 1.0, scale)
    out[0] = t[0] / (n + alpha) if penalise_intercept else t[0] / n
    if idx:
        gram = n * cov / np.outer(scale, scale)
        rhs = (t[idx] - mean * t[0]) / scale
        coef = np.linalg.solve(gram + alpha * np.eye(len(idx)), rhs) / scale
        out[idx] = coef
        out[0] -= coef @ mean
    return out


def _uncentre(beta: np.ndarray, centres: Sequence[float]) -> list[float]:
    out = beta.copy()
    out[0] -= float(np.dot(beta[1:], centres))
    return out.tolist()


def ridge_models(rows: DataFrame, p: int, centres: Sequence[float], penalise_intercept: bool = False,
                 floor: float = 1e-12) -> DataFrame:
    """Solve each (moments, use, alpha) row: adds ``beta`` = intercept and raw coefficients.

    Features are standardised by their training moments; the penalty covers the
    intercept or not, the two published conventions. No features means the mean.
    """
    cols = _moment_columns(rows)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(m: pd.Series, use: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series([
            _uncentre(_ridge(_symmetric(a, p), list(u), al, penalise_intercept, floor), centres)
            for a, u, al in zip(m, use, alpha)])

    return rows.withColumn("beta", solve(F.array(*cols), F.col("use"), F.col("alpha"))).drop(*cols)


def residual_models(rows: DataFrame, p: int, centres: Sequence[float], base: Sequence[int],
                    base_alpha: float, floor: float = 1e-8) -> DataFrame:
    """Ridge on ``base`` features, then a ridge of its residual on each spec's features.

    The residual's moments follow from the joint ones, so both fits share a pass.
    Adds ``base_beta`` and ``beta`` (base plus correction).
    """
    cols = _moment_columns(rows)
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("base_beta", "beta")])

    @F.pandas_udf(schema)
    def solve(m: pd.Series, use: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        first, both = [], []
        for a, u, al in zip(m, use, alpha):
            full = _symmetric(a, p)
            b = _ridge(full, list(base), base_alpha, True, floor)
            left = full[: p + 1, p + 1] - full[: p + 1, : p + 1] @ b
            c = _ridge(full, list(u), al, True, floor, left)
            first.append(_uncentre(b, centres))
            both.append(_uncentre(b + c, centres))
        return pd.DataFrame({"base_beta": first, "beta": both})

    return rows.withColumn("_s", solve(F.array(*cols), F.col("use"), F.col("alpha"))).select(
        *[c for c in rows.columns if c not in cols], "_s.*")


def linear(beta: str, features: Sequence[str]) -> Column:
    """Intercept plus dot product, unrolled so it stays in generated code."""
    out = F.col(beta)[0]
    for i, f in enumerate(features):
        out = out + F.col(beta)[i + 1] * F.col(f)
    return out


def score_held_out(df: DataFrame, models: DataFrame, track: str, features: Sequence[str]) -> DataFrame:
    """Out-of-fold predictions: every row under each model that held its track out."""
    keyed = models.withColumnRenamed("held_out", track)
    return attach(df, keyed, [track], "inner").withColumn("p", linear("beta", features))


def fold_errors(df: DataFrame, models: DataFrame, track: str, features: Sequence[str], y: str,
                keys: Sequence[str]) -> DataFrame:
    """MAE of each model on the rows of its held-out track, one pass for all models."""
    return score_held_out(df, models, track, features).groupBy(*keys).agg(
        F.avg(F.abs(F.col("p") - F.col(y))).alias("mae"))


def nested_choice(df: DataFrame, track: str, features: Sequence[str], y: str, specs: Sequence[dict],
                  penalise_intercept: bool = True, floor: float = 1e-8,
                  largest_alpha: bool = False) -> tuple[DataFrame, DataFrame]:
    """Whole-track nested selection: (chosen spec per outer fold, all inner scores).

    Ties go to the lower complexity, then the smaller (or, for a lock, larger) alpha.
    """
    centres = feature_centres(df, features)
    per = materialize(moments(df, [track], features, y, centres))
    inner = ridge_models(with_specs(leave_two_out(per, track), specs), len(features), centres,
                         penalise_intercept, floor)
    models = inner.withColumnRenamed("held_out", "outer").withColumnRenamed("inner", "held_out")
    keys = ["outer", track, "spec_id", "alpha", "complexity"]
    scores = fold_errors(df, models, track, features, y, keys)
    mean = scores.groupBy("outer", "spec_id", "alpha", "complexity").agg(F.avg("mae").alias("inner_mae"))
    mean = materialize(mean)
    order = -F.col("alpha") if largest_alpha else F.col("alpha")
    best = mean.groupBy("outer").agg(F.min(F.struct("inner_mae", "complexity", order.alias("o"), "spec_id")).alias("b"))
    return best.select(F.col("outer").alias("held_out"), "b.spec_id", "b.inner_mae"), mean


def scaler(df: DataFrame, groups: Sequence[str], features: Sequence[str], floor: float) -> DataFrame:
    """Per group and feature: median, mean and population std of the median-imputed
    values, with scales under the floor set to 1."""
    long = df.unpivot(list(groups), list(features), "feature", "_v")
    ok = F.col("_v").isNotNull() & ~F.isnan("_v")
    key = [*groups, "feature"]
    med = quantile_columns(long.where(ok), key, "_v", {"median": 0.5})
    filled = attach(long, med, key).withColumn("_v", F.when(ok, F.col("_v")).otherwise(F.col("median")))
    std = F.stddev_pop("_v")
    return filled.groupBy(*key).agg(F.first("median").alias("median"), F.avg("_v").alias("mean"),
                                    F.when(std < d(floor), d(1)).otherwise(std).alias("scale"))


def score_artifacts(df: DataFrame, artifacts: DataFrame, cohort: str) -> DataFrame:
    """Frozen scoring: rows under every artifact of their cohort.

    Artifacts carry model_id, intercept and arrays feature_names, medians, means,
    scales, coefficients; rows carry a map ``features``. Missing values take the
    median; a model without features predicts its intercept.
    """
    joined = attach(df, artifacts, [cohort], "inner")
    terms = F.transform("feature_names", lambda n, i: (
        (F.coalesce(F.nanvl(F.try_element_at("features", n), F.lit(None).cast("double")), F.get("medians", i))
         - F.get("means", i)) / F.get("scales", i)) * F.get("coefficients", i))
    return joined.withColumn("p", F.col("intercept") + F.aggregate(terms, d(0), lambda a, v: a + v))


# Vectors: principal components from distributed outer products.


def vector_means(df: DataFrame, vector: str) -> list[float]:
    """The mean of each element over the known values of all rows."""
    cells = df.select(F.posexplode(vector).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    known = F.when(~F.isnan("_v"), F.col("_v"))
    rows = cells.groupBy("_i").agg(F.avg(known).alias("_v")).collect()
    return [r["_v"] or 0.0 for r in sorted(rows, key=lambda r: r["_i"])]


def vector_moments(df: DataFrame, track: str, vector: str, centre: Sequence[float]) -> DataFrame:
    """Per track: flattened Sum (1, v - centre)(1, v - centre)^T of array rows; rows with a
    missing element take no part.

    Centring keeps the sums accurate where values are far from zero. Batches are reduced with
    one matrix product per task; the partial matrices are summed entry by entry in a shuffle.
    """
    key_type = df.schema[track].dataType
    shift = np.asarray(centre, float)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, part in batch.groupby(track):
                v = np.stack(part[vector].to_numpy()).astype(float) - shift
                v = v[np.isfinite(v).all(1)]
                z = np.column_stack([np.ones(len(v)), v])
                sums[k] = sums.get(k, 0) + z.T @ z
        if sums:
            yield pd.DataFrame({track: list(sums), "m": [s.ravel().tolist() for s in sums.values()]})

    schema = T.StructType([T.StructField(track, key_type), T.StructField("m", T.ArrayType(T.DoubleType()))])
    partial = df.select(track, vector).mapInPandas(reduce, schema)
    entries = partial.select(track, F.posexplode("m").alias("_i", "_s")).groupBy(track, "_i").agg(F.sum("_s").alias("_s"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_s")))
    return entries.groupBy(track).agg(F.transform(rows, lambda s: s["_s"]).alias("m"))


def _total(per: DataFrame) -> DataFrame:
    entries = per.select(F.posexplode("m").alias("_i", "_s")).groupBy("_i").agg(F.sum("_s").alias("_s"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_s")))
    return entries.groupBy().agg(F.transform(rows, lambda s: s["_s"]).alias("m"))


def principal_axes(moment_rows: DataFrame, components: int, centre: Sequence[float], floor: float = 1e-8) -> DataFrame:
    """Axes of the standardised vectors: adds mean, scale and ``axes`` (array of arrays).

    Each axis is signed so that its largest loading is positive.
    """
    schema = T.StructType([
        T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("scale", T.ArrayType(T.DoubleType())),
        T.StructField("variances", T.ArrayType(T.DoubleType())),
        T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])

    shift = np.asarray(centre, float)

    @F.pandas_udf(schema)
    def solve(m: pd.Series) -> pd.DataFrame:
        out = []
        for flat in m:
            size = math.isqrt(len(flat))
            full = np.asarray(flat, float).reshape(size, size)
            n, mean = full[0, 0], full[0, 1:] / full[0, 0]
            cov = full[1:, 1:] / n - np.outer(mean, mean)
            scale = np.sqrt(np.maximum(np.diag(cov), 0))
            scale = np.where(scale < floor, 1.0, scale)
            values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
            axes = vectors[:, ::-1][:, :components].T
            lead = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
            axes = axes * np.where(lead < 0, -1.0, 1.0)[:, None]
            out.append(((mean + shift).tolist(), scale.tolist(), values[::-1][:components].tolist(), axes.tolist()))
        return pd.DataFrame(out, columns=["mean", "scale", "variances", "axes"])

    return moment_rows.withColumn("_p", solve("m")).select(
        *[c for c in moment_rows.columns if c != "m"], "_p.*")


def pca(df: DataFrame, track: str, vector: str, components: int) -> DataFrame:
    """Axes over all rows (one row)."""
    centre = vector_means(df, vector)
    return principal_axes(_total(vector_moments(df, track, vector, centre)), components, centre)


def pca_leave_one_out(df: DataFrame, track: str, vector: str, components: int) -> DataFrame:
    """Axes per held-out track from the other tracks' moments."""
    centre = vector_means(df, vector)
    per = materialize(vector_moments(df, track, vector, centre))
    rows = attach_one(per, _total(per).withColumnRenamed("m", "_t"))
    train = F.zip_with("_t", "m", lambda a, b: a - b)
    return principal_axes(rows.select(F.col(track).alias("held_out"), train.alias("m")), components, centre)


def project(df: DataFrame, vector: str, name: str = "scores") -> DataFrame:
    """Scores of the standardised vector on the axes attached to the row."""
    std = F.transform(vector, lambda v, i: (v.cast("double") - F.get("mean", i)) / F.get("scale", i))
    return df.withColumn("_z", std).withColumn(name, F.transform("axes", lambda a: F.aggregate(
        F.zip_with(a, F.col("_z"), lambda x, y: x * y), d(0), lambda s, v: s + v))).drop("_z")


def imputed_moments(df: DataFrame, track: str, vector: str, y: str, centre: Sequence[float],
                    gaps: Sequence[int]) -> DataFrame:
    """Per track: flattened moments of (1, known values - centre or 0, gap flags, target).

    ``gaps`` are the elements that are missing somewhere. With their flags in the moments,
    any value can be imputed afterwards without another pass: the imputed element is the
    known part plus the flag times the value.
    """
    key_type, shift, where = df.schema[track].dataType, np.asarray(centre, float), np.asarray(gaps, int)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, part in batch.groupby(track):
                v = np.stack([np.array(x, dtype=float) for x in part[vector]]) - shift
                lost = np.isnan(v)
                z = np.column_stack([np.ones(len(v)), np.where(lost, 0.0, v), lost[:, where], part[y].to_numpy(float)])
                sums[k] = sums.get(k, 0) + z.T @ z
        if sums:
            yield pd.DataFrame({track: list(sums), "m": [s.ravel().tolist() for s in sums.values()]})

    schema = T.StructType([T.StructField(track, key_type), T.StructField("m", T.ArrayType(T.DoubleType()))])
    partial = df.where(_complete([y])).select(track, vector, y).mapInPandas(reduce, schema)
    entries = partial.select(track, F.posexplode("m").alias("_i", "_s")).groupBy(track, "_i").agg(F.sum("_s").alias("_s"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_s")))
    return entries.groupBy(track).agg(F.transform(rows, lambda s: s["_s"]).alias("m"))


def vector_ridge(df: DataFrame, track: str, vector: str, y: str, alpha: float, floor: float = 1e-8) -> DataFrame:
    """Leave-one-track-out ridge on an array of features: (held_out, beta), beta being the
    intercept and one raw coefficient per element.

    One pass of array moments per track serves all folds. Missing elements take the median of
    the fold's training rows; features are standardised, the intercept is not penalised.
    """
    centre = vector_means(df, vector)
    p = len(centre)
    cells = df.where(_complete([y])).select(track, F.posexplode(vector).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    known = F.col("_v").isNotNull() & ~F.isnan("_v")
    gaps = sorted(r["_i"] for r in cells.where(~known).select("_i").distinct().collect())
    per = materialize(imputed_moments(df, track, vector, y, centre, gaps))
    tracks = [r[0] for r in per.select(track).collect()]
    medians = {h: {} for h in tracks}
    if gaps:
        some = materialize(cells.where(known & F.col("_i").isin(gaps)))
        for r in quantile_columns(training_folds(some, track, tracks), ["held_out", "_i"], "_v", {"median": 0.5}).collect():
            medians[r["held_out"]][r["_i"]] = r["median"]
    rows = attach_one(per, _total(per).withColumnRenamed("m", "_t"))
    train = rows.select(F.col(track).alias("held_out"), F.zip_with("_t", "m", lambda a, b: a - b).alias("m"))
    shift = np.asarray(centre, float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(held: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for h, flat in zip(held, m):
            size = p + len(gaps) + 2
            full = np.asarray(flat, float).reshape(size, size)
            fill = np.zeros((p + 2, size))  # (1, imputed values, target) from the long vector
            fill[0, 0] = fill[p + 1, size - 1] = 1.0
            fill[np.arange(1, p + 1), np.arange(1, p + 1)] = 1.0
            for k, i in enumerate(gaps):
                fill[i + 1, p + 1 + k] = medians[h].get(i, shift[i]) - shift[i]
            out.append(_uncentre(_ridge(fill @ full @ fill.T, list(range(p)), alpha, False, floor), centre))
        return pd.Series(out)

    models = train.withColumn("beta", solve("held_out", "m")).drop("m")
    filled = F.array(*[F.array(*[d(medians[h].get(i, centre[i])) for i in range(p)]) for h in tracks]) if gaps else None
    if filled is None:
        return models.withColumn("fill", F.array().cast("array<double>"))
    place = F.array_position(F.array(*[F.lit(h) for h in tracks]), F.col("held_out")).cast("int")
    return models.withColumn("fill", F.element_at(filled, place))


def score_vector_ridge(df: DataFrame, models: DataFrame, track: str, vector: str) -> DataFrame:
    """Adds ``p``: the prediction of the model that held the row's track out."""
    rows = attach(df, models.withColumnRenamed("held_out", track), [track], "inner")
    value = lambda v, i: F.coalesce(F.nanvl(v.cast("double"), F.lit(None).cast("double")), F.get("fill", i))
    terms = F.transform(vector, lambda v, i: value(v, i) * F.get("beta", i + 1))
    return rows.withColumn("p", F.get("beta", F.lit(0)) + F.aggregate(terms, d(0), lambda a, v: a + v)).drop("beta", "fill")


# Iterative fits.


def _with_parameters(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    """The step's parameters as columns of a broadcast one-row table.

    As data instead of literals they leave the plan's generated code unchanged, so
    it is compiled once for all steps.
    """
    schema = "_k int, " + ", ".join(f"{k} double" for k in values)
    row = rows.sparkSession.createDataFrame([(0, *map(float, values.values()))], schema)
    return rows.join(F.broadcast(row), "_k")


def _weighted_sums(blocks: DataFrame, beta: np.ndarray, levels: np.ndarray, eps: float) -> np.ndarray:
    """Per quantile: pinball sum, weighted Gram and weighted right-hand side over packed rows of
    standardised features and the target.

    Each task reduces its blocks to one short vector; Spark adds the vectors.
    """
    p = beta.shape[1]
    upper = np.triu_indices(p)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, block in zip(batch.column("n"), batch.column("block"), strict=True):
                line = np.frombuffer(block.as_buffer()).reshape(p + 1, n.as_py())
                z, t = line[:p], line[p]
                r = t - beta @ z
                signed, size = r.sum(1), np.abs(r, out=r)
                loss = levels * signed + (size.sum(1) - signed) / 2
                size += eps
                weighted = np.reciprocal(size, out=size) @ np.vstack([z[upper[0]] * z[upper[1]], z * t]).T
                found = np.hstack([loss[:, None], weighted])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["s"])

    partial = blocks.mapInArrow(reduce, "s array<double>")
    summed = partial.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    got = np.array([r["v"] for r in sorted(summed.collect(), key=lambda r: r["i"])]).reshape(len(levels), -1)
    gram = np.zeros((len(levels), p, p))
    gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = got[:, 1:-p]
    return np.hstack([got[:, :1], gram.reshape(len(levels), -1), got[:, -p:]]).ravel()


def quantile_fit(df: DataFrame, features: Sequence[str], y: str, quantiles: Sequence[float], alpha: float,
                 steps: int = 150, tolerance: float = 1e-7) -> DataFrame:
    """Linear quantile regressions: mean pinball loss + alpha * L1 of the coefficients.

    Majorise-minimise steps (Hunter and Lange 2000): weights 1 / (eps + |r|) make
    each step a weighted least squares whose sums for all quantiles come from one
    pass. Features are standardised first; missing values raise. Returns one row per
    quantile with intercept, coefficients (standardised), means, scales, the loss, the steps
    taken and whether the losses had settled by then.
    """
    _require_complete(df, [*features, y])
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("_sy"), F.avg(y).alias("_my"),
                   *[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    n, p = stats["n"], len(features)
    mean = [stats[f"m_{f}"] for f in features]
    scale = [stats[f"s_{f}"] or 1.0 for f in features]
    unit = stats["_sy"] or 1.0
    z = [d(1)] + [(F.col(f) - d(m)) / d(s) for f, m, s in zip(features, mean, scale)]
    names = [f"z{i}" for i in range(p + 1)]
    rows = materialize(df.select(*[c.alias(k) for k, c in zip(names, z)], F.col(y).cast("double").alias("y")), spread=True)
    sx = np.array([float(v) for v in rows.agg(*[F.sum(c) for c in names]).first()])
    blocks = pack(rows, [*names, "y"])
    levels = np.asarray(quantiles, float)
    beta = {q: np.r_[stats["_my"], np.zeros(p)] for q in quantiles}
    best = {q: (math.inf, beta[q]) for q in quantiles}
    width = 1 + (p + 1) * (p + 2)
    still, settled, step = 0, False, 0
    for step in range(steps + 1):
        eps = max(1e-6, 0.1 * 0.93 ** step) * unit
        sums = _weighted_sums(blocks, np.stack([beta[q] for q in quantiles]), levels, eps)
        got = sums.reshape(len(quantiles), width)
        moved = False
        for k, q in enumerate(quantiles):
            loss = got[k, 0] / n + alpha * float(np.abs(beta[q][1:]).sum())
            if loss < best[q][0] - tolerance * unit:
                moved = True
            if loss < best[q][0]:
                best[q] = (loss, beta[q])
            gram = got[k, 1:1 + (p + 1) ** 2].reshape(p + 1, p + 1)
            shrink = np.r_[0.0, 1.0 / (np.abs(beta[q][1:]) + eps)]
            rhs = got[k, 1 + (p + 1) ** 2:] + (2 * q - 1) * sx
            beta[q] = np.linalg.solve(gram / (2 * n) + alpha * np.diag(shrink), rhs / (2 * n))
        still = 0 if moved else still + 1
        settled = still >= 10 and eps <= 1e-3 * unit
        if settled:
            break
    out = [(float(q), float(best[q][1][0]), best[q][1][1:].tolist(), mean, scale, float(best[q][0]), step, settled) for q in quantiles]
    return df.sparkSession.createDataFrame(
        out, "quantile double, intercept double, coefficients array<double>, means array<double>, scales array<double>, loss double, "
        "steps int, settled boolean")


def quantile_predict(df: DataFrame, models: DataFrame, features: Sequence[str], names: Sequence[str],
                     offset: Column | None = None) -> DataFrame:
    """Quantile columns per row (one model row per quantile), sorted against crossing."""
    out = {}
    base = d(0) if offset is None else offset
    for name, m in zip(names, models.orderBy("quantile").collect()):
        fit = base + d(m["intercept"])
        for f, b, mu, s in zip(features, m["coefficients"], m["means"], m["scales"]):
            fit = fit + d(b) * (F.col(f) - d(mu)) / d(s)
        out[name] = fit
    return sorted_quantiles(df.withColumns(out), names)


def logistic_fit(df: DataFrame, features: Sequence[str], label: str, steps: int = 1000, rate: float = 0.1,
                 penalty: float = 0.05) -> DataFrame:
    """Fixed gradient steps of an L2 logistic model on standardised features.

    The intercept is not penalised and scores are clipped to +-20; missing values raise. One
    row: intercept, coefficients, means, scales. Equal rows are counted first. While their
    number and bytes are bounded the steps run on these counts; beyond, each step is one pass
    over the stored rows, with the same result.
    """
    _require_complete(df, [*features, label])
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = [stats[f"m_{f}"] for f in features]
    scale = [stats[f"s_{f}"] or 1.0 for f in features]
    z = [(F.col(f) - d(m)) / d(s) for f, m, s in zip(features, mean, scale)]
    rows = materialize(df.select(*[c.alias(f"z{i}") for i, c in enumerate(z)],
                                 F.col(label).cast("double").alias("y"), F.lit(0).alias("_k")), spread=True)
    w = np.zeros(len(features) + 1)
    few = bounded(rows.groupBy(*[f"z{i}" for i in range(len(z))], "y").agg(F.count(F.lit(1)).alias("n")), 200_000)
    if few is not None:
        table = few.toPandas().to_numpy(float)
        zs, ys, share = table[:, :len(z)], table[:, -2], table[:, -1] / table[:, -1].sum()
        for _ in range(steps):
            gap = (1 / (1 + np.exp(-np.clip(w[0] + zs @ w[1:], -20, 20))) - ys) * share
            w = w - rate * (np.r_[gap.sum(), gap @ zs] + penalty * np.r_[0.0, w[1:]])
        steps = 0
    score = sum((F.col(f"w{i + 1}") * F.col(f"z{i}") for i in range(len(features))), F.col("w0"))
    gap = d(1) / (d(1) + F.exp(-F.greatest(d(-20), F.least(d(20), score)))) - F.col("y")
    for _ in range(steps):
        work = _with_parameters(rows, {f"w{i}": v for i, v in enumerate(w)})
        got = work.agg(F.avg(gap), *[F.avg(gap * F.col(f"z{i}")) for i in range(len(features))]).first()
        w = w - rate * (np.array([float(v) for v in got]) + penalty * np.r_[0.0, w[1:]])
    return df.sparkSession.createDataFrame(
        [(float(w[0]), w[1:].tolist(), mean, scale)],
        "intercept double, coefficients array<double>, means array<double>, scales array<double>")


def representation_catalogue(rows: DataFrame, parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """One provenance row per sample and representation: id, size, context direction."""
    items = F.array(*[F.struct(F.lit(k).alias("representation_id"), F.size(v).alias("size"), F.lit(c).alias("context"))
                      for k, (v, c) in parts.items()])
    return rows.withColumn("_r", F.explode(items)).select(*[c for c in rows.columns], "_r.*")

