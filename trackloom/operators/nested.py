"""Nested whole-track selection of ridges on vectors, their principal components and scalars.

The design of a row is its vector followed by its further features. One pass sums the moments
(1, design, target) per track; the training moments of any fold are the total minus the held-out
tracks. One eigendecomposition per fold rotates the moments, and serves every number of
components and every penalty: a fit is a small solve in the rotated space. Held-out errors of all
candidates come from one more pass, a matrix product per Arrow batch; no row is copied per fold or
candidate. Rows with a missing or non-finite value take no part.

What is sent to the tasks grows with tracks and elements, not with rows: moment matrices within
BROADCAST_BYTES, and the coefficients of as many outer folds at a time as fit into it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import BROADCAST_BYTES, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Family:
    """A kind of model: ``components`` to choose among (empty: the whole vector; None: no
    vector), whether the further features are in, and the family it is compared to."""

    name: str
    components: tuple[int, ...] | None
    extra: bool = False
    partner: str | None = None


@dataclass(frozen=True)
class Spec:
    family: str
    components: int | None  # 0: the whole vector
    extra: bool
    alpha: float


def specs_of(families: Sequence[Family], alphas: Sequence[float]) -> list[Spec]:
    return [Spec(f.name, c, f.extra, a) for f in families
            for c in ((None,) if f.components is None else f.components or (0,)) for a in alphas]


def complete_rows(df: DataFrame, vector: str, extra: str, y: str) -> DataFrame:
    """The rows whose vector, further features and target are all finite."""
    def finite(v: Column) -> Column:
        v = v.cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    return df.where(F.forall(vector, finite) & F.forall(extra, finite) & finite(F.col(y)))


def _design(batch: pd.DataFrame, vector: str, extra: str) -> np.ndarray:
    rows = [np.concatenate([np.asarray(v, float), np.asarray(e, float)]) for v, e in zip(batch[vector], batch[extra], strict=True)]
    return np.stack(rows)


def design_means(df: DataFrame, vector: str, extra: str) -> np.ndarray:
    both = F.concat(F.col(vector).cast("array<double>"), F.col(extra).cast("array<double>"))
    rows = df.select(F.posexplode(both).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def track_moments(df: DataFrame, track: str, vector: str, extra: str, y: str, centre: np.ndarray) -> dict:
    """Track: the moment matrix of (1, design - centre, target).

    Tasks reduce their batches to one matrix per track, whose rows are summed apart; the sums,
    tracks times elements squared, are checked before they are fetched.
    """
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(track):
                x = _design(part, vector, extra) - centre
                z = np.column_stack([np.ones(len(x)), x, part[y].to_numpy(float)])
                sums[key] = sums.get(key, 0) + z.T @ z
        for key, m in sums.items():
            yield pd.DataFrame({track: [key] * len(m), "i": range(len(m)), "m": [r.tolist() for r in m]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({track: group[track].iloc[:1], "i": group["i"].iloc[:1], "m": [np.stack(group["m"].to_numpy()).sum(0).tolist()]})

    schema = T.StructType([df.schema[track], T.StructField("i", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    rows = materialize(df.select(track, vector, extra, y).mapInPandas(reduce, schema).groupBy(track, "i").applyInPandas(add, schema))
    tracks = rows.select(track).distinct().count()
    if tracks * (len(centre) + 2) ** 2 * 8 > BROADCAST_BYTES:
        raise ValueError(f"{tracks} tracks of {len(centre)} elements are more than {BROADCAST_BYTES} bytes of moments")
    found: dict = {}
    for r in rows.collect():
        found.setdefault(r[track], {})[r["i"]] = r["m"]
    return {k: np.array([m[i] for i in range(len(m))]) for k, m in sorted(found.items())}


class Rotated:
    """Training moments, standardised, with the vector part turned to its principal axes."""

    def __init__(self, full: np.ndarray, p: int, floor: float = 1e-12):
        self.n, self.p = full[0, 0], p
        self.mean, self.target = full[0, 1:-1] / self.n, full[0, -1] / self.n
        cov = full[1:-1, 1:-1] / self.n - np.outer(self.mean, self.mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        self.scale = np.where(scale < floor, 1.0, scale)
        gram = cov / np.outer(self.scale, self.scale)
        with_y = (full[1:-1, -1] / self.n - self.mean * self.target) / self.scale
        self.axes = np.eye(len(gram))
        if p:
            self.axes[:p, :p] = np.linalg.eigh(gram[:p, :p])[1][:, ::-1]
        self.gram, self.with_y = self.axes.T @ gram @ self.axes, self.axes.T @ with_y

    def fit(self, spec: Spec) -> np.ndarray:
        """Intercept and raw coefficients; the intercept is not penalised."""
        size = len(self.gram)
        first = 0 if spec.components is None else int(min(spec.components or self.p, self.p, max(self.n - 1, 0)))
        use = [*range(first), *(range(self.p, size) if spec.extra else ())]
        out = np.zeros(size + 1)
        if use:
            turned = np.linalg.solve(self.n * self.gram[np.ix_(use, use)] + spec.alpha * np.eye(len(use)), self.n * self.with_y[use])
            out[1:] = self.axes[:, use] @ turned / self.scale
        out[0] = self.target - out[1:] @ self.mean
        return out


def fitted(spark, moments: dict, folds: list[tuple], specs: list[list[Spec]], p: int, centre: np.ndarray) -> dict:
    """Fold (the tracks left out): the coefficients of its specs as rows. Folds are solved in tasks."""
    total = sum(moments.values())
    sent = spark.sparkContext.broadcast((moments, total, specs, folds))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments, total, specs, folds = sent.value
        for batch in batches:
            for k in batch["id"]:
                turned = Rotated(total - sum(moments[h] for h in folds[k]), p)
                beta = np.stack([turned.fit(s) for s in specs[k]])
                beta[:, 0] -= beta[:, 1:] @ centre
                yield pd.DataFrame({"k": [k], "beta": [beta.ravel().tolist()]})

    rows = spark.range(len(folds), numPartitions=min(len(folds), spark.sparkContext.defaultParallelism))
    found = rows.mapInPandas(solve, "k long, beta array<double>").collect()
    return {folds[r["k"]]: np.array(r["beta"]).reshape(len(specs[r["k"]]), -1) for r in found}


def _errors(df: DataFrame, track: str, vector: str, extra: str, y: str, models: dict) -> DataFrame:
    """(track, outer, spec, mae): the mean absolute error on each track of the models that
    ``models`` holds for it: (outer number, coefficients per spec)."""
    sent = df.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(track):
                x, target = _design(part, vector, extra), part[y].to_numpy(float)
                for outer, beta in sent.value.get(key, ()):
                    gap = np.abs(beta[:, 0] + x @ beta[:, 1:].T - target[:, None]).sum(0)
                    held = sums.get((key, outer), (0.0, 0))
                    sums[key, outer] = (held[0] + gap, held[1] + len(x))
        for (key, outer), (gap, n) in sums.items():
            yield pd.DataFrame({track: [key] * len(gap), "outer": outer, "spec": range(len(gap)), "gap": gap, "n": n})

    schema = T.StructType([df.schema[track], T.StructField("outer", T.IntegerType()), T.StructField("spec", T.IntegerType()),
                           T.StructField("gap", T.DoubleType()), T.StructField("n", T.LongType())])
    return df.select(track, vector, extra, y).mapInPandas(score, schema).groupBy(track, "outer", "spec").agg(
        (F.sum("gap") / F.sum("n")).alias("mae"))


def inner_scores(df: DataFrame, track: str, vector: str, extra: str, y: str, families: Sequence[Family],
                 alphas: Sequence[float]) -> DataFrame:
    """(held_out, family, components, alpha, inner_mae): every candidate's error, averaged over
    the inner held-out tracks of each outer fold."""
    spark, specs = df.sparkSession, specs_of(families, alphas)
    df = materialize(complete_rows(df, vector, extra, y).select(track, vector, extra, y), spread=True)
    first = df.first()
    if first is None:
        return spark.createDataFrame([], T.StructType([T.StructField("held_out", df.schema[track].dataType)])).selectExpr(
            "held_out", "'' AS family", "0 AS components", "0D AS alpha", "0D AS inner_mae")
    p, centre = len(first[vector]), design_means(df, vector, extra)
    moments = track_moments(df, track, vector, extra, y, centre)
    tracks = list(moments)
    per_outer = max(1, len(tracks) * len(specs) * (len(centre) + 1) * 8)
    step = max(1, BROADCAST_BYTES // per_outer)
    found = None
    for low in range(0, len(tracks), step):
        outers = tracks[low:low + step]
        folds = [(o, i) for o in outers for i in tracks if o != i]
        betas = fitted(spark, moments, folds, [specs] * len(folds), p, centre)
        models: dict = {}
        for (o, i), beta in betas.items():
            models.setdefault(i, []).append((tracks.index(o), beta))
        part = _errors(df, track, vector, extra, y, models)
        found = part if found is None else found.unionByName(part)
    names = spark.createDataFrame([(k, s.family, s.components or 0, float(s.alpha)) for k, s in enumerate(specs)],
                                  "spec int, family string, components int, alpha double")
    outer_names = spark.createDataFrame([(k, t) for k, t in enumerate(tracks)], T.StructType(
        [T.StructField("outer", T.IntegerType()), T.StructField("held_out", df.schema[track].dataType)]))
    mean = found.groupBy("outer", "spec").agg(F.avg("mae").alias("inner_mae"))
    return mean.join(F.broadcast(names), "spec").join(F.broadcast(outer_names), "outer").select(
        "held_out", "family", "components", "alpha", "inner_mae")


def chosen_specs(scores: DataFrame) -> DataFrame:
    """Per held-out track and family the candidate of least error; ties go to fewer components,
    then the smaller penalty. 0 components are the whole vector, or none of it."""
    best = F.min(F.struct("inner_mae", "components", "alpha")).alias("b")
    return scores.groupBy("held_out", "family").agg(best).select(
        "held_out", "family", "b.components", "b.alpha", "b.inner_mae")


def refit_held_out(df: DataFrame, track: str, vector: str, extra: str, y: str, families: Sequence[Family],
                   chosen: DataFrame) -> DataFrame:
    """The rows of ``df`` under each family: fitted with the choice of the row's track on all
    other tracks. Adds ``family`` and ``p``. ``df`` may be another set of rows than the choice was
    made on, as a stricter policy with locked choices."""
    spark, kinds = df.sparkSession, {f.name: f for f in families}
    df = materialize(complete_rows(df, vector, extra, y))
    first = df.first()
    out = T.StructType([*df.schema.fields, T.StructField("family", T.StringType()), T.StructField("p", T.DoubleType())])
    if first is None:
        return spark.createDataFrame([], out)
    p, centre = len(first[vector]), design_means(df, vector, extra)
    moments = track_moments(df, track, vector, extra, y, centre)
    wanted: dict = {}
    for r in chosen.collect():  # one row per track and family
        kind = kinds[r["family"]]
        whole = None if kind.components is None else r["components"]
        wanted.setdefault(r["held_out"], []).append(Spec(kind.name, whole, kind.extra, r["alpha"]))
    folds = [(t,) for t in moments if t in wanted]
    betas = fitted(spark, moments, folds, [sorted(wanted[t], key=lambda s: s.family) for (t,) in folds], p, centre)
    names = {t: [s.family for s in sorted(wanted[t], key=lambda s: s.family)] for (t,) in folds}
    sent = spark.sparkContext.broadcast({t: (names[t], beta) for (t,), beta in betas.items()})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(track):
                if key in sent.value:
                    x = _design(part, vector, extra)
                    for name, beta in zip(*sent.value[key], strict=True):
                        yield part.assign(family=name, p=beta[0] + x @ beta[1:])

    return df.mapInPandas(score, out)


def fold_table(scored: DataFrame, groups: Sequence[str], track: str, y: str, families: Sequence[Family]) -> DataFrame:
    """Errors per group, family and held-out track, and the change against the partner family."""
    e = F.col("p") - F.col(y)
    rows = scored.groupBy(*groups, "family", track).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("signed_bias"))
    pairs = [F.lit(x) for f in families if f.partner for x in (f.name, f.partner)]
    partner = F.create_map(*pairs)[F.col("family")] if pairs else F.lit(None).cast("string")
    rows = materialize(rows.withColumn("partner", partner))
    other = rows.select(*groups, track, F.col("family").alias("partner"), F.col("mae").alias("partner_mae"))
    return rows.join(F.broadcast(other) if rows.count() <= 50_000 else other, [*groups, track, "partner"], "left").withColumns({
        "change_vs_partner": F.col("mae") - F.col("partner_mae"),
        "relative_change_vs_partner": (F.col("mae") - F.col("partner_mae")) / F.col("partner_mae")}).drop("partner_mae")


# A baseline on x, and a ridge of its residual on a representation, chosen in nested folds.


@dataclass(frozen=True)
class Baseline:
    """A ridge on the first ``degree`` further features (powers of x)."""

    degree: int
    alpha: float


def solved(spark, moments: dict, folds: list[tuple], solve, centre: np.ndarray) -> dict:
    """Fold (the tracks left out): the rows of coefficients that ``solve`` makes of its training
    moments. Folds are solved in tasks."""
    total, size = sum(moments.values()), len(centre) + 1
    sent = spark.sparkContext.broadcast((moments, total, folds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments, total, folds = sent.value
        for batch in batches:
            for k in batch["id"]:
                beta = np.stack(solve(folds[k], total - sum(moments[h] for h in folds[k])))
                beta[:, 0] -= beta[:, 1:] @ centre
                yield pd.DataFrame({"k": [k], "beta": [beta.ravel().tolist()]})

    rows = spark.range(len(folds), numPartitions=max(1, min(len(folds), spark.sparkContext.defaultParallelism)))
    found = rows.mapInPandas(run, "k long, beta array<double>").collect()
    return {folds[r["k"]]: np.array(r["beta"]).reshape(-1, size) for r in found}


def penalised(full: np.ndarray, use: Sequence[int], alpha: float, target: np.ndarray | None = None, floor: float = 1e-8) -> np.ndarray:
    """Intercept and coefficients around the centre from moments; the penalty covers the intercept
    of the standardised fit. ``target`` are the moments of another target than the last one."""
    size = len(full) - 1
    t, n, out = full[:size, size] if target is None else target, full[0, 0], np.zeros(size)
    out[0] = t[0] / (n + alpha)
    at = [i + 1 for i in use]
    if at:
        mean = full[0, at] / n
        cov = full[np.ix_(at, at)] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(scale < floor, 1.0, scale)
        gram = n * cov / np.outer(scale, scale) + alpha * np.eye(len(at))
        out[at] = np.linalg.solve(gram, (t[at] - mean * t[0]) / scale) / scale
        out[0] -= out[at] @ mean
    return out


def residual_fit(full: np.ndarray, base: np.ndarray, use: Sequence[int], alpha: float) -> np.ndarray:
    """The ridge of what ``base`` leaves, from the joint moments."""
    size = len(full) - 1
    return penalised(full, use, alpha, full[:size, size] - full[:size, :size] @ base)


def _inner(df: DataFrame, track: str, vector: str, extra: str, y: str, moments: dict, centre: np.ndarray, solve, specs: int) -> DataFrame:
    """(held_out number, spec, inner_mae) of the candidates that ``solve`` makes per fold."""
    tracks = list(moments)
    step, found = max(1, BROADCAST_BYTES // max(1, len(tracks) * specs * (len(centre) + 1) * 8)), None
    for low in range(0, len(tracks), step):
        folds = [(o, i) for o in tracks[low:low + step] for i in tracks if o != i]
        models: dict = {}
        for (o, i), beta in solved(df.sparkSession, moments, folds, solve, centre).items():
            models.setdefault(i, []).append((tracks.index(o), beta))
        part = _errors(df, track, vector, extra, y, models)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("outer", "spec").agg(F.avg("mae").alias("inner_mae"))


def residual_choice(df: DataFrame, track: str, y: str, powers: str, representations: Sequence[str], alphas: Sequence[float],
                    degrees: int = 3, inner_base: Baseline = Baseline(2, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(choice per held-out track, scores of all candidates). The baseline's degree and penalty are
    chosen by its own inner error; representation (an array column) and penalty by the inner
    error of ``inner_base`` plus the residual ridge. Ties go to the smaller representation, its
    name, then the smaller penalty. Rows with a gap take no part."""
    spark, scores, chosen_base = df.sparkSession, None, None
    for rep in representations:
        part = materialize(complete_rows(df, rep, powers, y).select(track, F.col(rep).alias("v"), F.col(powers).alias("e"), y), spread=True)
        first = part.first()
        if first is None:
            raise ValueError("no complete rows to choose from")
        p, centre = len(first["v"]), design_means(part, "v", "e")
        moments = track_moments(part, track, "v", "e", y, centre)
        tracks = list(moments)
        x_of = lambda degree, p=p: list(range(p, p + degree))
        if chosen_base is None:
            bases = [Baseline(g, a) for g in range(1, degrees + 1) for a in alphas]
            found = _inner(part, track, "v", "e", y, moments, centre, lambda _, full: [penalised(full, x_of(b.degree), b.alpha) for b in bases], len(bases))
            chosen_base = {}
            for r in found.collect():  # tracks x baselines
                b = bases[r["spec"]]
                chosen_base[tracks[r["outer"]]] = min(chosen_base.get(tracks[r["outer"]], (np.inf,)), (r["inner_mae"], b.degree, b.alpha))

        def solve(_, full, p=p, x_of=x_of):
            base = penalised(full, x_of(inner_base.degree), inner_base.alpha)
            return [base + residual_fit(full, base, range(p), a) for a in alphas]

        found = _inner(part, track, "v", "e", y, moments, centre, solve, len(alphas))
        rows = [(tracks[r["outer"]], rep, p, float(alphas[r["spec"]]), r["inner_mae"]) for r in found.collect()]
        kind = df.schema[track].dataType.simpleString()
        table = spark.createDataFrame(rows, f"held_out {kind}, representation string, size int, alpha double, inner_mae double")
        scores = table if scores is None else scores.unionByName(table)
    best = F.min(F.struct("inner_mae", "size", "representation", "alpha")).alias("b")
    base = spark.createDataFrame([(t, int(g), float(a)) for t, (_, g, a) in chosen_base.items()], f"held_out {kind}, degree int, x_alpha double")
    chosen = scores.groupBy("held_out").agg(best).select("held_out", "b.representation", "b.alpha", "b.inner_mae").join(base, "held_out")
    return materialize(chosen), scores


def residual_held_out(df: DataFrame, track: str, y: str, powers: str, chosen: DataFrame) -> DataFrame:
    """(track, y, x_only, thermal_only, correction): every row under the locked choice of its track,
    fitted on the other tracks' rows of ``df``."""
    spark, kind, out = df.sparkSession, df.schema[track].dataType.simpleString(), None
    picks: dict = {}
    for r in chosen.collect():
        picks.setdefault(r["representation"], {})[r["held_out"]] = r
    for rep, own in sorted(picks.items()):
        part = materialize(complete_rows(df, rep, powers, y).select(track, F.col(rep).alias("v"), F.col(powers).alias("e"), F.col(y).alias("y")))
        first = part.first()
        if first is None:
            continue
        p, centre = len(first["v"]), design_means(part, "v", "e")
        moments = track_moments(part, track, "v", "e", "y", centre)
        settings = {t: (r["degree"], r["x_alpha"], r["alpha"]) for t, r in own.items()}

        def solve(fold, full, p=p, settings=settings):
            degree, x_alpha, alpha = settings[fold[0]]
            base = penalised(full, list(range(p, p + degree)), x_alpha)
            return [base, penalised(full, range(p), alpha), residual_fit(full, base, range(p), alpha)]

        folds = [(t,) for t in moments if t in own and len(moments) > 1]
        sent = spark.sparkContext.broadcast({t: beta for (t,), beta in solved(spark, moments, folds, solve, centre).items()})

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, rows in batch.groupby(track):
                    if key in sent.value:
                        beta = sent.value[key]
                        fit = beta[:, 0] + _design(rows, "v", "e") @ beta[:, 1:].T
                        yield pd.DataFrame({track: rows[track], "y": rows["y"], "x_only": fit[:, 0], "thermal_only": fit[:, 1], "correction": fit[:, 2]})

        scored = part.mapInPandas(score, f"{track} {kind}, y double, x_only double, thermal_only double, correction double")
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else spark.createDataFrame([], f"{track} {kind}, y double, x_only double, thermal_only double, correction double")


def residual_table(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Errors of the three predictions, and what the correction does."""
    left, y = F.col("y") - F.col("x_only"), F.col("y")
    combined = F.col("x_only") + F.col("correction")
    mae = lambda p: F.avg(F.abs(p - y))
    above = lambda limit: F.avg((F.abs("correction") > limit).cast("double"))
    rows = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), mae(F.col("x_only")).alias("x_only_mae"), mae(F.col("thermal_only")).alias("thermal_only_mae"),
        mae(combined).alias("combined_mae"), F.sqrt(F.avg((combined - y) ** 2)).alias("combined_rmse"), F.avg(combined - y).alias("combined_bias"),
        F.corr(left, F.col("correction")).alias("residual_correlation"),
        (1 - F.sum((y - combined) ** 2) / F.greatest(F.sum(left ** 2), F.lit(1e-12))).alias("residual_variance_explained"),
        above(0.02).alias("above_0p02"), above(0.05).alias("above_0p05"), above(0.10).alias("above_0p10"))
    change = F.col("combined_mae") - F.col("x_only_mae")
    return rows.withColumns({"mae_change": change, "relative_mae_change": change / F.col("x_only_mae")})
