"""Linear models of every fold and group from the moments of each season.

Rows are read once: a season's rows of a group become their number, means and covariances, which Spark merges without
loss of digits. Everything after that is work on these few figures: folds add up the seasons before them, weighted by
recency if wanted, penalised normal equations are solved by Cholesky factors as column expressions, and the squared error
of any coefficients on any season follows from that season's moments.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.operators.joins import join_small
from boardwalk.operators.walkforward import TRAIN, walk_forward

DECAYS = (1.0, 0.9, 0.8, 0.65, 0.5)


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def mean_of(column: str) -> str:
    return f"m_{column}"


def product_of(a: str, b: str, columns: Sequence[str]) -> str:
    """The name of a covariance; it has one order of its columns."""
    first, second = sorted((a, b), key=list(columns).index)
    return f"c_{first}__{second}"


def season_moments(df: DataFrame, columns: Sequence[str], group: str = "position", season: str = "season") -> DataFrame:
    """Per season and group ``n``, the mean of each column and the covariance (over n) of each pair.

    Rows that lack a column count for nothing. One aggregate, which combines on the map side: what is shuffled is a row of
    figures a task, season and group.
    """
    values = [F.col(c).cast("double") for c in columns]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull() & ~F.isnan(v)
    rows = df.filter(whole & F.col(season).isNotNull())
    means = [F.avg(F.col(c).cast("double")).alias(mean_of(c)) for c in columns]
    products = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(product_of(a, b, columns)) for a, b in _pairs(columns)]
    return rows.groupBy(season, group).agg(F.count(F.lit(1)).cast("double").alias("n"), *means, *products)


def fold_moments(
    moments: DataFrame,
    test_seasons: Sequence[int],
    columns: Sequence[str],
    decays: Sequence[float] = (1.0,),
    group: str = "position",
    season: str = "season",
) -> DataFrame:
    """Per test season, group and decay the moments of all earlier seasons together, the newest of them with weight 1.

    ``n_train`` is the number of rows. Means are merged first and covariances around them, so no digits cancel.
    """
    folds = walk_forward(moments, test_seasons, season).filter(F.col("role") == TRAIN)
    folds = folds.withColumn("decay", F.explode(F.array(*[F.lit(float(d)) for d in decays])))
    keys = ["test_season", group, "decay"]
    fold = Window.partitionBy(*keys)
    weight = F.col("n") * F.pow("decay", F.col("test_season") - 1 - F.col(season))
    folds = folds.withColumn("_w", weight)
    centres = {f"_{mean_of(c)}": F.sum(F.col("_w") * F.col(mean_of(c))).over(fold) / F.sum("_w").over(fold) for c in columns}
    folds = folds.withColumns(centres)

    def off(c: str) -> Column:
        return F.col(mean_of(c)) - F.col(f"_{mean_of(c)}")

    products = [
        (F.sum(F.col("_w") * (F.col(product_of(a, b, columns)) + off(a) * off(b))) / F.sum("_w")).alias(product_of(a, b, columns))
        for a, b in _pairs(columns)
    ]
    means = [F.first(f"_{mean_of(c)}").alias(mean_of(c)) for c in columns]
    return folds.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n_train"), *means, *products)


def _standardised(folds: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, list[list[Column]], list[Column]]:
    """Adds the spread of each feature (1 for one that never changes), and gives the correlations and the right side."""
    columns = [*features, target]
    spreads = {f"_s{i}": F.coalesce(F.nullif(F.sqrt(product_of(f, f, columns)), F.lit(0.0)), F.lit(1.0)) for i, f in enumerate(features)}
    folds = folds.withColumns(spreads)

    def spread(i: int) -> Column:
        return F.col(f"_s{i}")

    left = [[F.col(product_of(a, b, columns)) / (spread(i) * spread(j)) for j, b in enumerate(features)] for i, a in enumerate(features)]
    right = [F.col(product_of(f, target, columns)) / spread(i) for i, f in enumerate(features)]
    return folds, left, right


def _raw(folds: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Coefficients ``_g<i>`` of standardised features to those of the features, ``b_<feature>``, and the intercept ``b0``."""
    folds = folds.withColumns({f"b_{f}": F.col(f"_g{i}") / F.col(f"_s{i}") for i, f in enumerate(features)})
    fixed = F.col(mean_of(target))
    for f in features:
        fixed = fixed - F.col(f"b_{f}") * F.col(mean_of(f))
    return folds.withColumn("b0", fixed)


def ridge(folds: DataFrame, features: Sequence[str], target: str = "y", penalty: float = 0.1, group: str = "position") -> DataFrame:
    """Ridge coefficients per fold, group and decay: ``b0`` and ``b_<feature>``, with ``n_train``.

    ``penalty`` is added to the correlations' diagonal, so it does not depend on units or rows; the intercept bears none.
    Without a penalty, features that depend on each other give null coefficients.
    """
    rows, left, right = _standardised(folds, features, target)
    p = len(features)
    for j in range(p):
        pivot = left[j][j] + F.lit(penalty)
        for k in range(j):
            pivot = pivot - F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}")
        rows = rows.withColumn(f"_l{j}_{j}", F.when(pivot > 1e-12, F.sqrt(pivot)))
        below = {}
        for i in range(j + 1, p):
            entry = left[i][j]
            for k in range(j):
                entry = entry - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            below[f"_l{i}_{j}"] = entry / F.col(f"_l{j}_{j}")
        rows = rows.withColumns(below) if below else rows
    for i in range(p):
        value = right[i]
        for k in range(i):
            value = value - F.col(f"_l{i}_{k}") * F.col(f"_z{k}")
        rows = rows.withColumn(f"_z{i}", value / F.col(f"_l{i}_{i}"))
    for i in reversed(range(p)):
        value = F.col(f"_z{i}")
        for k in range(i + 1, p):
            value = value - F.col(f"_l{k}_{i}") * F.col(f"_g{k}")
        rows = rows.withColumn(f"_g{i}", value / F.col(f"_l{i}_{i}"))
    return _raw(rows, features, target).select("test_season", group, "decay", "n_train", "b0", *[f"b_{f}" for f in features])


def rising(
    folds: DataFrame,
    features: Sequence[str],
    rises: Sequence[str],
    target: str = "y",
    penalty: float = 0.1,
    group: str = "position",
    rounds: int = 100_000,
    still: float = 1e-13,
) -> DataFrame:
    """As ``ridge``, with the coefficients of the features in ``rises`` held at 0 or above.

    Coordinate descent on the correlations, all folds of a batch at once, until no coefficient moves by more than ``still``.
    ``kkt`` is how far the result is from the conditions of the optimum: the gradient of every free or positive coefficient
    is 0, and of one held at 0 does not point upwards.
    """
    rows, left, right = _standardised(folds, features, target)
    p = len(features)
    held = np.array([f in set(rises) for f in features])
    flat = F.array(*[left[i][j] for i in range(p) for j in range(p)], *right)
    given = rows.withColumn("_normal", flat)
    kept = [c for c in given.columns if c != "_normal"]

    def solve(batches):
        for batch in batches:
            normal = np.array(batch["_normal"].tolist(), float).reshape(len(batch), p * p + p)
            a = normal[:, : p * p].reshape(-1, p, p) + penalty * np.eye(p)
            b, g = normal[:, p * p :], np.zeros((len(batch), p))
            for _ in range(rounds):
                moved = 0.0
                for j in range(p):
                    best = g[:, j] + (b[:, j] - np.einsum("ij,ij->i", a[:, j], g)) / a[:, j, j]
                    best = np.maximum(best, 0.0) if held[j] else best
                    moved = max(moved, float(np.abs(best - g[:, j]).max(initial=0.0)))
                    g[:, j] = best
                if moved <= still:
                    break
            up = b - np.einsum("ijk,ik->ij", a, g)
            off = np.where(held & (g == 0), np.maximum(up, 0.0), np.abs(up))
            out = batch[kept].copy()
            for j in range(p):
                out[f"_g{j}"] = g[:, j]
            out["kkt"] = off.max(axis=1, initial=0.0)
            yield out

    added = [T.StructField(name, T.DoubleType()) for name in (*(f"_g{j}" for j in range(p)), "kkt")]
    solved = given.mapInPandas(solve, T.StructType([*given.drop("_normal").schema.fields, *added]))
    return _raw(solved, features, target).select("test_season", group, "decay", "n_train", "b0", *[f"b_{f}" for f in features], "kkt")


def squared_error(
    coefficients: DataFrame, moments: DataFrame, features: Sequence[str], target: str = "y", group: str = "position", season: str = "season"
) -> DataFrame:
    """Adds to coefficients the rows ``n_test`` of their test season and ``mse``, their mean squared error there."""
    columns = [*features, target]
    tested = moments.withColumnRenamed(season, "test_season").withColumnRenamed("n", "n_test")
    rows = coefficients.join(tested, ["test_season", group])
    error = F.col(product_of(target, target, columns))
    for f in features:
        error = error - 2 * F.col(f"b_{f}") * F.col(product_of(f, target, columns))
        for g in features:
            error = error + F.col(f"b_{f}") * F.col(f"b_{g}") * F.col(product_of(f, g, columns))
    miss = F.col(mean_of(target)) - F.col("b0")
    for f in features:
        miss = miss - F.col(f"b_{f}") * F.col(mean_of(f))
    return rows.select(*coefficients.columns, F.col("n_test").cast("bigint").alias("n_test"), (error + miss * miss).alias("mse"))


def choose_decay(errors: DataFrame, group: str = "position") -> DataFrame:
    """Per test season and group the decay with the least squared error over the folds before it, and its error here.

    A fold without one before it takes the largest decay, as no other has shown to be better; so do equal errors.
    """
    before = Window.partitionBy(group, "decay").orderBy("test_season").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.sum(F.col("mse") * F.col("n_test")).over(before) / F.sum("n_test").over(before)
    judged = errors.withColumn("_shown", F.coalesce(shown, F.lit(0.0)))
    best = F.min_by(F.struct("decay", "n_test", "mse"), F.struct("_shown", -F.col("decay"))).alias("best")
    return judged.groupBy("test_season", group).agg(best).select("test_season", group, "best.*")


def predict(
    df: DataFrame, coefficients: DataFrame, features: Sequence[str], group: str = "position", season: str = "season", out: str = "y_hat"
) -> DataFrame:
    """Predictions of each row by the coefficients of the fold that tests its season; null without them."""
    kept = coefficients.select(F.col("test_season").alias(season), group, "b0", *[f"b_{f}" for f in features])
    value = F.col("b0")
    for f in features:
        value = value + F.col(f"b_{f}") * F.col(f)
    return join_small(df, kept, [season, group]).withColumn(out, value).drop("b0", *[f"b_{f}" for f in features])
