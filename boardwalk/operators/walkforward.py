"""Walk-forward folds, the market baseline and the model ensemble."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.operators.joins import join_small
from boardwalk.session import scratch_path

# Tree depth of the boosted model, deeper for one group.
TREE_DEPTH = {"QB": 6}
OTHER_DEPTH = 4
TRAIN = "train"
TEST = "test"


def walk_forward(df: DataFrame, test_seasons: Sequence[int], season: str = "season") -> DataFrame:
    """Each row once per fold it serves: ``test`` in its own season's, ``train`` in all later ones."""
    folds = F.filter(F.array(*[F.lit(s) for s in test_seasons]), lambda t: t >= F.col(season))
    return df.withColumn("test_season", F.explode(folds)).withColumn(
        "role", F.when(F.col("test_season") == F.col(season), TEST).otherwise(TRAIN)
    )


def fold_sizes(df: DataFrame, test_seasons: Sequence[int], season: str = "season") -> DataFrame:
    """Rows and newest training season of each fold, from counts per season."""
    counts = df.groupBy(season).agg(F.count(F.lit(1)).alias("n"))
    train = F.col("role") == TRAIN
    return (
        walk_forward(counts, test_seasons, season)
        .groupBy("test_season")
        .agg(
            F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("n_train"),
            F.coalesce(F.sum(F.when(~train, F.col("n"))), F.lit(0)).alias("n_test"),
            F.max(F.when(train, F.col(season))).alias("last_train_season"),
        )
    )


def log_market_baseline(
    df: DataFrame,
    test_seasons: Sequence[int],
    group: str = "position",
    market: str = "adp",
    actual: str = "y",
    season: str = "season",
) -> DataFrame:
    """Per fold and group, outcome as a quadratic of log market price: ``b0 + b1·x + b2·x²``.

    Log prices are centred and scaled per group, then rows are reduced to power sums per season and
    group; folds add those up, and the normal equations are solved as column expressions. A fold of
    fewer than three different prices has null coefficients.
    """
    priced = df.filter((F.col(market) > 0) & F.col(actual).isNotNull()).select(
        season, group, F.ln(F.col(market)).alias("_x"), F.col(actual).alias("_y")
    )
    spread = F.coalesce(F.nullif(F.stddev_pop("_x"), F.lit(0.0)), F.lit(1.0))
    scales = priced.groupBy(group).agg(F.avg("_x").alias("_c"), spread.alias("_s"))
    x, y = (F.col("_x") - F.col("_c")) / F.col("_s"), F.col("_y")
    powers = {"x": x, "x2": x * x, "x3": x * x * x, "x4": x * x * x * x}
    products = {"y": y, "xy": x * y, "x2y": x * x * y}
    scaling = [F.max(c).alias(c) for c in ("_c", "_s")]
    sums = (
        join_small(priced, scales, [group])
        .groupBy(season, group)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(e).alias(n) for n, e in {**powers, **products}.items()],
            *scaling,
        )
    )
    # A price counts in the season it first appears in, so that folds add up to their different prices.
    first = priced.groupBy(group, "_x").agg(F.min(season).alias(season))
    prices = first.groupBy(season, group).agg(F.count(F.lit(1)).alias("prices"))
    names = ["n", *powers, *products, "prices"]
    folds = (
        walk_forward(sums.unionByName(prices, allowMissingColumns=True), test_seasons, season)
        .filter(F.col("role") == TRAIN)
        .groupBy("test_season", group)
        .agg(*[F.sum(c).alias(c) for c in names], *scaling)
    )
    left = [["n", "x", "x2"], ["x", "x2", "x3"], ["x2", "x3", "x4"]]
    right = ["y", "xy", "x2y"]
    base = _determinant([[F.col(c) for c in row] for row in left])
    base = F.when(F.col("prices") >= 3, base)
    solution = []
    for j in range(3):
        swapped = [[F.col(right[i] if k == j else left[i][k]) for k in range(3)] for i in range(3)]
        solution.append(F.try_divide(_determinant(swapped), base))
    a0, a1, a2 = solution
    ratio = F.col("_c") / F.col("_s")
    return folds.select(
        "test_season",
        group,
        F.col("n").cast("bigint").alias("n_train"),
        (a0 - a1 * ratio + a2 * ratio * ratio).alias("b0"),
        ((a1 - 2 * a2 * ratio) / F.col("_s")).alias("b1"),
        (a2 / (F.col("_s") * F.col("_s"))).alias("b2"),
    )


def _determinant(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def predict_baseline(
    df: DataFrame,
    coefficients: DataFrame,
    group: str = "position",
    market: str = "adp",
    season: str = "season",
    out: str = "y_base",
) -> DataFrame:
    """Baseline of each row by the coefficients of the fold that tests its season.

    Rows of seasons that no fold tests, and of groups a fold was not fitted on, have a null baseline.
    """
    fitted = coefficients.withColumnRenamed("test_season", season).drop("n_train")
    x = F.ln(F.when(F.col(market) > 0, F.col(market)))
    value = F.col("b0") + F.col("b1") * x + F.col("b2") * x * x
    return join_small(df, fitted, [season, group]).withColumn(out, value).drop("b0", "b1", "b2")


def group_models(group: str, weight: str | None, trees: int, rounds: int) -> Mapping[str, object]:
    """The regressors of one group: ridge, random forest and boosted trees."""
    shared = {"featuresCol": "_x", "labelCol": "y"}
    if weight:
        shared["weightCol"] = weight
    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, predictionCol="y_hat", **shared),
        "forest": RandomForestRegressor(numTrees=trees, maxDepth=6, seed=7, predictionCol="y_hat", **shared),
        "boosted": GBTRegressor(
            maxIter=rounds,
            maxDepth=TREE_DEPTH.get(group, OTHER_DEPTH),
            stepSize=0.1,
            seed=7,
            predictionCol="y_hat",
            **shared,
        ),
    }


def fit_predict(
    folds: DataFrame,
    features: Sequence[str],
    groups: Sequence[str],
    test_season: int,
    group: str = "position",
    weight: str | None = None,
    trees: int = 20,
    rounds: int = 20,
    parallel: int = 4,
) -> DataFrame:
    """Predictions of all of one fold's test rows by each model trained on that fold's training rows.

    Training takes the rows with an outcome; every test row is predicted, with or without one. A missing
    feature counts as 0; where a feature is missing in some rows, a second column of 0 or 1 says so. A group without training rows keeps its
    test rows, with null predictions.

    ``folds`` comes from ``walk_forward`` and has the outcome ``y``. Training rows are written once,
    partitioned by group, so that every fit reads its own group only; the fits themselves are
    distributed, and a few of them run at a time.
    """
    spark = folds.sparkSession
    fold = folds.filter((F.col("test_season") == test_season) & ((F.col("role") == TEST) | F.col("y").isNotNull()))
    given, absent = _feature_columns(fold, features)
    fold = fold.withColumns({**given, **absent})
    path = scratch_path(spark, "fold")
    fold.withColumn("_group", F.col(group)).write.partitionBy("role", "_group").parquet(path)
    stored = spark.read.schema(fold.schema.add("_group", "string")).parquet(path)
    assembler = VectorAssembler(inputCols=[*given, *absent], outputCol="_x")
    trained = stored.filter(F.col("role") == TRAIN).groupBy("_group").count().collect()
    known = {r["_group"] for r in trained}

    def predict(name: str, model: str) -> DataFrame:
        rows = stored.filter(F.col("_group") == name)
        if name not in known:
            return rows.filter(F.col("role") == TEST).withColumns({"y_hat": F.lit(None).cast("double"), "model": F.lit(model)})
        regressor = group_models(name, weight, trees, rounds)[model]
        fitted = Pipeline(stages=[assembler, regressor]).fit(rows.filter(F.col("role") == TRAIN))
        return fitted.transform(rows.filter(F.col("role") == TEST)).withColumn("model", F.lit(model))

    tasks = [(name, model) for name in groups for model in ("ridge", "forest", "boosted")]
    with ThreadPoolExecutor(parallel) as pool:
        predictions = list(pool.map(lambda task: predict(*task), tasks))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), predictions)
    return both.drop("_x", "_group", *given, *absent)


def tested_seasons(df: DataFrame, season: str = "season") -> list[int]:
    """The seasons of the rows, oldest first, without the oldest one, which has none before it to train on."""
    seasons = df.select(season).where(F.col(season).isNotNull()).distinct().collect()
    return sorted(r[0] for r in seasons)[1:]


def predict_folds(
    df: DataFrame,
    test_seasons: Sequence[int],
    features: Sequence[str],
    groups: Sequence[str],
    group: str = "position",
    weight: str | None = None,
    trees: int = 20,
    rounds: int = 20,
    models: Sequence[str] = ("forest", "boosted"),
    parallel: int = 8,
) -> DataFrame:
    """``fit_predict`` of every fold, from one copy of the rows.

    Rows are written once, in a folder for each season and group, so a fold reads the folders of its seasons and no row is
    stored for every fold it serves. Fits of all folds, groups and models run a few at a time; each writes its predictions,
    which are then read as one table, so neither models nor plans add up on the driver. Without folds there are no rows.
    """
    spark = df.sparkSession
    given, absent = _feature_columns(df, features)
    path = scratch_path(spark, "folds")
    named = df.withColumns({**given, **absent}).withColumns({"_season": F.col("season"), "_group": F.col(group)})
    named.write.partitionBy("_season", "_group").parquet(f"{path}/rows")
    stored = spark.read.schema(named.schema).parquet(f"{path}/rows")
    counted = stored.filter(F.col("y").isNotNull()).groupBy("_season", "_group").count().collect()
    first = {name: min(r["_season"] for r in counted if r["_group"] == name) for name in {r["_group"] for r in counted}}
    assembler = VectorAssembler(inputCols=[*given, *absent], outputCol="_x")
    kept = [*df.columns, "test_season", "y_hat", "model"]

    def predict(test: int, name: str, model: str) -> None:
        own = stored.filter(F.col("_group") == name)
        tested = own.filter(F.col("_season") == test).withColumn("test_season", F.lit(test))
        if first.get(name, test) >= test:
            found = tested.withColumn("y_hat", F.lit(None).cast("double"))
        else:
            train = own.filter((F.col("_season") < test) & F.col("y").isNotNull())
            regressor = group_models(name, weight, trees, rounds)[model]
            found = Pipeline(stages=[assembler, regressor]).fit(train).transform(tested)
        found = found.withColumn("model", F.lit(model)).select(*kept)
        found.write.parquet(f"{path}/predictions/task={test}-{model}-{groups.index(name)}")

    tasks = [(test, name, model) for test in test_seasons for name in groups for model in models]
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(lambda task: predict(*task), tasks))
    added = [T.StructField("test_season", T.IntegerType()), T.StructField("y_hat", T.DoubleType()), T.StructField("model", T.StringType())]
    kinds = T.StructType([*df.schema.fields, *added])
    if not tasks:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(f"{path}/predictions").select(*kept)


def _feature_columns(df: DataFrame, features: Sequence[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """The features with 0 for what is missing, and for each feature that some row lacks, a column of 0 or 1 that says so."""
    given = {f"_f_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0)) for f in features}
    absent = {f"_no_{f}": (F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("double") for f in features}
    lacking = df.agg(*[F.max(c).alias(name) for name, c in absent.items()]).first()
    return given, {name: c for name, c in absent.items() if lacking[name]}


def ensemble(predictions: DataFrame, keys: Sequence[str], predicted: str = "y_hat") -> DataFrame:
    """Mean and spread of the models' predictions for each entity."""
    return predictions.groupBy(*keys).agg(
        F.avg(predicted).alias("y_hat"),
        F.stddev_samp(predicted).alias("uncertainty"),
        F.count(predicted).alias("n_models"),
    )
