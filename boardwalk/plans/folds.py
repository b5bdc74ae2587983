"""Queries over every fold at once: linear models from the moments of seasons, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.operators import agreement, features, moments, walkforward
from boardwalk.plans import frames
from boardwalk.plans.oracle import SEASONS
from boardwalk.plans.queries import naive_predictions, query
from boardwalk.session import materialise

FEATURES = ("lag", "mates", "adp")
PENALTY = 0.1


def fold_rows(spark, folder) -> DataFrame:
    """Player seasons with last season's points, the teammates' and the market price; what is missing is 0."""
    rows = features.teammate_production(frames.player_seasons(spark, folder), ["y"])
    return rows.select(
        "player_id",
        "season",
        "position",
        "y",
        F.coalesce("y_lag1", F.lit(0.0)).alias("lag"),
        F.coalesce("teammate_y_prev", F.lit(0.0)).alias("mates"),
        "adp",
    )


def season_figures(spark, folder) -> tuple[DataFrame, list[int]]:
    """The moments of each season, written once, and the seasons that have one before them."""
    stored = materialise(moments.season_moments(fold_rows(spark, folder), [*FEATURES, "y"]))
    return stored, walkforward.tested_seasons(stored)


def rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


COEFFICIENTS = ("b0", *(f"b_{f}" for f in FEATURES))


@query
def ridge_folds(spark, folder):
    stored, seasons = season_figures(spark, folder)
    fitted = moments.ridge(moments.fold_moments(stored, seasons, [*FEATURES, "y"]), FEATURES, penalty=PENALTY)
    return fitted.select("test_season", "position", "n_train", *rounded(*COEFFICIENTS))


@query
def monotone_lags(spark, folder):
    """Coefficients of the two lags that may not fall below 0, and whether the conditions of the optimum hold."""
    stored, seasons = season_figures(spark, folder)
    folds = moments.fold_moments(stored, seasons, [*FEATURES, "y"])
    fitted = moments.rising(folds, FEATURES, ["lag", "mates"], penalty=PENALTY)
    return fitted.select("test_season", "position", *rounded(*COEFFICIENTS), (F.col("kkt") < 1e-9).alias("optimal"))


@query
def decay_choice(spark, folder):
    """The recency decay of each fold and segment, chosen by the folds before it, and its error in the fold."""
    stored, seasons = season_figures(spark, folder)
    folds = moments.fold_moments(stored, seasons, [*FEATURES, "y"], moments.DECAYS)
    errors = moments.squared_error(moments.ridge(folds, FEATURES, penalty=PENALTY), stored, FEATURES)
    return moments.choose_decay(errors).select("test_season", "position", "decay", "n_test", *rounded("mse"))


ROWS = f"""{SEASONS},
x as (
  select player_id, season, position, y, coalesce(y_hat, 0) as x1, adp as x3,
    coalesce(sum(y_hat) over (partition by team, season), 0) - coalesce(y_hat, 0) as x2
  from lagged),
folds as (select distinct season as test_season from seas where season > (select min(season) from seas))"""


def fitted(decays: str, masks: str) -> str:
    """CTEs up to ``coefs``: penalised normal equations of every fold, decay and mask of features, by Cramer's rule."""

    def mean(c):
        return f"sum(w * {c}) / sum(w)"

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    matrix = [["a11", "a12", "a13"], ["a12", "a22", "a23"], ["a13", "a23", "a33"]]
    swapped = [[[f"r{i + 1}" if k == j else matrix[i][k] for k in range(3)] for i in range(3)] for j in range(3)]
    return f"""{ROWS}, decays(decay) as ({decays}), masks(u1, u2) as ({masks}),
weighted as (
  select test_season, position, decay, power(decay, test_season - 1 - season) as w, x1, x2, x3, y
  from x join folds on season < test_season cross join decays),
middles as (
  select test_season, position, decay, count(*) as n_train, {mean("x1")} as m1, {mean("x2")} as m2, {mean("x3")} as m3, {mean("y")} as my
  from weighted group by 1, 2, 3),
spread as (
  select test_season, position, decay, n_train, m1, m2, m3, my,
    {", ".join(f"{mean(f'(x{i} - m{i}) * (x{j} - m{j})')} as c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)},
    {", ".join(f"{mean(f'(x{i} - m{i}) * (y - my)')} as c{i}y" for i in (1, 2, 3))}
  from weighted join middles using (test_season, position, decay) group by 1, 2, 3, 4, 5, 6, 7, 8),
scaled as (
  select *, {", ".join(f"coalesce(nullif(sqrt(c{i}{i}), 0), 1) as s{i}" for i in (1, 2, 3))} from spread),
normal as (
  select *, c11 / (s1 * s1) + {PENALTY} as a11, c22 / (s2 * s2) + {PENALTY} as a22, c33 / (s3 * s3) + {PENALTY} as a33,
    u1 * u2 * c12 / (s1 * s2) as a12, u1 * c13 / (s1 * s3) as a13, u2 * c23 / (s2 * s3) as a23,
    u1 * c1y / s1 as r1, u2 * c2y / s2 as r2, c3y / s3 as r3
  from scaled cross join masks),
standard as (
  select *, {", ".join(f"{det(m)} / {det(matrix)} as g{j + 1}" for j, m in enumerate(swapped))} from normal),
coefs as (
  select *, g1 / s1 as b_lag, g2 / s2 as b_mates, g3 / s3 as b_adp, my - g1 / s1 * m1 - g2 / s2 * m2 - g3 / s3 * m3 as b0
  from standard)"""


ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in COEFFICIENTS)
SQL = {
    "ridge_folds": f"""with {fitted("values (1.0)", "values (1, 1)")}
        select test_season, position, n_train, {ROUNDED} from coefs""",
    # Of the four sets of lags left out, the one that is feasible and fits best: the fit improves with r'g.
    "monotone_lags": f"""with {fitted("values (1.0)", "values (1, 1), (1, 0), (0, 1), (0, 0)")},
        feasible as (
          select *, row_number() over (partition by test_season, position order by r1 * g1 + r2 * g2 + r3 * g3 desc, u1 desc, u2 desc) as best
          from coefs where g1 >= 0 and g2 >= 0)
        select test_season, position, {ROUNDED}, true as optimal from feasible where best = 1""",
    "decay_choice": f"""with {fitted("values (1.0), (0.9), (0.8), (0.65), (0.5)", "values (1, 1)")},
        errors as (
          select test_season, x.position, decay, count(*) as n_test,
            avg((y - b0 - b_lag * x1 - b_mates * x2 - b_adp * x3) ** 2) as mse
          from x join coefs on season = test_season and x.position = coefs.position group by 1, 2, 3),
        shown as (
          select *, coalesce(sum(mse * n_test) over earlier / sum(n_test) over earlier, 0) as before from errors
          window earlier as (partition by position, decay order by test_season rows between unbounded preceding and 1 preceding)),
        placed as (select *, row_number() over (partition by test_season, position order by before, decay desc) as best from shown)
        select test_season, position, cast(decay as double) as decay, n_test, round(mse, 6) as mse from placed where best = 1""",
}


@query
def rank_agreement(spark, folder):
    """How well the order by last season's points agrees with the season's, per season and segment; whole points, so that
    there are ties."""
    predicted = naive_predictions(spark, folder)
    whole = materialise(predicted.select("season", "position", F.floor("y_hat").alias("before"), F.floor("y").alias("now")))
    keys = ["season", "position"]
    tau = agreement.kendall(whole, "before", "now", keys)
    both = tau.join(agreement.spearman(whole, "before", "now", keys), keys)
    return both.select(*keys, "n", F.round("tau_b", 9).alias("tau_b"), F.round("spearman", 9).alias("spearman"))


SQL["rank_agreement"] = f"""with {SEASONS},
    w as (select player_id, season, position, floor(y_hat) as p, floor(y) as a from lagged where y_hat is not null),
    pairs as (
      select season, position, sign(x.p - z.p) as s, sign(x.a - z.a) as t
      from w x join w z using (season, position) where x.player_id < z.player_id),
    tau as (
      select season, position, sum(s * t) / nullif(sqrt(sum(s * s)) * sqrt(sum(t * t)), 0) as tau_b from pairs group by 1, 2),
    ranks as (
      select season, position,
        rank() over (partition by season, position order by p desc) + (count(*) over (partition by season, position, p) - 1) / 2.0 as r,
        rank() over (partition by season, position order by a desc) + (count(*) over (partition by season, position, a) - 1) / 2.0 as q
      from w),
    rho as (select season, position, count(*) as n, corr(r, q) as spearman from ranks group by 1, 2)
    select season, position, n, round(tau_b, 9) as tau_b, round(spearman, 9) as spearman from rho left join tau using (season, position)"""
