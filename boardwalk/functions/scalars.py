"""Column expressions: defaults, display text, intervals, risk and scoring.

Rounding of shown values is half-even (``bround``), as the published boards have it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_MARKET_RANK = "—"
HIDDEN_FROM_RANK = 200
INTERVAL_DASH = "–"
Z_80 = 1.282
RISK_LOW_BELOW = 0.15
RISK_HIGH_FROM = 0.25
NO_TEAM = "FA"
SLEEPER = "SLEEPER"
BUST = "BUST"
RISK_TEXT = {"low": "LOW", "medium": "MED", "high": "HIGH"}
RISK_CLASS = {"low": "safe", "medium": "medium", "high": "risky"}
DATE_LONG = "MMMM dd, yyyy"
DATE_MONTH = "MMMM yyyy"
DATE_ISO = "yyyy-MM-dd"


def or_default(value: Column | str, default) -> Column:
    """``default`` when a number is null or 0, or a text is null or empty."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(_col(value), F.lit(empty)), F.lit(default))


def or_zero(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0.0))


def whole(value: Column) -> Column:
    """Half-even whole number."""
    return F.bround(value, 0).cast("int")


def show_points(value: Column | str) -> Column:
    """One decimal; a missing value shows as 0.0."""
    return F.format_string("%.1f", F.bround(or_zero(value), 1))


def show_market_rank(value: Column | str) -> Column:
    """Rounded market rank; unranked (200 and beyond) is a dash, missing is 0."""
    rank = or_zero(value)
    return F.when(rank >= HIDDEN_FROM_RANK, F.lit(NO_MARKET_RANK)).otherwise(whole(rank).cast("string"))


def show_interval(low: Column | str, high: Column | str) -> Column:
    return F.concat_ws(INTERVAL_DASH, whole(or_zero(low)).cast("string"), whole(or_zero(high)).cast("string"))


def show_gap(value: Column | str) -> Column:
    """Signed whole gap, cut toward zero; the plus sign follows the uncut value."""
    gap = or_zero(value)
    return F.concat(F.when(gap > 0, F.lit("+")).otherwise(F.lit("")), gap.cast("int").cast("string"))


def cut_rank(value: Column | str) -> Column:
    return or_zero(value).cast("int")


def rank_label(group: Column | str, rank: Column | str) -> Column:
    return F.concat(_col(group), _col(rank).cast("string"))


def gap_reason(rank: Column | str, market: Column | str, label: Column | str) -> Column:
    return F.format_string(
        "Model rank #%d vs ADP #%s — %s",
        _col(rank).cast("int"),
        F.concat(F.bround(_col(market), 0).cast("bigint").cast("string"), F.lit(".0")),
        _col(label),
    )


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: Mapping, key: Column | str, default=None) -> Column:
    """Value of ``key`` in a literal map, or ``default``."""
    found = F.try_element_at(literal_map(values), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def required_lookup(values: Mapping, key: Column | str, what: str) -> Column:
    """Value of ``key`` in a literal map; an unknown key fails the query."""
    found = F.try_element_at(literal_map(values), _col(key))
    unknown = F.concat(F.lit(f"no {what} for "), F.coalesce(_col(key).cast("string"), F.lit("null")))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(unknown))


def _risk_code(value: Column | str) -> Column:
    return F.lower(or_default(value, "medium"))


def risk_text(value: Column | str) -> Column:
    return lookup(RISK_TEXT, _risk_code(value), RISK_TEXT["medium"])


def risk_class(value: Column | str) -> Column:
    return lookup(RISK_CLASS, _risk_code(value), RISK_CLASS["medium"])


def risk_verdict(value: Column | str) -> Column:
    """Struct of class and text for the two outer tiers, empty texts for the rest."""
    code = _risk_code(value)

    def verdict(css: str, text: str) -> Column:
        return F.struct(F.lit(css).alias("class"), F.lit(text).alias("text"))

    return (
        F.when(code == "low", verdict("safe", "LOW RISK"))
        .when(code == "high", verdict("risky", "HIGH RISK"))
        .otherwise(verdict("", ""))
    )


def team_or_free_agent(team: Column | str) -> Column:
    return F.coalesce(_col(team), F.lit(NO_TEAM))


def team_or_blank(team: Column | str) -> Column:
    return F.coalesce(_col(team), F.lit(""))


def date_stamp(at: Column | str, pattern: str = DATE_LONG) -> Column:
    return F.date_format(_col(at), pattern)


def interval_low(points: Column | str, spread: Column | str, z: float = Z_80) -> Column:
    return F.greatest(F.lit(0.0), F.bround(_col(points) - F.lit(z) * _col(spread), 0))


def interval_high(points: Column | str, spread: Column | str, z: float = Z_80) -> Column:
    return F.bround(_col(points) + F.lit(z) * _col(spread), 0)


def spread_risk(
    points: Column | str, spread: Column | str, low: float = RISK_LOW_BELOW, high: float = RISK_HIGH_FROM
) -> Column:
    """Risk tier from the spread as a share of the projection; no projection is high risk."""
    share = F.try_divide(_col(spread), _col(points))
    return F.when(share < low, "low").when(share < high, "medium").otherwise("high")


def starter_flags(depth_rank: Column | str) -> dict[str, Column]:
    depth = _col(depth_rank)
    return {
        "is_starter": F.coalesce((depth == 1).cast("int"), F.lit(0)),
        "is_backup": F.coalesce((depth == 2).cast("int"), F.lit(0)),
    }


def interaction(left: Column | str, right: Column | str) -> Column:
    return _col(left) * _col(right)


def score(weights: Mapping[str, float]) -> Column:
    """Points of one stat line: the weighted sum of its columns, a missing stat counting 0."""
    return reduce(lambda a, b: a + b, [or_zero(stat) * F.lit(float(w)) for stat, w in weights.items()])


def without_nulls(items: Column | str) -> Column:
    return F.array_compact(_col(items))


def join_texts(items: Column | str, separator: str = "") -> Column:
    return F.array_join(_col(items), separator)


def may_fill_flex(position: Column | str, eligible: Column | str) -> Column:
    """Whether the roster's flex list, written in lower case, names the position."""
    return F.array_contains(_col(eligible), F.lower(_col(position)))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
