"""Row rules, keys and references: what a table accepts, and what it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators.joins import having, without

# Domains and defaults of the subscriber tables.
PLANS = ("free", "paid")
PLAN_TYPES = ("season", "draft")
SOURCES = ("landing", "register", "checkout_abandon", "manual")
PROFILE_DEFAULTS = {"plan": "free", "plan_type": "season"}
EMAIL_DEFAULTS = {"source": "landing"}
REGISTER = "register"


@dataclass(frozen=True)
class Rule:
    """A reason and the condition, built on use, under which a row is rejected for it."""

    reason: str
    broken: Callable[[], Column]


def required(column: str) -> Rule:
    """A value that is neither null nor empty nor only blanks."""
    return Rule(f"{column} required", lambda: F.nullif(F.trim(F.col(column)), F.lit("")).isNull())


def one_of(column: str, allowed: Sequence[str]) -> Rule:
    """A value of the domain; null passes, as in a SQL check."""
    return Rule(f"{column} not allowed", lambda: F.coalesce(~F.col(column).isin(*allowed), F.lit(False)))


PROFILE_RULES = (required("id"), required("email"), one_of("plan", PLANS), one_of("plan_type", PLAN_TYPES))
EMAIL_RULES = (required("email"), one_of("source", SOURCES))
PAYMENT_RULES = (one_of("plan_type", PLAN_TYPES),)


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Null and empty texts become the column's default."""
    return df.withColumns({c: S.or_default(c, d) for c, d in defaults.items()})


def signup_sources(events: DataFrame) -> DataFrame:
    """Sign-up events with the source to store: that of a registration is ``register``, whatever it came with."""
    filled = fill_defaults(events, EMAIL_DEFAULTS)
    return filled.withColumn("source", F.when(F.col("path") == REGISTER, REGISTER).otherwise(F.col("source")))


def check(df: DataFrame, rules: Sequence[Rule], out: str = "reject_reason") -> DataFrame:
    """Adds the reason of the first rule a row breaks, null for an accepted row."""
    reason = F.coalesce(*[F.when(rule.broken(), rule.reason) for rule in rules])
    return df.withColumn(out, reason)


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    checked = check(df, rules)
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.filter(F.col("reject_reason").isNotNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing; a null key refers to nothing."""
    return without(child.filter(F.col(child_key).isNotNull()), parent.select(F.col(parent_key).alias(child_key)), [child_key])


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """What is left of the children once those of deleted parents are gone; those without a parent stay."""
    kept = having(child, parent.select(F.col(parent_key).alias(child_key)), [child_key])
    return kept.unionByName(child.filter(F.col(child_key).isNull()))


def visible_to(df: DataFrame, principal, owner: str = "id") -> DataFrame:
    """The rows a principal owns; nobody else's are shown."""
    return df.filter(F.col(owner) == F.lit(principal))


def slice_counts(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def distinct_keys(df: DataFrame, key: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Number of distinct keys, exact or as a sketch."""
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.groupBy(*by).agg(count.alias("n_keys"))
