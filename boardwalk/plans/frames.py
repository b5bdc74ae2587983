"""The warehouse tables in the roles the operators work on.

Customers are the entities, market segments their groups, nations their teams, years of orders the
seasons and order totals the points. The account balance sets the market price: the higher, the
earlier. Money is summed in whole cents, which no order of addition can change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.schemas import WAREHOUSE

# Shares of the 0..99 counter in an event's properties that stand for each sign-up source.
SOURCE_FROM = {0: "landing", 40: "register", 60: "checkout_abandon", 70: "manual", 80: "unlisted", 90: ""}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(WAREHOUSE[name]).parquet(f"{folder}/{name}.parquet")


def cents(money: str) -> Column:
    return F.round(F.col(money) * 100).cast("bigint")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """player_id, player_name, position, team, adp."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.col("c_mktsegment").alias("position"),
        F.col("c_nationkey").alias("team"),
        (F.floor((F.lit(1_000_000) - cents("c_acctbal")) / 500) / 10.0).alias("adp"),
        F.col("c_acctbal").alias("balance"),
    )


def order_cents(spark: SparkSession, folder: str) -> DataFrame:
    """player_id, season, cents of each order."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("player_id"),
        F.year("o_orderdate").alias("season"),
        cents("o_totalprice").alias("cents"),
    )


def players(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the points of all their orders, one decimal; null without orders."""
    totals = order_cents(spark, folder).groupBy("player_id").agg(F.sum("cents").alias("cents"))
    points = F.floor(F.col("cents") / 1_000_000) / 10.0
    return (
        customers(spark, folder)
        .join(totals, "player_id", "left")
        .withColumn("projected_points", points)
        .drop("cents")
    )


def season_points(spark: SparkSession, folder: str) -> DataFrame:
    """player_id, season, cents, and points ``y``: one row per customer and season with orders."""
    totals = order_cents(spark, folder).groupBy("player_id", "season").agg(F.sum("cents").alias("cents"))
    return totals.withColumn("y", F.col("cents") / 1e7)


def player_seasons(spark: SparkSession, folder: str) -> DataFrame:
    """``season_points`` with the customer's position, team and adp."""
    who = customers(spark, folder).select("player_id", "position", "team", "adp")
    return season_points(spark, folder).join(who, "player_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_rows(table(spark, folder, "events"))


def event_rows(stored: DataFrame) -> DataFrame:
    """Events, of a table or a stream, with an instant for time and the counter of their properties."""
    return stored.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event files of the folder as a stream."""
    files = spark.readStream.schema(WAREHOUSE["events"]).option("pathGlobFilter", "events.parquet")
    return event_rows(files.parquet(folder))


def source_of(k: Column | str) -> Column:
    counter = F.col(k) if isinstance(k, str) else k
    source = F.when(counter < 0, None)
    for start, name in sorted(SOURCE_FROM.items(), reverse=True):
        source = source.when(counter >= start, name)
    return source


def event_name(event_id: str) -> Column:
    """The id as text that sorts like the number."""
    return F.lpad(F.col(event_id).cast("string"), 19, "0")


def signups(events: DataFrame) -> DataFrame:
    """Sign-ups as captures and views as registrations; a value below 5 is an address left empty."""
    address = F.when(F.col("value") < 5, "").otherwise(
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com"))
    )
    path = F.when(F.col("event_type") == "signup", "capture").otherwise("register")
    return events.filter(F.col("event_type").isin("signup", "view")).select(
        event_name("event_id").alias("event_id"),
        "ts",
        address.alias("email"),
        source_of("k").alias("source"),
        path.alias("path"),
        F.col("user_id").cast("string").alias("user_id"),
    )


def payment_events(events: DataFrame, unlisted_from: int = 100) -> DataFrame:
    """Events in the payment envelope: purchases complete a checkout, the plan type may be empty.

    From the counter ``unlisted_from`` on the plan type is one that profiles cannot hold.
    """
    k = F.col("k")
    listed = F.when(k % 3 == 0, "season").when(k % 3 == 1, "draft").otherwise("")
    metadata = F.struct(
        F.col("user_id").cast("string").alias("user_id"),
        F.year("ts").cast("string").alias("season"),
        F.when(k >= unlisted_from, "lifetime").otherwise(listed).alias("plan_type"),
    )
    completed = F.when(F.col("event_type") == "purchase", "checkout.session.completed")
    return events.select(
        event_name("event_id").alias("event_id"),
        "ts",
        F.coalesce(completed, "event_type").alias("type"),
        F.struct(F.struct(metadata.alias("metadata")).alias("object")).alias("data"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as free profiles without a payment."""
    opened = F.lit("2023-12-31 00:00:00").cast("timestamp")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("email"),
        F.lit("free").alias("plan"),
        F.lit("season").alias("plan_type"),
        F.lit(None).cast("string").alias("season_paid"),
        F.lit(None).cast("timestamp").alias("paid_at"),
        opened.alias("created_at"),
        opened.alias("updated_at"),
    )
