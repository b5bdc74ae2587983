"""Queries that go through the data products: JSON written to the scratch folder, read back, published, appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk import schemas
from boardwalk.functions import scalars as S
from boardwalk.operators import metrics, ranking, scarcity, sketches
from boardwalk.plans import boards, frames
from boardwalk.plans.oracle import CUST, GAPS, SEASONS
from boardwalk.plans.queries import MIN_GAP, UPDATED, money_rank, naive_predictions, query, roster_config
from boardwalk.session import scratch_path
from boardwalk.sources import buckets, readers, sinks

POSITIONS = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "K"}
ARRAY_RECORDS = 1000


def write_arrays(rows: DataFrame, number: str, path: str) -> None:
    """Rows as files of one JSON array each; a file holds the rows of a run of ``ARRAY_RECORDS`` numbers."""
    record = F.struct(*[F.col(c) for c in rows.columns if c != number])
    run = F.floor(F.col(number) / ARRAY_RECORDS).alias("run")
    arrays = rows.groupBy(run).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("run").text(path)


def write_map(rows: DataFrame, key: str, value, path: str) -> None:
    """A small table as one JSON object; ``value`` is a column."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(key), value.alias("value"))))
    rows.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)


def projections(spark, folder) -> DataFrame:
    """The players as projection records, with their number; ids are texts that sort like numbers."""
    players = frames.players(spark, folder)
    given = {
        "player_id": F.lpad(F.col("player_id").cast("string"), 19, "0"),
        "player_name": F.col("player_name"),
        "position": F.element_at(F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair]), F.col("position")),
        "team": F.col("team").cast("string"),
        "projected_points": F.col("projected_points"),
        "adp": F.col("adp"),
    }
    kinds = schemas.PROJECTIONS.fields
    return players.select(F.col("player_id").alias("number"), *[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


@query
def json_products(spark, folder):
    """Players read from JSON arrays, with their bye from a JSON map, their group's error from a map of records, and the
    starters of a JSON configuration; a map that is not there has no rows."""
    target = scratch_path(spark, "products")
    write_arrays(projections(spark, folder), "number", f"{target}/players")
    nations = frames.table(spark, folder, "nation")
    write_map(nations.select(F.col("n_nationkey").cast("string").alias("team"), "n_regionkey"), "team", F.col("n_regionkey") + 5, f"{target}/byes")
    scored = metrics.accuracy(naive_predictions(spark, folder), ["position"])
    record = F.struct(F.lit("last_season").alias("best_model"), "mae", "rmse", "r2")
    write_map(scored, "position", record, f"{target}/accuracy")
    sinks.export_json(roster_config(spark), f"{target}/config")

    players = readers.read_records(spark, f"{target}/players", schemas.PROJECTIONS).drop("run", "bye")
    byes = readers.read_map(spark, f"{target}/byes", T.IntegerType(), key="team", out="bye")
    accuracy = boards.read_accuracy(spark, f"{target}/accuracy").select(F.col("position").alias("segment"), "mae")
    lost = boards.read_accuracy(spark, f"{target}/nowhere").select(F.col("position").alias("segment"), F.lit(1).alias("lost"))
    needed = scarcity.starters_needed(readers.read_roster_config(spark, f"{target}/config")).withColumnRenamed("position", "segment")
    segments = F.create_map(*[F.lit(x) for segment, position in POSITIONS.items() for x in (position, segment)])
    joined = players.withColumn("segment", F.element_at(segments, F.col("position")))
    for small in (accuracy, lost, needed):
        joined = joined.join(small, "segment", "left")
    return joined.join(byes, "team", "left").select(
        F.col("player_id").cast("bigint").alias("player_id"),
        "position",
        "projected_points",
        "adp",
        "bye",
        F.round("mae", 6).alias("mae"),
        F.coalesce("starters_needed", F.lit(0)).cast("int").alias("starters_needed"),
        F.coalesce("lost", F.lit(0)).alias("lost"),
    )


@query
def boards_published(spark, folder):
    """The boards as read back from the site's folders, after an earlier run with other players, and the run's report."""
    target = scratch_path(spark, "site")
    players = projections(spark, folder)
    gaps = ranking.value_gap(money_rank(frames.players(spark, folder)), min_gap=MIN_GAP)
    gaps = gaps.withColumn("reason", S.gap_reason("model_rank", "adp", "label"))
    gaps = gaps.select("player_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.VALUE_GAPS.fields])
    write_arrays(gaps, "player_id", f"{target}/gaps")
    for name, kept in (("old", players.filter("number % 2 = 0")), ("new", players)):
        sinks.export_json(kept.drop("number"), f"{target}/{name}")
        report = boards.publish(spark, f"{target}/{name}", f"{target}/gaps", f"{target}/boards", UPDATED)
    published = spark.read.parquet(f"{target}/boards")
    return published.select(
        "board",
        "rank",
        "player_name",
        "points",
        "market_rank",
        F.coalesce("gap", F.lit("")).alias("gap"),
        "updated",
        *[F.lit(report[name]).cast("bigint").alias(name) for name in ("n_active", "n_gaps", "n_rows")],
    )


@query
def keyed_appends(spark, folder):
    """The profile of every user with an event, read by key from a table that registrations were appended to; those whose
    user it held already add nothing."""
    path = f"{scratch_path(spark, 'profiles')}/table"
    kinds = "id string, opened timestamp, event_id bigint"
    stored = frames.customers(spark, folder).filter(F.col("team") < 12)
    opened = F.lit("2023-12-31 00:00:00").cast("timestamp")
    stored.select(F.col("player_id").cast("string").alias("id"), opened.alias("opened"), F.lit(-1).cast("bigint").alias("event_id")).write.parquet(path)
    events = frames.events(spark, folder)
    user = F.col("user_id").cast("string").alias("id")
    offered = events.filter(F.col("event_type") == "view").select(user, F.col("ts").alias("opened"), "event_id")
    sinks.append_new(spark.read.schema(kinds).parquet(path), offered, path, ["id"], ["opened", "event_id"])
    found = readers.find_by_key(events.select(user).distinct(), spark.read.schema(kinds).parquet(path))
    return found.select("id", F.unix_micros("opened").alias("opened_us"), "event_id")


SQL = {
    "json_products": f"""with {SEASONS},
        tot as (select player_id, cast(sum(cents) as bigint) as cents from ord group by player_id),
        err as (select position, avg(abs(y - y_hat)) as mae from lagged where y_hat is not null group by position),
        need(position, n, short) as (values ('AUTOMOBILE', 12, 'QB'), ('BUILDING', 24, 'RB'), ('FURNITURE', 24, 'WR'),
          ('HOUSEHOLD', 12, 'TE'), ('MACHINERY', 0, 'K'))
        select cust.player_id, short as position, floor(cents / 1000000) / 10.0 as projected_points, adp,
          cast(n_regionkey + 5 as integer) as bye, round(mae, 6) as mae, n as starters_needed, 0 as lost
        from cust left join tot using (player_id) join need using (position) left join err using (position)
          left join nation on team = n_nationkey""",
    "boards_published": f"""with {GAPS},
        lim(position, k, board) as (values ('AUTOMOBILE', 32, 'qb-rankings'), ('BUILDING', 50, 'rb-rankings'),
          ('FURNITURE', 60, 'wr-rankings'), ('HOUSEHOLD', 24, 'te-rankings')),
        r as (
          select board, k, player_name, projected_points, adp,
            row_number() over (partition by board order by projected_points desc, player_id) as rn
          from players join lim using (position) where projected_points >= 20),
        g as (
          select *, row_number() over (partition by label order by abs(adp_gap) desc, player_name, position) as rn
          from gaps join (select player_id, player_name, position, projected_points from players) using (player_id)
          where label is not null),
        shown as (
          select board, cast(rn as integer) as rank, player_name, printf('%.1f', projected_points) as points,
            case when adp >= 200 then '—' else cast(cast(round_even(adp, 0) as integer) as varchar) end as market_rank,
            '' as gap
          from r where rn <= k
          union all
          select case label when 'SLEEPER' then 'top-sleepers' else 'top-busts' end, cast(rn as integer), player_name,
            printf('%.1f', coalesce(projected_points, 0)), cast(cast(floor(adp) as integer) as varchar),
            case when adp_gap > 0 then '+' || cast(floor(adp_gap) as bigint) else cast(cast(ceil(adp_gap) as bigint) as varchar) end
          from g where rn <= 15)
        select *, 'April 20, 2026' as updated, (select count(*) from players where projected_points >= 20) as n_active,
          (select count(*) from gaps) as n_gaps, (select count(*) from shown) as n_rows from shown""",
    "keyed_appends": f"""with {CUST},
        viewed as (
          select cast(user_id as varchar) as id, epoch_us(ts) as opened_us, event_id,
            row_number() over (partition by user_id order by ts, event_id) as rn
          from events where event_type = 'view'),
        stored as (
          select cast(player_id as varchar) as id, epoch_us(timestamp '2023-12-31 00:00:00') as opened_us, cast(-1 as bigint) as event_id
          from cust where team < 12),
        held as (
          select * from stored
          union all select id, opened_us, event_id from viewed where rn = 1 and id not in (select id from stored))
        select asked.id, opened_us, event_id
        from (select distinct cast(user_id as varchar) as id from events) asked left join held on asked.id = held.id""",
}


@query
def distinct_sketches(spark, folder):
    """Distinct users per event type and month, exact and whether the stored daily sketches come within four standard errors."""
    path = f"{scratch_path(spark, 'sketches')}/daily"
    events = frames.events(spark, folder)
    sketches.daily_sketches(events, "user_id", ["event_type"]).write.parquet(path)
    month = F.trunc("day", "month").alias("month")
    estimated = sketches.distinct_between(spark.read.parquet(path), ["event_type", month])
    exact = events.groupBy("event_type", F.trunc(F.to_date("ts"), "month").alias("month")).agg(F.count_distinct("user_id").alias("n_users"))
    bound = 4 * sketches.relative_error() * F.col("n_users") + 1
    close = (F.abs(F.col("n_estimated") - F.col("n_users")) <= bound).alias("close")
    return exact.join(estimated, ["event_type", "month"]).select("event_type", F.date_format("month", "yyyy-MM").alias("month"), "n_users", close)


SQL["distinct_sketches"] = """
    select event_type, strftime(ts, '%Y-%m') as month, count(distinct user_id) as n_users, true as close
    from events group by 1, 2"""


@query
def keyed_reads(spark, folder):
    """Every event's user with the profile that a table in buckets has of it."""
    stored = buckets.store(frames.profiles(spark, folder), f"{scratch_path(spark, 'buckets')}/profiles", 16)
    users = frames.events(spark, folder).select(F.col("user_id").cast("string").alias("id")).distinct()
    return buckets.find(users, stored).select("id", "email", "plan", F.unix_micros("created_at").alias("opened_us"))


SQL["keyed_reads"] = """
    select u.id, 'user' || c_custkey || '@example.com' as email, case when c_custkey is not null then 'free' end as plan,
      case when c_custkey is not null then epoch_us(timestamp '2023-12-31 00:00:00') end as opened_us
    from (select distinct cast(user_id as varchar) as id from events) u left join customer on u.id = cast(c_custkey as varchar)"""
