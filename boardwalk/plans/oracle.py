"""The same results as plain SQL, written independently of the Spark queries."""

from __future__ import annotations

CUST = """cust as (
  select c_custkey as player_id, c_name as player_name, c_mktsegment as position, c_nationkey as team,
    floor((1000000 - cast(round(c_acctbal * 100) as bigint)) / 500) / 10.0 as adp, c_acctbal as balance
  from customer)"""
ORD = """ord as (
  select o_custkey as player_id, cast(year(o_orderdate) as integer) as season,
    cast(round(o_totalprice * 100) as bigint) as cents
  from orders)"""
PLAYERS = f"""{CUST}, {ORD},
tot as (select player_id, cast(sum(cents) as bigint) as cents from ord group by player_id),
players as (
  select c.*, floor(t.cents / 1000000) / 10.0 as projected_points
  from cust c left join tot t on c.player_id = t.player_id)"""
SEASONS = f"""{CUST}, {ORD},
seas as (
  select player_id, season, cast(sum(cents) as bigint) as cents, sum(cents) / 1e7 as y
  from ord group by player_id, season),
pseas as (
  select s.*, c.position, c.team, c.adp, greatest(c.adp, 1.0) as market
  from seas s join cust c on s.player_id = c.player_id),
lagged as (
  select a.*, b.cents as cents_lag1, b.y as y_hat
  from pseas a left join seas b on a.player_id = b.player_id and b.season = a.season - 1)"""
GAPS = f"""{PLAYERS},
money as (
  select player_id, rank() over (order by coalesce(projected_points, 0) desc)
      + (count(*) over (partition by coalesce(projected_points, 0)) - 1) / 2.0 as avg_rank,
    rank() over (order by balance desc) + (count(*) over (partition by balance) - 1) / 2.0 as adp
  from players),
gaps as (
  select player_id, cast(avg_rank as double) as avg_rank, cast(adp as double) as adp,
    cast(adp - avg_rank as double) as adp_gap, cast(floor(avg_rank) as integer) as model_rank,
    case when adp > avg_rank then 'SLEEPER' when adp < avg_rank then 'BUST' end as label
  from money where abs(adp - avg_rank) >= 42)"""
NEED = """need(position, slots, n) as (
  values ('AUTOMOBILE', 1, 12), ('BUILDING', 2, 24), ('FURNITURE', 2, 24), ('HOUSEHOLD', 1, 12))"""
RANKED = f"""{PLAYERS}, {NEED},
ranked as (
  select p.player_id, p.position, p.projected_points, coalesce(p.projected_points, 0) as pts,
    row_number() over (partition by p.position order by coalesce(p.projected_points, 0) desc, p.player_id) as rn,
    need.slots, need.n
  from players p join need on p.position = need.position)"""
SPREAD = f"""{CUST}, {ORD},
spread as (
  select c.player_id, c.position, sum(o.cents) / 1e6 as pts, coalesce(stddev_samp(o.cents / 1e6), 0) as u
  from cust c join ord o on c.player_id = o.player_id group by c.player_id, c.position),
bounds as (
  select *, greatest(0, round_even(pts - 1.282 * u, 0)) as ci_low, round_even(pts + 1.282 * u, 0) as ci_high
  from spread)"""
FOLDS = "folds as (select distinct season as test_season from seas where season > (select min(season) from seas))"
NEWEST = "(select max(season) from seas)"
CALIBRATING = f"(select max(season) from seas where season < {NEWEST})"
BASELINE = f"""{SEASONS}, {FOLDS},
mids as (select position, avg(ln(market)) as mid from pseas group by position),
centred as (select p.*, mid, ln(market) - mid as z from pseas p join mids on p.position = mids.position),
sums as (
  select f.test_season, s.position, max(mid) as mid, count(*) as n_train, cast(count(*) as double) as n,
    sum(z) as x, sum(z ** 2) as x2, sum(z ** 3) as x3, sum(z ** 4) as x4,
    sum(y) as y, sum(y * z) as xy, sum(y * z ** 2) as x2y
  from centred s join folds f on s.season < f.test_season group by f.test_season, s.position),
dets as (
  select *, n * (x2 * x4 - x3 * x3) - x * (x * x4 - x3 * x2) + x2 * (x * x3 - x2 * x2) as d,
    y * (x2 * x4 - x3 * x3) - x * (xy * x4 - x3 * x2y) + x2 * (xy * x3 - x2 * x2y) as d0,
    n * (xy * x4 - x3 * x2y) - y * (x * x4 - x3 * x2) + x2 * (x * x2y - xy * x2) as d1,
    n * (x2 * x2y - xy * x3) - x * (x * x2y - xy * x2) + y * (x * x3 - x2 * x2) as d2
  from sums),
coefs as (
  select test_season, position, n_train, (d0 - d1 * mid + d2 * mid ** 2) / d as b0, (d1 - 2 * d2 * mid) / d as b1,
    d2 / d as b2
  from dets),
tested as (
  select l.player_id, l.season, l.position, l.y, l.y_hat,
    c.b0 + c.b1 * ln(l.market) + c.b2 * ln(l.market) ** 2 as y_base
  from lagged l join coefs c on l.season = c.test_season and l.position = c.position
  where l.y_hat is not null)"""
EVENTS = """ev as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as integer) as k
  from events),
src as (
  select *, case when k >= 90 then '' when k >= 80 then 'unlisted' when k >= 70 then 'manual'
    when k >= 60 then 'checkout_abandon' when k >= 40 then 'register' when k >= 0 then 'landing' end as source
  from ev)"""
SIGNUPS = f"""{EVENTS},
mail as (
  select event_id, ts, user_id, case when value < 5 then '' else 'user' || user_id || '@example.com' end as email,
    case when event_type = 'view' then 'register' when source = '' then 'landing' else source end as source,
    event_type = 'signup' as capture
  from src where event_type in ('signup', 'view')),
judged as (
  select *, case when email = '' then 'email required'
    when source not in ('landing', 'register', 'checkout_abandon', 'manual') then 'source not allowed'
    else 'accepted' end as outcome
  from mail)"""
LISTED = """listed as (
  select c_custkey as user_id, 'landing' as source, cast(-1 as bigint) as event_id
  from customer where c_nationkey < 12),
heard as (
  select user_id, source, event_id,
    row_number() over (partition by user_id order by ts desc, event_id desc) as newest,
    row_number() over (partition by user_id order by ts, event_id) as oldest
  from src where event_type = 'signup')"""
PAID = f"""{EVENTS},
pay as (
  select cast(user_id as varchar) as id, cast(year(ts) as varchar) as season_paid, epoch_us(ts) as paid_at_us,
    case k % 3 when 1 then 'draft' else 'season' end as plan_type,
    row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from ev where event_type = 'purchase'),
prof as (
  select cast(c.c_custkey as varchar) as id, case when p.id is null then 'free' else 'paid' end as plan,
    coalesce(p.plan_type, 'season') as plan_type, p.season_paid, p.paid_at_us,
    case when p.id is null then epoch_us(timestamp '2023-12-31 00:00:00')
      else epoch_us(timestamp '2026-04-20 12:00:00') end as updated_at_us
  from customer c left join (select * from pay where rn = 1) p on cast(c.c_custkey as varchar) = p.id)"""
EMAIL_LIST_PARTS = f"""with {SIGNUPS},
ok as (select * from judged where outcome = 'accepted'),
placed as (
  select *, row_number() over (
    partition by email order by capture desc, case when capture then -epoch_us(ts) else epoch_us(ts) end,
      case when capture then -event_id else event_id end) as rn
  from ok)"""
EMAIL_LIST = f"{EMAIL_LIST_PARTS} select email, source, epoch_us(ts) as created_us from placed where rn = 1"
PROFILES = f"with {PAID} select id, plan, plan_type, season_paid, paid_at_us, updated_at_us from prof"
CONVERSION = f"""with {EVENTS},
s as (
  select source, exists (select 1 from ev p where p.event_type = 'purchase' and p.user_id = src.user_id
    and p.ts > src.ts and p.ts <= src.ts + interval 7 days) as paid
  from src where event_type = 'signup')
select source, count(*) as n_signups, count(*) filter (paid) as n_converted,
  avg(cast(paid as integer)) as conversion
from s group by source"""

SQL: dict[str, str] = {
    "active_filter": f"""with {PLAYERS}
        select player_id, position, projected_points from players where coalesce(projected_points, 0) >= 20""",
    "group_topk": f"""with {PLAYERS},
        lim(position, k) as (values ('AUTOMOBILE', 32), ('BUILDING', 50), ('FURNITURE', 60),
          ('HOUSEHOLD', 24), ('MACHINERY', 32)),
        r as (
          select player_id, p.position, k, projected_points,
            row_number() over (partition by p.position order by projected_points desc, player_id) as rn
          from players p join lim on p.position = lim.position where projected_points >= 20)
        select player_id, position, cast(rn as integer) as rank, position || rn as rank_label,
          printf('%.1f', projected_points) as points
        from r where rn <= k""",
    "board_digest": f"""with {PLAYERS},
        lim(position, k) as (values ('AUTOMOBILE', 32), ('BUILDING', 50), ('FURNITURE', 60),
          ('HOUSEHOLD', 24), ('MACHINERY', 32)),
        r as (
          select p.position, k, p.position || row_number() over w || ' ' || player_name as line,
            row_number() over w as rn
          from players p join lim on p.position = lim.position where projected_points >= 20
          window w as (partition by p.position order by projected_points desc, player_id))
        select position, string_agg(line, ', ' order by rn) as board,
          position in ('BUILDING', 'FURNITURE', 'HOUSEHOLD') as flex
        from r where rn <= k group by position""",
    "avg_rank_gap": f"with {GAPS} select player_id, avg_rank, adp, adp_gap, model_rank, label from gaps",
    "gap_board": f"""with {GAPS},
        r as (select *, row_number() over (partition by label order by abs(adp_gap) desc, player_id) as rn from gaps)
        select label, cast(rn as integer) as rank, player_id, model_rank, cast(floor(adp) as integer) as market_rank,
          case when adp_gap > 0 then '+' || cast(floor(adp_gap) as bigint)
            else cast(cast(ceil(adp_gap) as bigint) as varchar) end as gap,
          'Model rank #' || model_rank || ' vs ADP #' || cast(round_even(adp, 0) as bigint) || '.0 — ' || label
            as reason
        from r where rn <= 15""",
    "tie_rank_table": f"""with {PLAYERS},
        t as (select position, coalesce(projected_points, 0) as projected_points, count(*) as ties
          from players group by 1, 2),
        b as (select *, coalesce(sum(ties) over (partition by position order by projected_points desc
          rows between unbounded preceding and 1 preceding), 0) as before from t)
        select position, projected_points, ties, cast(before + 1 as bigint) as min_rank,
          cast(before + (ties + 1) / 2.0 as double) as avg_rank from b""",
    "display_columns": f"""with {PLAYERS},
        s as (select *, projected_points / (3 + team % 6) as u from players),
        r as (
          select *, case when u / nullif(projected_points, 0) < 0.15 then 'low'
            when u / nullif(projected_points, 0) < 0.25 then 'medium' else 'high' end as risk,
            coalesce(greatest(0, round_even(projected_points - 1.282 * u, 0)), 0) as lo,
            coalesce(round_even(projected_points + 1.282 * u, 0), 0) as hi
          from s)
        select player_id, printf('%.1f', coalesce(projected_points, 0)) as points,
          case when adp >= 200 then '—' else cast(cast(round_even(adp, 0) as integer) as varchar) end as market_rank,
          cast(lo as integer) || '–' || cast(hi as integer) as interval,
          case risk when 'low' then 'LOW' when 'high' then 'HIGH' else 'MED' end as risk_text,
          case risk when 'low' then 'safe' when 'high' then 'risky' else 'medium' end as risk_class,
          case risk when 'low' then 'safe' when 'high' then 'risky' else '' end as verdict_class,
          case risk when 'low' then 'LOW RISK' when 'high' then 'HIGH RISK' else '' end as verdict_text,
          case position when 'AUTOMOBILE' then '34%' when 'BUILDING' then '38%' when 'FURNITURE' then '33%'
            when 'HOUSEHOLD' then '39%' else 'n/a' end as edge_text,
          case when team < 20 then cast(team as varchar) else 'FA' end as team_shown,
          'April 20, 2026' as updated, 'April 2026' as month, '2026-04-20' as iso_date
        from r""",
    "board_union": f"""with {PLAYERS}
        select player_id, player_name, position, team, adp, projected_points from players
        union all by name
        select s_suppkey as player_id, s_name as player_name, 'SUPPLIER' as position, s_nationkey as team
        from supplier""",
    "scarcity_table": f"""with {RANKED},
        g as (
          select position, max(pts) as top_pts, max(case when rn = n then pts end) as replacement_pts,
            max(slots) as slots, count(*) as n_players, max(n) as starters_needed,
            round(avg(case when rn <= n then pts end)
              - avg(case when rn > n and rn <= 2 * n then pts end), 6) as tier_gap
          from ranked group by position)
        select position, top_pts, replacement_pts, round(top_pts - replacement_pts, 6) as dropoff,
          round((top_pts - replacement_pts) / slots, 6) as dropoff_per_slot, tier_gap, n_players, starters_needed,
          cast(row_number() over (order by tier_gap desc nulls last, position) as integer) as scarcity_rank
        from g""",
    "vbd": f"""with {RANKED},
        lvl as (select position, pts as level from ranked where rn = n and position <> 'HOUSEHOLD')
        select p.player_id, p.position, p.projected_points,
          coalesce(round(coalesce(p.projected_points, 0) - level, 1), 0) as vbd
        from players p left join lvl on p.position = lvl.position""",
    "remaining_board": f"""with {PLAYERS}, {NEED},
        l as (select * from players
          where player_id not in (select user_id from events where event_type = 'purchase')),
        r as (select l.position, coalesce(projected_points, 0) as pts, n, row_number() over (
            partition by l.position order by coalesce(projected_points, 0) desc, player_id) as rn
          from l join need on l.position = need.position)
        select l.position, count(*) as n_left, max(r.pts) as replacement_pts
        from l left join (select * from r where rn = n) r on l.position = r.position group by l.position""",
    "flex_pool": f"""with {RANKED},
        o as (select *, row_number() over (order by pts desc, player_id) as fr from ranked
          where rn > n and position in ('BUILDING', 'FURNITURE', 'HOUSEHOLD'))
        select player_id, position, projected_points, cast(rn as integer) as group_rank,
          cast(fr as integer) as flex_rank
        from o where fr <= 12""",
    "interval_risk": f"""with {SPREAD}
        select player_id, position, ci_low, ci_high,
          case when u / pts < 0.15 then 'low' when u / pts < 0.25 then 'medium' else 'high' end as risk
        from bounds""",
    "risk_quartile": f"""with {SPREAD},
        w as (select *, (ci_high - ci_low) / pts as cv from bounds),
        q as (select position, quantile_cont(cv, 0.25) as q1, quantile_cont(cv, 0.75) as q3 from w group by position)
        select player_id, w.position, cv,
          case when cv <= q1 then 'low' when cv >= q3 then 'high' else 'medium' end as risk
        from w join q on w.position = q.position""",
    "bye_join": """with named as (
          select c_custkey as player_id, case n_name when 'NATION_22' then 'NATION_2' when 'NATION_23' then 'NATION_3'
            when 'NATION_24' then 'NATION_4' else n_name end as team
          from customer join nation on c_nationkey = n_nationkey),
        weeks as (
          select case n_name when 'NATION_22' then 'NATION_2' when 'NATION_23' then 'NATION_3'
            when 'NATION_24' then 'NATION_4' else n_name end as team, max(n_regionkey + 5) as bye
          from nation where n_regionkey > 0 group by 1)
        select player_id, named.team, cast(coalesce(bye, 0) as integer) as bye
        from named left join weeks on named.team = weeks.team""",
    "teammate_prev": f"""with {SEASONS}
        select player_id, season, team, cents_lag1,
          cast(coalesce(sum(cents_lag1) over (partition by team, season), 0) - coalesce(cents_lag1, 0) as bigint)
            as teammate_cents_prev
        from lagged""",
    "season_lag": f"with {SEASONS} select player_id, season, cents, cents_lag1 from lagged",
    "team_totals": f"""with {SEASONS}
        select team, season, cast(sum(cents) as bigint) as cents_total from pseas group by team, season""",
    "asof_nearest": """with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
        v as (select user_id, ts as vts, event_id as view_id from events where event_type = 'view'),
        c as (
          select p.event_id, p.user_id, v.view_id, abs(epoch_us(p.ts) - epoch_us(vts)) as micros_apart,
            row_number() over (partition by p.event_id
              order by abs(epoch_us(p.ts) - epoch_us(vts)), vts, v.view_id) as rn
          from p left join v on p.user_id = v.user_id)
        select event_id, user_id, view_id, micros_apart from c where rn = 1""",
    "depth_snapshot": """with o as (
          select o_custkey as player_id, cast(year(o_orderdate) as integer) as season, o_orderkey,
            cast(o_orderdate as date) as d, make_date(year(o_orderdate), 9, 5) as target
          from orders),
        r as (
          select *, row_number() over (
            partition by player_id, season order by abs(d - target), d, o_orderkey) as rn from o)
        select player_id, season, o_orderkey as order_id, cast(abs(d - target) as integer) as days_apart
        from r where rn = 1""",
    "latest_assignment": f"""with {EVENTS},
        m as (select user_id, k % 25 as team, row_number() over (
            partition by user_id order by ts desc, event_id desc) as rn from ev)
        select c_custkey as player_id, c_nationkey as old_team, coalesce(m.team, c_nationkey) as team
        from customer left join (select * from m where rn = 1) m on c_custkey = user_id""",
    "feature_merge": f"""with {CUST}, {ORD},
        o as (select player_id, min(season) as first_season, count(*) as n_orders from ord group by player_id),
        e as (select user_id, count(*) as n_events from events group by user_id),
        d as (select player_id, row_number() over (partition by team order by balance desc, player_id) as depth
          from cust)
        select c.player_id, first_season, n_orders, n_events,
          cast(n_orders is not null as integer) as has_1, cast(n_events is not null as integer) as has_2,
          cast(depth <= 2 as integer) as has_3,
          cast(coalesce(first_season = (select max(season) from ord), false) as integer) as is_rookie,
          cast(depth = 1 as integer) as is_starter, cast(depth = 2 as integer) as is_backup,
          n_events * cast(coalesce(first_season = (select max(season) from ord), false) as integer) as college_x_rookie
        from cust c left join o on c.player_id = o.player_id left join e on c.player_id = e.user_id
          join d on c.player_id = d.player_id""",
    "zscore_composite": f"""with {CUST}, {ORD},
        b as (select c.player_id, position, balance, (select count(*) from ord where ord.player_id = c.player_id)
          as n_orders from cust c)
        select player_id, position, round(
          0.6 * (balance - avg(balance) over (partition by position)) / stddev_samp(balance) over (partition by position)
          + 0.4 * (n_orders - avg(n_orders) over (partition by position))
            / stddev_samp(n_orders) over (partition by position), 6) as athletic_score
        from b""",
    "temporal_weight": f"""with {SEASONS}
        select player_id, round(sum(y * pow(0.8, {NEWEST} - season)) / sum(pow(0.8, {NEWEST} - season)), 8)
          as weighted_points, count(*) as n_seasons
        from seas group by player_id""",
    "shrink_mean": f"""with {SEASONS},
        b as (select c.player_id, c.position, s.cents from cust c
          left join seas s on c.player_id = s.player_id and s.season = {NEWEST}),
        m as (select position, avg(cents) as mean from b group by position)
        select player_id, b.position, coalesce(cast(0.6 as double) * cents + cast(0.4 as double) * mean, mean) as projected_points
        from b join m on b.position = m.position""",
    "scoring_profile": """select l_orderkey,
          round(sum(0.5 * l_quantity + 10 * l_discount - 5 * l_tax), 4) as points
        from lineitem group by l_orderkey""",
    "walk_forward": f"""with {SEASONS}, {FOLDS}
        select f.test_season, count(*) filter (s.season < f.test_season) as n_train,
          count(*) filter (s.season = f.test_season) as n_test,
          max(s.season) filter (s.season < f.test_season) as last_train_season
        from folds f join seas s on s.season <= f.test_season group by f.test_season""",
    "log_baseline": f"""with {BASELINE}
        select test_season, position, n_train, round(b0, 4) as b0, round(b1, 4) as b1, round(b2, 4) as b2
        from coefs""",
    "metrics_rollup": f"""with {BASELINE},
        both_scopes as (select position as scope, * from tested union all select 'Overall' as scope, * from tested),
        per_season as (
          select scope, season, count(*) as n, avg(abs(y - y_hat)) as mae, sqrt(avg((y - y_hat) ** 2)) as rmse,
            1 - avg((y - y_hat) ** 2) / var_pop(y) as r2, avg(abs(y - y_base)) as mae_base,
            1 - avg((y - y_base) ** 2) / var_pop(y) as r2_base
          from both_scopes group by scope, season)
        select scope, count(*) as n_seasons, cast(sum(n) as bigint) as n_rows, round(avg(mae), 6) as mae,
          round(avg(rmse), 6) as rmse, round(avg(r2), 6) as r2, round(avg(mae_base), 6) as mae_base,
          round(avg(r2_base), 6) as r2_base, round(1 - avg(mae) / avg(mae_base), 6) as edge
        from per_season group by scope""",
    "model_choice": f"""with {BASELINE},
        m as (
          select position, 'last_season' as best_model, y, y_hat as p from tested
          union all select position, 'market', y, y_base from tested),
        a as (
          select position, best_model, avg(abs(y - p)) as mae, sqrt(avg((y - p) ** 2)) as rmse,
            1 - avg((y - p) ** 2) / var_pop(y) as r2
          from m group by position, best_model),
        r as (select *, row_number() over (partition by position order by mae, best_model) as rn from a)
        select position, best_model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2
        from r where rn = 1""",
    "rank_backtest": f"""with {SEASONS},
        r as (
          select player_id, season, row_number() over (partition by season order by y_hat desc, player_id) as p,
            row_number() over (partition by season order by y desc, player_id) as a
          from lagged where y_hat is not null)
        select player_id, season, p as predicted_rank, a as actual_rank, abs(p - a) as rank_miss from r""",
    "coverage": f"""with {CUST}, {ORD},
        b as (
          select player_id, greatest(0, round_even(avg(cents / 1e5) - 1.282 * coalesce(stddev_samp(cents / 1e5), 0), 0))
              as lo, round_even(avg(cents / 1e5) + 1.282 * coalesce(stddev_samp(cents / 1e5), 0), 0) as hi
          from ord group by player_id),
        h as (
          select position, cast(cents / 1e5 between lo and hi as integer) as hit
          from ord join b on ord.player_id = b.player_id join cust on ord.player_id = cust.player_id)
        select position, count(*) as n, avg(hit) as coverage, abs(avg(hit) - 0.8) as coverage_error
        from h group by position""",
    "quantile_base": f"""with {SEASONS},
        q as (
          select position, quantile_cont(y - y_hat, 0.1) as e_lo, quantile_cont(y - y_hat, 0.9) as e_hi
          from lagged where y_hat is not null and season < {NEWEST} group by position)
        select player_id, l.position, round(y_hat + e_lo, 8) as lo, round(y_hat + e_hi, 8) as hi
        from lagged l join q on l.position = q.position where y_hat is not null and season = {NEWEST}""",
    "conformal_interval": f"""with {SEASONS},
        q as (
          select position, quantile_cont(y - y_hat, 0.1) as e_lo, quantile_cont(y - y_hat, 0.9) as e_hi
          from lagged where y_hat is not null and season < {CALIBRATING} group by position),
        b as (
          select l.position, season, y, y_hat + e_lo as lo, y_hat + e_hi as hi
          from lagged l join q on l.position = q.position where y_hat is not null and season >= {CALIBRATING}),
        s as (
          select position, greatest(lo - y, y - hi) as score,
            row_number() over (partition by position order by greatest(lo - y, y - hi)) as rn,
            count(*) over (partition by position) as n
          from b where season = {CALIBRATING}),
        m as (select position, score as margin from s where rn = ceil((n + 1) * 0.8))
        select b.position, count(*) as n, round(max(margin), 8) as margin,
          avg(cast(y between lo and hi as integer)) as raw_coverage,
          avg(cast(y between lo - margin and hi + margin as integer)) as coverage
        from b join m on b.position = m.position where season = {NEWEST} group by b.position""",
    "upsert_latest": f"""with {EVENTS}, {LISTED}
        select user_id, source, event_id from heard where newest = 1
        union all
        select user_id, source, event_id from listed where user_id not in (select user_id from heard)""",
    "insert_ignore": f"""with {EVENTS}, {LISTED}
        select user_id, source, event_id from listed
        union all
        select user_id, source, event_id from heard
        where oldest = 1 and user_id not in (select user_id from listed)""",
    "email_list": EMAIL_LIST,
    "payment_merge": f"""with {PAID},
        everyone as (select id from prof union select cast(user_id as varchar) from events)
        select everyone.id, coalesce(plan, 'free') as plan, coalesce(plan_type, 'season') as plan_type, season_paid,
          paid_at_us, updated_at_us
        from everyone left join prof on everyone.id = prof.id""",
    "quarantine": f"with {SIGNUPS} select outcome, source, count(*) as n from judged group by outcome, source",
    "key_checks": """select 'duplicate_lines' as check_name, count(*) as n from (
          select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
        union all select 'lines_without_order', count(*) from lineitem
          where l_orderkey not in (select o_orderkey from orders)
        union all select 'lines_with_order', count(*) from lineitem
          where l_orderkey in (select o_orderkey from orders)
        union all select 'customers_without_orders', count(*) from customer
          where c_custkey not in (select o_custkey from orders)
        union all select 'events_of_customers', count(*) from events
          where user_id in (select c_custkey from customer)""",
    "subscriber_slices": f"""with {PAID}
        select plan, plan_type, season_paid, count(*) as n from prof group by plan, plan_type, season_paid""",
    "own_rows": "select event_id, user_id, event_type, value from events where user_id = 7",
    "distinct_keys": "select event_type, count(distinct user_id) as n_keys from events group by event_type",
    "signup_conversion": CONVERSION,
    "stream_conversion": CONVERSION,
    "stream_payment": PROFILES,
    "stream_compacted": PROFILES,
    "stream_signup": EMAIL_LIST,
    "stream_repeats": """select cast(user_id as varchar) as user_id, count(*) as n_payments, max(epoch_us(ts)) as last_us
        from events where event_type = 'purchase' group by user_id""",
    "payment_quarantine": f"""with {EVENTS},
        pay as (
          select cast(user_id as varchar) as id, ts, event_id,
            case when k >= 90 then 'lifetime' when k % 3 = 1 then 'draft' else 'season' end as plan_type
          from ev where event_type = 'purchase'),
        bad as (select id, count(*) as n from pay where plan_type = 'lifetime' group by id),
        good as (
          select *, row_number() over (partition by id order by ts desc, event_id desc) as rn
          from pay where plan_type <> 'lifetime')
        select cast(c_custkey as varchar) as id, case when good.id is null then 'free' else 'paid' end as plan,
          coalesce(plan_type, 'season') as plan_type, epoch_us(good.ts) as paid_at_us, coalesce(n, 0) as n_rejected
        from customer left join (select * from good where rn = 1) good on cast(c_custkey as varchar) = good.id
          left join bad on cast(c_custkey as varchar) = bad.id""",
    "register_flow": f"""{EMAIL_LIST_PARTS},
        old as (
          select cast(c_custkey as varchar) as id, 'user' || c_custkey || '@example.com' as email,
            epoch_us(timestamp '2023-12-31 00:00:00') as opened_us
          from customer where c_nationkey < 12),
        reg as (
          select cast(user_id as varchar) as id, email, epoch_us(ts) as opened_us,
            row_number() over (partition by email order by ts, event_id) as rn
          from ok where not capture),
        prof as (
          select * from old
          union all select id, email, opened_us from reg where rn = 1 and id not in (select id from old)),
        list as (select email, source, epoch_us(ts) as created_us from placed where rn = 1)
        select coalesce(list.email, prof.email) as email, id, case when id is not null then 'free' end as plan,
          opened_us, source, created_us
        from list full join prof on list.email = prof.email""",
    "asof_null_keys": f"""with {EVENTS},
        p as (
          select event_id, case when k >= 5 then user_id end as user_id, case when k < 5 or k >= 10 then ts end as t
          from ev where event_type = 'purchase'),
        v as (
          select case when k >= 10 then user_id end as user_id, ts as vts, event_id as view_id
          from ev where event_type = 'view'),
        c as (
          select p.event_id, p.user_id, v.view_id, abs(epoch_us(t) - epoch_us(vts)) as micros_apart,
            row_number() over (partition by p.event_id order by abs(epoch_us(t) - epoch_us(vts)), vts, v.view_id) as rn
          from p left join v on p.user_id = v.user_id and p.t is not null)
        select event_id, user_id, view_id, micros_apart from c where rn = 1""",
    "ensemble_average": f"""with {BASELINE}
        select player_id, season, round((y_hat + y_base) / 2, 4) as y_hat,
          round(abs(y_hat - y_base) / sqrt(2), 4) as uncertainty, cast(2 as bigint) as n_models
        from tested""",
}
