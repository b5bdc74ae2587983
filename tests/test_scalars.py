from datetime import datetime

import pytest
from frames_help import values
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S

EDGE = {"QB": "34%", "RB": "38%", "WR": "33%", "TE": "39%"}


def show(rows, kind, data, expression):
    df = rows([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def test_or_default_takes_null_zero_and_empty_as_missing(rows):
    assert show(rows, "double", [None, 0.0, 5.0], S.or_default("v", 999.0)) == [999.0, 999.0, 5.0]
    assert show(rows, "string", [None, "", "x"], S.or_default("v", "d")) == ["d", "d", "x"]


def test_points(rows):
    assert show(rows, "double", [None, 0.0, 98.3, 154.0], S.show_points("v")) == ["0.0", "0.0", "98.3", "154.0"]


def test_market_rank_rounds_half_even_and_hides_200(rows):
    data = [None, 0.0, 106.5, 127.5, 199.4, 199.5, 200.0, 310.0]
    assert show(rows, "double", data, S.show_market_rank("v")) == ["0", "0", "106", "128", "199", "200", "—", "—"]


def test_cut_rank_truncates(rows):
    assert show(rows, "double", [None, 139.5, 19.9], S.cut_rank("v")) == [0, 139, 19]


def test_gap(rows):
    data = [None, 0.0, 0.4, -0.4, 120.0, -112.9, 42.5]
    assert show(rows, "double", data, S.show_gap("v")) == ["0", "0", "+0", "0", "+120", "-112", "+42"]


def test_interval_text(rows):
    df = rows([(0.5, 1.5), (None, 156.0)], "a double, b double")
    assert [r.o for r in df.select(S.show_interval("a", "b").alias("o")).collect()] == ["0–2", "0–156"]


def test_risk_codes(rows):
    data = ["low", "LOW", "High", "medium", "odd", "", None]
    assert show(rows, "string", data, S.risk_text("v")) == ["LOW", "LOW", "HIGH", "MED", "MED", "MED", "MED"]
    assert show(rows, "string", data, S.risk_class("v")) == ["safe", "safe", "risky"] + ["medium"] * 4
    verdicts = show(rows, "string", data, S.risk_verdict("v")["text"])
    assert verdicts == ["LOW RISK", "LOW RISK", "HIGH RISK", "", "", "", ""]


def test_reason(rows):
    df = rows([(13.0, 169.0, "SLEEPER"), (19.5, 139.5, "SLEEPER"), (142.0, 30.0, "BUST")], "r double, a double, l string")
    assert [r.o for r in df.select(S.gap_reason("r", "a", "l").alias("o")).collect()] == [
        "Model rank #13 vs ADP #169.0 — SLEEPER",
        "Model rank #19 vs ADP #140.0 — SLEEPER",
        "Model rank #142 vs ADP #30.0 — BUST",
    ]


def test_lookups(rows):
    assert show(rows, "string", ["QB", "K", None], S.lookup(EDGE, "v", "none")) == ["34%", "none", "none"]
    assert show(rows, "string", ["QB", "TE"], S.required_lookup(EDGE, "v", "edge")) == ["34%", "39%"]
    with pytest.raises(SparkRuntimeException, match="no edge for K"):
        show(rows, "string", ["K"], S.required_lookup(EDGE, "v", "edge"))


def test_teams_and_dates(rows):
    assert show(rows, "string", [None, "GB"], S.team_or_free_agent("v")) == ["FA", "GB"]
    assert show(rows, "string", [None, "GB"], S.team_or_blank("v")) == ["", "GB"]
    at = F.lit(datetime(2026, 9, 5))
    for pattern, text in [
        (S.DATE_LONG, "September 05, 2026"),
        (S.DATE_MONTH, "September 2026"),
        (S.DATE_ISO, "2026-09-05"),
    ]:
        assert show(rows, "string", ["x"], S.date_stamp(at, pattern)) == [text]


def test_interval_and_spread_risk(rows):
    df = rows(
        [(98.3, 45.0), (89.6, 22.0), (30.0, 40.0), (50.0, 0.0), (0.0, 5.0), (100.0, 15.0), (100.0, 25.0)],
        "p double, u double",
    )
    out = df.select("p", "u", S.interval_low("p", "u").alias("lo"), S.interval_high("p", "u").alias("hi"), S.spread_risk("p", "u").alias("r"))
    assert [tuple(r)[2:] for r in out.collect()] == [
        (41.0, 156.0, "high"),
        (61.0, 118.0, "medium"),
        (0.0, 81.0, "high"),
        (50.0, 50.0, "low"),
        (0.0, 6.0, "high"),
        (81.0, 119.0, "medium"),
        (68.0, 132.0, "high"),
    ]


def test_score_and_flags(rows):
    df = rows([(4, 50.0, 1), (None, 10.0, 2), (1, None, 3), (0, 0.0, None)], "rec int, yards double, depth int")
    flags = S.starter_flags("depth")
    out = df.select(S.score({"rec": 0.5, "yards": 0.1}).alias("s"), *[c.alias(n) for n, c in flags.items()])
    assert values(out, "s", "is_starter", "is_backup") == [(0.0, 0, 0), (0.5, 0, 0), (1.0, 0, 1), (7.0, 1, 0)]


def test_lists(rows):
    df = rows([(["a", None, "b"], "RB"), ([], "QB"), (None, "TE")], "items array<string>, p string")
    out = df.select(S.join_texts(S.without_nulls("items"), "-").alias("t"), S.may_fill_flex("p", F.array(F.lit("rb"), F.lit("te"))).alias("f"))
    assert [tuple(r) for r in out.collect()] == [("a-b", True), ("", False), (None, True)]
