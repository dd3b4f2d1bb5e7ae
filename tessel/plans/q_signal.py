"""Usage signals on the events table: type as route, value as score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import signal
from .base import query


def turns(t):
    return t("events").where("event_type <> 'purchase'").select(F.col("event_id").alias("id"), F.col("event_type").alias("route"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("shown"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question"), (F.col("event_id") % 4 == 0).alias("share"), "ts")


TURNS = """WITH turns AS (SELECT event_id AS id, event_type AS route, value AS score, CAST(json_extract_string(props, '$.k') AS INT) AS shown, 'q' || user_id AS question, event_id % 4 = 0 AS share, ts FROM events WHERE event_type <> 'purchase'),
  sig AS (SELECT id, route, score < 1 AS refused, CASE WHEN score < 10 THEN 'low' WHEN score < 50 THEN 'mid' ELSE 'high' END AS top, shown, CASE WHEN share THEN left(question, 300) END AS q, ts FROM turns)"""


@query("t1_turn_signals", f"{TURNS} SELECT id, route, refused, top, shown, q FROM sig")
def t1(t):
    return signal.turn_signals(turns(t)).select("id", "route", "refused", "top", "shown", "q")


@query("t2_feedback", "SELECT event_id AS id, CASE WHEN value >= 50 THEN 'Yes' WHEN value >= 10 THEN 'No' ELSE 'none' END AS helpful FROM events WHERE event_type = 'purchase'")
def t2(t):
    return feedback(t).select("event_id", "helpful").withColumnRenamed("event_id", "id")


def feedback(t):
    kind = F.when(F.col("value") >= 50, "Yes").when(F.col("value") >= 10, "No").otherwise("none")
    return t("events").where("event_type = 'purchase'").select("event_id", (F.col("event_id") - F.col("event_id") % 5).alias("id"), kind.alias("helpful"), F.col("event_id").alias("line"))


@query("t4_parsed_lines", f"{TURNS} SELECT true AS ok, id, route, top FROM sig WHERE id % 10 <> 0 UNION ALL SELECT false, NULL, NULL, NULL FROM sig WHERE id % 10 = 0")
def t4(t):
    good = signal.encoded(signal.turn_signals(turns(t)))
    marked = signal.turn_signals(turns(t)).select(F.col("id"), F.concat(F.lit("12:00 "), F.lit(signal.PREFIX), F.when(F.col("id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct("v", "kind", "id", "route", "top")))).alias("value"))
    assert good.columns == ["value"]
    return signal.parsed(marked).select("ok", "id", "route", "top")


@query("t5_feedback_join", f"{TURNS}, fb AS (SELECT event_id - event_id % 5 AS id, CASE WHEN value >= 50 THEN 'Yes' WHEN value >= 10 THEN 'No' ELSE 'none' END AS helpful, event_id AS line FROM events WHERE event_type = 'purchase'), l AS (SELECT id, arg_max(helpful, line) AS helpful FROM fb GROUP BY 1) SELECT id, route, coalesce(helpful, 'none') AS helpful FROM sig LEFT JOIN l USING (id)")
def t5(t):
    return signal.with_feedback(signal.turn_signals(turns(t)), feedback(t).select("id", "helpful", "line")).select("id", "route", "helpful")


@query("t6_hourly", f"{TURNS} SELECT date_trunc('hour', ts) AS start, route, count(*) AS n, CAST(sum(refused::INT) AS BIGINT) AS refused, CAST(sum(shown) AS BIGINT) AS shown FROM sig GROUP BY 1, 2")
def t6(t):
    return signal.hourly(signal.turn_signals(turns(t)))


@query("t6_summary", f"""{TURNS}, fb AS (SELECT event_id - event_id % 5 AS id, CASE WHEN value >= 50 THEN 'yes' WHEN value >= 10 THEN 'no' ELSE 'none' END AS helpful, event_id AS line FROM events WHERE event_type = 'purchase'), l AS (SELECT id, arg_max(helpful, line) AS helpful FROM fb GROUP BY 1)
SELECT route, count(*) AS n, count(*) FILTER (refused) AS refused, count(*) FILTER (top = 'low') AS low, count(*) FILTER (top = 'mid') AS mid, count(*) FILTER (top = 'high') AS high, count(*) FILTER (helpful = 'yes') AS yes, count(*) FILTER (helpful = 'no') AS no,
  count(*) FILTER (coalesce(helpful, 'none') = 'none') AS unanswered, count(*) FILTER (q IS NOT NULL) AS opted_in, round(avg(shown) FILTER (NOT refused), 6) AS mean_shown FROM sig LEFT JOIN l USING (id) GROUP BY 1""")
def t6s(t):
    joined = signal.with_feedback(signal.turn_signals(turns(t)), feedback(t).select("id", "helpful", "line"))
    return signal.summary(signal.facts(joined))


@query("t7_emit_once", f"{TURNS} SELECT DISTINCT id FROM sig")
def t7(t):
    s = signal.turn_signals(turns(t))
    return signal.once(s.unionByName(s)).select("id")


@query("t8_counters", f"{TURNS} SELECT route, round(max(score), 6) AS top, CAST(sum(shown) AS BIGINT) AS shown, CAST(sum(share::INT) AS BIGINT) AS shared FROM turns GROUP BY 1")
def t8(t):
    return turns(t).groupBy("route").agg(F.round(F.max("score"), 6).alias("top"), F.sum("shown").alias("shown"), F.sum(F.col("share").cast("long")).alias("shared"))
