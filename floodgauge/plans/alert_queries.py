"""Queries of the alert rules as declared, over counters with resets, and of what becomes of the alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgauge.operators import alert_routing
from floodgauge.operators.alert_rules import fired, increases
from floodgauge.operators.alerts import RULES, STEP_SECONDS
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.views import flows, pick, with_views

METRICS = ("threats_detected_total", "false_positives_total", "bgp_announcements_failed_total", "up:ml-processor", "up:bgp-controller", "kafka_consumer_lag_max")

_FIRED = """
readings AS (
  SELECT flow_id, epoch_us(ts) // 200 AS moment, concat('node-', user_id % 2) AS instance,
    CASE k % 6 WHEN 0 THEN 'threats_detected_total' WHEN 1 THEN 'false_positives_total' WHEN 2 THEN 'bgp_announcements_failed_total'
      WHEN 3 THEN 'up:ml-processor' WHEN 4 THEN 'up:bgp-controller' ELSE 'kafka_consumer_lag_max' END AS metric,
    CASE k % 6 WHEN 0 THEN bytes // 10 WHEN 1 THEN bytes // 60 WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN k % 5 ELSE 0 END
      WHEN 3 THEN CASE WHEN bytes > 4000 THEN 1 ELSE 0 END WHEN 4 THEN CASE WHEN bytes > 3000 THEN 1 ELSE 0 END ELSE bytes // 4 END AS value
  FROM flows),
linked AS (SELECT *, lag(value) OVER (PARTITION BY metric, instance ORDER BY moment, flow_id) AS before FROM readings),
grown AS (
  SELECT metric, instance, moment // 60000000 AS b, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) AS v,
    arg_max(value, moment * 1000 + flow_id % 1000) AS last
  FROM linked GROUP BY ALL),
ranged AS (
  SELECT metric, instance, step, sum(CASE WHEN step <= b + 5 THEN v END) AS v5, sum(v) AS v10
  FROM (SELECT *, unnest(generate_series(b + 1, b + 10)) AS step FROM grown) x GROUP BY ALL),
breach AS (
  SELECT 'HighThreatDetectionRate' AS alertname, 'warning' AS severity, 120 AS hold, instance, step, v5 / 300 AS value
  FROM ranged WHERE metric = 'threats_detected_total' AND v5 / 300 > 10
  UNION ALL SELECT 'BGPAnnouncementsFailed', 'critical', 60, instance, step, v5 / 300 FROM ranged WHERE metric = 'bgp_announcements_failed_total' AND v5 > 0
  UNION ALL SELECT 'HighFalsePositiveRate', 'warning', 300, f.instance, f.step, f.v10 / t.v10 FROM ranged f JOIN ranged t
    ON t.instance = f.instance AND t.step = f.step AND t.metric = 'threats_detected_total' AND t.v10 > 0
    WHERE f.metric = 'false_positives_total' AND f.v10 / t.v10 > 0.1e0
  UNION ALL SELECT CASE metric WHEN 'up:ml-processor' THEN 'MLProcessorDown' ELSE 'BGPControllerDown' END, 'critical', 60, instance, b + 1, last
    FROM grown WHERE metric IN ('up:ml-processor', 'up:bgp-controller') AND last < 1
  UNION ALL SELECT 'KafkaConsumerLag', 'warning', 120, instance, b + 1, last FROM grown WHERE metric = 'kafka_consumer_lag_max' AND last > 1000),
islands AS (
  SELECT alertname, severity, hold, instance, min(step) AS f, max(step) AS t, max(value) AS peak_value
  FROM (SELECT *, step - row_number() OVER (PARTITION BY alertname, instance ORDER BY step) AS i FROM breach) x GROUP BY alertname, severity, hold, instance, i),
fired AS (
  SELECT alertname, severity, instance, f * 60 AS pending_since, f * 60 + hold AS firing_since, t * 60 AS last_seen, peak_value
  FROM islands WHERE (t - f) * 60 >= hold),
lasting AS (SELECT alertname, severity, instance, firing_since AS since, last_seen + 60 AS until FROM fired)"""


def readings(spark, folder):
    """Six metrics of two nodes, read every few seconds: counters that are reset again and again, states and a gauge."""
    f, k = flows(spark, folder), F.col("k")
    b = F.col("bytes")
    value = (
        F.when(k % 6 == 0, F.floor(b / 10)).when(k % 6 == 1, F.floor(b / 60)).when(k % 6 == 2, F.when(F.col("user_id") % 3 == 0, k % 5).otherwise(0))
        .when(k % 6 == 3, (b > 4000).cast("long")).when(k % 6 == 4, (b > 3000).cast("long")).otherwise(F.floor(b / 4))
    )
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 200).cast("long")
    return f.select("flow_id", F.timestamp_micros(at).alias("ts"), F.concat(F.lit("node-"), F.col("user_id") % 2).alias("instance"), pick(k, *METRICS).alias("metric"), value.cast("double").alias("value"))


def _declared(spark, folder):
    return fired(increases(readings(spark, folder), tie=("flow_id",)), RULES, tie=("flow_id",))


def _lasting(spark, folder):
    return _declared(spark, folder).select("alertname", "severity", "instance", F.col("firing_since").alias("since"), (F.col("last_seen") + STEP_SECONDS).alias("until"))


@query("declared_alerts", with_views(("flows",), """
SELECT alertname, severity, instance, CAST(pending_since AS BIGINT) AS pending_since, CAST(firing_since AS BIGINT) AS firing_since,
  CAST(last_seen AS BIGINT) AS last_seen, round(peak_value, 6) AS peak_value FROM fired""", _FIRED))
def declared_alerts(spark, folder):
    """The six rules as they are declared, in one pass over counters that are reset."""
    return tidy(_declared(spark, folder))


@query("audible_alerts", with_views(("flows",), """
SELECT alertname, severity, instance, CAST(since AS BIGINT) AS since, CAST(until AS BIGINT) AS until FROM lasting WHERE severity <> 'warning'
UNION ALL
SELECT alertname, severity, instance, CAST(min(moment) AS BIGINT), CAST(max(moment) + 60 AS BIGINT) FROM (
  SELECT *, moment - 60 * row_number() OVER (PARTITION BY alertname, instance, whole ORDER BY moment) AS i FROM (
    SELECT alertname, severity, instance, since AS whole, unnest(generate_series(since, until - 60, 60)) AS moment FROM lasting WHERE severity = 'warning') steps
  WHERE NOT EXISTS (SELECT 1 FROM lasting c WHERE c.severity = 'critical' AND c.instance = steps.instance AND c.since <= steps.moment AND steps.moment < c.until)) x
GROUP BY alertname, severity, instance, whole, i""", _FIRED))
def audible_alerts(spark, folder):
    """Warnings while no critical alert of the same node fires; the label ``dev`` is missing everywhere."""
    rows = _lasting(spark, folder).withColumn("dev", F.lit(None).cast("string"))
    return tidy(alert_routing.audible(rows, equal=("dev", "instance"), bucket_seconds=3600).drop("dev"))


_SENT = """,
marks AS (SELECT alertname, moment, sum(d) AS d FROM (SELECT alertname, since AS moment, 1 AS d FROM lasting UNION ALL SELECT alertname, until, -1 FROM lasting) x GROUP BY ALL),
counted AS (SELECT *, sum(d) OVER (PARTITION BY alertname ORDER BY moment) AS n FROM marks),
lives AS (SELECT *, max(CASE WHEN n - d = 0 THEN moment END) OVER (PARTITION BY alertname ORDER BY moment) AS opened FROM counted),
looks AS (SELECT alertname, opened, greatest(0, ((moment - opened - {wait}) + {interval} - 1) // {interval}) AS look, arg_max(n, moment) AS n FROM lives GROUP BY ALL),
steps AS (SELECT *, lead(look) OVER w AS following, row_number() OVER w AS r FROM looks WINDOW w AS (PARTITION BY alertname, opened ORDER BY look)),
due AS (
  SELECT alertname, opened, look, CASE WHEN n = 0 THEN 'resolved' WHEN r = 1 THEN 'first' ELSE 'change' END AS reason, n FROM steps WHERE NOT (r = 1 AND n = 0)
  UNION ALL SELECT alertname, opened, x, 'repeat', n FROM (SELECT *, unnest(generate_series(look + {every}, following - 1, {every})) AS x FROM steps WHERE n > 0) y)"""


def _schedule_sql(wait: int, interval: int, repeat: int) -> str:
    return with_views(("flows",), f"""
SELECT alertname, CAST(opened AS BIGINT) AS opened, CAST(opened + {wait} + look * {interval} AS BIGINT) AS due, reason, CAST(n AS BIGINT) AS n_firing FROM due
""", _FIRED + _SENT.format(wait=wait, interval=interval, every=-(-repeat // interval)))


#: Waiting times: as declared, and two others that make the group wait longer and repeat sooner.
SCHEDULES = {"declared": (alert_routing.GROUP_WAIT, alert_routing.GROUP_INTERVAL, alert_routing.REPEAT_INTERVAL), "slow": (30, 300, 3600), "eager": (0, 60, 240)}


def _schedule(name: str, times: tuple[int, int, int]):
    @query(f"alert_schedule_{name}", _schedule_sql(*times))
    def run(spark, folder):
        return tidy(alert_routing.notifications(_lasting(spark, folder), ("alertname",), *times))

    return run


for _name, _times in SCHEDULES.items():
    _schedule(_name, _times)
