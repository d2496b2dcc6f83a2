"""Queries of the live path: decode, features, windows, detection, reputation, mitigation, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgauge.operators import alerts, detection, features, latency, metrics, mitigation, reputation, windows
from floodgauge.operators.ordered import chunk_for
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.views import datagrams, flows, ids_lines, samples, table, threats, with_views
from floodgauge.schemas import THREAT
from floodgauge.sources import ids_log, messages, netflow


def _window_sql(seconds: int) -> str:
    return with_views(("flows",), f"""
SELECT CAST(floor(epoch_us(ts) / {seconds}000000) AS BIGINT) AS window_key,
  CAST(floor(epoch_us(ts) / {seconds}000000) AS BIGINT) * {seconds}000000 AS start_time,
  (CAST(floor(epoch_us(ts) / {seconds}000000) AS BIGINT) + 1) * {seconds}000000 AS end_time,
  count(*) AS flow_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(packets) AS BIGINT) AS total_packets,
  count(*) AS total_flows, round(sum(bytes) / count(*), 6) AS avg_bytes_per_flow,
  round(sum(packets) / count(*), 6) AS avg_packets_per_flow,
  round(sum(bytes) / {seconds}, 6) AS bytes_per_second, round(sum(packets) / {seconds}, 6) AS packets_per_second,
  round(count(*) / {seconds}, 6) AS flows_per_second,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT dst_port) AS unique_dst_ports,
  count(*) FILTER (tcp_flags & 2 <> 0) AS syn_flag_count, count(*) FILTER (tcp_flags & 16 <> 0) AS ack_flag_count,
  count(*) FILTER (tcp_flags & 1 <> 0) AS fin_flag_count, count(*) FILTER (tcp_flags & 4 <> 0) AS rst_flag_count,
  count(*) FILTER (protocol = 6) AS tcp_flows, count(*) FILTER (protocol = 17) AS udp_flows,
  count(*) FILTER (protocol = 1) AS icmp_flows, count(*) FILTER (dst_port = 80) AS port_80_flows,
  count(*) FILTER (dst_port = 443) AS port_443_flows, count(*) FILTER (dst_port = 53) AS port_53_flows,
  count(*) FILTER (dst_port > 1024) AS high_port_flows,
  round(stddev_pop(bytes), 6) AS bytes_std, round(stddev_pop(packets), 6) AS packets_std,
  round(coalesce(avg(CASE WHEN duration > 0 THEN duration END), 0) + 1e-9, 6) AS duration_mean,
  round(coalesce(stddev_pop(CASE WHEN duration > 0 THEN duration END), 0) + 1e-9, 6) AS duration_std
FROM flows GROUP BY ALL""")


def _windows(spark, folder, seconds):
    found = windows.window_features(flows(spark, folder), window_seconds=seconds)
    # Both engines add in their own order; the offset keeps values on a rounding border together.
    return tidy(found.withColumns({c: F.col(c) + 1e-9 for c in ("duration_mean", "duration_std")}))


@query("window_features_5s", _window_sql(5))
def window_features_5s(spark, folder):
    return _windows(spark, folder, 5)


@query("window_features_1h", _window_sql(3600))
def window_features_1h(spark, folder):
    return _windows(spark, folder, 3600)


#: Five standard errors of a sketch; estimates of a few values may be one off.
WITHIN = 0.04
_COUNTED = ("src_ips", "dst_ips", "src_ports", "dst_ports")


def _near(estimate, exact):
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), WITHIN * exact)


@query("window_features_approx", with_views(("flows",), f"""
SELECT epoch_us(ts) // 3600000000 AS window_key, count(*) AS total_flows, CAST(sum(bytes) AS BIGINT) AS total_bytes, round(stddev_pop(bytes), 4) AS bytes_std,
  {", ".join(f"count(DISTINCT {c[:-1]}) AS {c}, CAST(1 AS BIGINT) AS {c}_near" for c in _COUNTED)}
FROM flows GROUP BY 1"""))
def window_features_approx(spark, folder):
    """Window features with estimated distinct counts, and whether each estimate is within its error bound of the exact count."""
    rows = flows(spark, folder)
    found = windows.window_features(rows, window_seconds=3600, distinct="approx")
    exact = windows.window_features_by_value(rows, window_seconds=3600).select("window_key", *[F.col(f"unique_{c}").alias(c) for c in _COUNTED])
    near = [_near(F.col(f"unique_{c}"), F.col(c)).alias(f"{c}_near") for c in _COUNTED]
    return tidy(found.join(exact, "window_key").select("window_key", "total_flows", "total_bytes", "bytes_std", *_COUNTED, *near), 4)


@query("sliding_window_features", with_views(("flows",), """
SELECT s * 3600000000 AS start_time, count(*) AS total_flows, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(packets) AS BIGINT) AS total_packets,
  round(count(*) / 86400, 4) AS flows_per_second, count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT dst_port) AS unique_dst_ports,
  count(*) FILTER (tcp_flags & 2 <> 0) AS syn_flag_count, count(*) FILTER (protocol = 17) AS udp_flows, count(*) FILTER (dst_port = 443) AS port_443_flows,
  round(stddev_pop(bytes), 4) AS bytes_std, round(stddev_pop(packets), 4) AS packets_std,
  round(coalesce(avg(CASE WHEN duration > 0 THEN duration END), 0) + 1e-9, 4) AS duration_mean,
  round(coalesce(stddev_pop(CASE WHEN duration > 0 THEN duration END), 0) + 1e-9, 4) AS duration_std,
  count(DISTINCT src_ip) AS src_ips, count(DISTINCT dst_ip) AS dst_ips, CAST(1 AS BIGINT) AS src_ips_near, CAST(1 AS BIGINT) AS dst_ips_near
FROM (SELECT *, epoch_us(ts) // 3600000000 AS h FROM flows) f, LATERAL (SELECT unnest(range(h - 23, h + 1)) AS s) w GROUP BY 1"""))
def sliding_window_features(spark, folder):
    """Features of each day that starts at a full hour, from summaries of hours; estimated numbers of addresses against exact ones."""
    rows = flows(spark, folder)
    found = windows.windows_from_steps(windows.step_summaries(rows, 3600), 3600, 86400, 3600)
    exact = windows.distinct_in_windows(rows, ["src_ip", "dst_ip"], 3600, 86400).withColumnsRenamed({"src_ip": "src_ips", "dst_ip": "dst_ips"})
    names = ["total_flows", "total_bytes", "total_packets", "flows_per_second", "unique_src_ports", "unique_dst_ports", "syn_flag_count", "udp_flows", "port_443_flows",
             "bytes_std", "packets_std", "duration_mean", "duration_std"]
    near = [_near(F.col(f"unique_{c}"), F.col(c)).alias(f"{c}_near") for c in _COUNTED[:2]]
    joined = found.join(exact, "start_time", "left").fillna(0, ["src_ips", "dst_ips"])
    # Means of few durations lie on rounding borders: see _windows.
    joined = joined.withColumns({c: F.col(c) + 1e-9 for c in ("duration_mean", "duration_std")})
    return tidy(joined.select("start_time", *names, "src_ips", "dst_ips", *near), 4)


@query("recent_windows", with_views(("flows",), """
SELECT CAST(floor(epoch_us(ts) / 5000000) AS BIGINT) AS window_key, count(*) AS flow_count,
  CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM flows GROUP BY 1 ORDER BY 1 DESC LIMIT 10"""))
def recent_windows(spark, folder):
    found = windows.window_features(flows(spark, folder))
    return tidy(windows.recent_windows(found.select("window_key", "flow_count", "total_bytes"), 10))


@query("window_status", with_views(("flows",), """
SELECT count(*) FILTER ((k + 1) * 5000000 > m - 10000000) AS active_windows,
  count(*) FILTER ((k + 1) * 5000000 <= m - 10000000) AS completed_windows, CAST(5 AS BIGINT) AS window_size_seconds
FROM (SELECT DISTINCT CAST(floor(epoch_us(ts) / 5000000) AS BIGINT) AS k FROM flows) w,
  (SELECT max(epoch_us(ts)) AS m FROM flows) x"""))
def window_status(spark, folder):
    return tidy(windows.window_status(flows(spark, folder)))


@query("netflow_decode", with_views(("flows",), """
SELECT g.datagram_id, rn - 1 AS record_index, secs * 1000000 AS timestamp, 'netflow' AS source, 'flow' AS event_type,
  src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port,
  CAST(protocol AS BIGINT) AS protocol, packets, bytes,
  round(greatest(1.0e0, floor(duration * 1000) / 1000), 6) AS duration,
  CAST(tcp_flags AS BIGINT) AS tcp_flags, '192.0.2.1' AS next_hop, user_id AS src_as, CAST(65000 AS BIGINT) AS dst_as
FROM (SELECT *, flow_id // 30 AS datagram_id, row_number() OVER (PARTITION BY flow_id // 30 ORDER BY flow_id) AS rn,
    count(*) OVER (PARTITION BY flow_id // 30) AS n FROM flows) g
JOIN (SELECT flow_id // 30 AS datagram_id, max(epoch_us(ts)) // 1000000 AS secs FROM flows GROUP BY 1) h
  ON g.datagram_id = h.datagram_id
WHERE g.datagram_id % 11 <> 10 AND NOT (g.datagram_id % 13 = 12 AND rn = n)"""))
def netflow_decode(spark, folder):
    records = netflow.decode_datagrams(datagrams(spark, folder))
    logs = netflow.normalize_records(records, keep=("datagram_id", "record_index"))
    return tidy(logs.select(
        "datagram_id", "record_index", "timestamp", "source", "event_type", "src_ip", "dst_ip", "src_port", "dst_port",
        "protocol", "packets", "bytes", "duration", "tcp_flags", "next_hop", "src_as", "dst_as"))


_IDS = """
ids AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN 'alert' WHEN k % 4 = 3 THEN 'dns' ELSE 'flow' END AS kind,
    floor(duration) AS age FROM flows WHERE flow_id % 97 <> 0 AND flow_id % 89 <> 0)"""


@query("ids_normalize", with_views(("flows",), """
SELECT epoch_us(ts) AS timestamp, 'suricata' AS source, kind AS event_type, src_ip, dst_ip,
  CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol,
  CASE WHEN kind = 'flow' THEN 2 * packets + 1 ELSE 0 END AS packets,
  CASE WHEN kind = 'flow' THEN 3 * bytes ELSE 0 END AS bytes,
  round(CASE WHEN kind = 'flow' THEN age ELSE 0 END, 6) AS duration,
  CASE WHEN kind = 'alert' THEN concat('SIG ', k) END AS alert_signature,
  CASE WHEN kind = 'alert' THEN CASE k % 3 WHEN 0 THEN 'Attempted DoS' WHEN 1 THEN 'Misc activity' ELSE 'Scan' END
    END AS alert_category,
  CASE WHEN kind = 'alert' THEN CAST(k % 3 + 1 AS BIGINT) END AS alert_severity,
  CASE WHEN kind = 'flow' THEN bytes END AS bytes_toserver, CASE WHEN kind = 'flow' THEN 'closed' END AS flow_state
FROM ids WHERE kind <> 'dns'""", _IDS))
def ids_normalize(spark, folder):
    parsed = ids_log.parse_lines(ids_lines(spark, folder).select("value"))
    logs = ids_log.normalize_events(ids_log.valid_events(parsed))
    return tidy(logs.select(
        "timestamp", "source", "event_type", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets",
        "bytes", "duration", "alert_signature", "alert_category", "alert_severity", "bytes_toserver", "flow_state"))


@query("ids_quarantine", """
SELECT concat('{"event_type": "flow", ', event_id) AS line FROM events WHERE event_id % 97 <> 0 AND event_id % 89 = 0""")
def ids_quarantine(spark, folder):
    return ids_log.quarantine(ids_log.parse_lines(ids_lines(spark, folder).select("value")))


@query("ids_features", with_views(("flows",), """
SELECT flow_id, CAST(CASE WHEN kind = 'alert' THEN k % 3 + 1 ELSE 0 END AS BIGINT) AS alert_severity,
  CAST(concat('0x', substr(md5(CASE WHEN kind <> 'alert' THEN '' WHEN k % 3 = 0 THEN 'Attempted DoS'
    WHEN k % 3 = 1 THEN 'Misc activity' ELSE 'Scan' END), 1, 8)) AS BIGINT) % 1000 AS alert_category,
  CASE WHEN kind = 'flow' THEN bytes * 2 ELSE 0 END AS flow_bytes_toclient,
  CASE WHEN kind = 'flow' THEN bytes ELSE 0 END AS flow_bytes_toserver,
  CASE WHEN kind = 'flow' THEN packets + 1 ELSE 0 END AS flow_pkts_toclient,
  CASE WHEN kind = 'flow' THEN packets ELSE 0 END AS flow_pkts_toserver,
  CAST(concat('0x', substr(md5(CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END), 1, 8)) AS BIGINT)
    % 100 AS proto,
  CAST(concat('0x', substr(md5(''), 1, 8)) AS BIGINT) % 100 AS app_proto
FROM ids""", _IDS))
def ids_features(spark, folder):
    events = ids_log.valid_events(ids_log.parse_lines(ids_lines(spark, folder)))
    return tidy(features.ids_features(events, keep=("flow_id",)))


@query("flow_features", with_views(("flows",), """
SELECT flow_id, round(bytes / greatest(duration, 1), 6) AS bytes_per_second,
  round(packets / greatest(duration, 1), 6) AS packets_per_second,
  round(bytes / greatest(packets, 1), 6) AS avg_packet_size, CAST(protocol AS BIGINT) AS protocol,
  CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(tcp_flags AS BIGINT) AS tcp_flags,
  CAST(tcp_flags & 2 <> 0 AS BIGINT) AS syn_flag, CAST(tcp_flags & 16 <> 0 AS BIGINT) AS ack_flag,
  CAST(tcp_flags & 1 <> 0 AS BIGINT) AS fin_flag, CAST(tcp_flags & 4 <> 0 AS BIGINT) AS rst_flag,
  round(duration, 6) AS flow_duration, 0.0e0 AS inter_arrival_time
FROM flows"""))
def flow_features(spark, folder):
    return tidy(features.flow_features(flows(spark, folder), keep=("flow_id",)))


@query("route_by_type", with_views(("flows",), """
SELECT CASE WHEN kind = 'alert' THEN 'ids' ELSE 'flow' END AS route, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_total
FROM (SELECT k, CASE WHEN k % 4 = 0 THEN 'alert' ELSE 'flow' END AS kind FROM flows) x GROUP BY 1"""))
def route_by_type(spark, folder):
    typed = flows(spark, folder).withColumn("event_type", F.when(F.col("k") % 4 == 0, "alert").otherwise("flow"))
    alert_rows, other_rows = features.route_by_type(typed)
    both = alert_rows.withColumn("route", F.lit("ids")).unionByName(other_rows.withColumn("route", F.lit("flow")))
    return tidy(both.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_total")))


@query("message_roundtrip", with_views(("threats",), """
SELECT ip, round(score, 6) AS score, attack_type, round(score, 6) AS confidence, detection_method,
  epoch_us(ts) AS ts, CAST(ttl AS BIGINT) AS ttl FROM threats"""))
def message_roundtrip(spark, folder):
    sent = messages.encode(threats(spark, folder), key="ip")
    return tidy(messages.decode(sent, THREAT))


_SCORES = """
model_scores AS (
  SELECT flow_id, src_ip, ts, least(1.0e0, value / 150) AS p1, (k % 11) / 10.0e0 AS p2, (bytes % 1000) / 500.0e0 - 1.5e0
    AS decision FROM flows)"""


def _model_scores(spark, folder):
    return flows(spark, folder).select(
        "flow_id", "src_ip", "ts", F.least(F.lit(1.0), F.col("value") / 150).alias("p1"),
        ((F.col("k") % 11) / 10.0).alias("p2"), ((F.col("bytes") % 1000) / 500.0 - 1.5).alias("decision"),
    )


def _detect_sql(score: str, limit: str) -> str:
    return with_views(("flows",), f"""
SELECT flow_id, src_ip AS ip, round(CASE WHEN c > 0.7e0 THEN c ELSE a END, 6) AS score,
  CASE WHEN c > 0.7e0 THEN 'known_ddos' ELSE 'zero_day' END AS attack_type,
  round(CASE WHEN c > 0.7e0 THEN c ELSE a END, 6) AS confidence,
  CASE WHEN c > 0.7e0 THEN 'supervised' ELSE 'unsupervised' END AS detection_method,
  epoch_us(ts) AS ts, CAST(3600 AS BIGINT) AS ttl
FROM (SELECT *, {score} AS c, greatest(0, least(1, ({limit} - decision) / 2)) AS a FROM model_scores) x
WHERE c > 0.7e0 OR decision < {limit}""", _SCORES)


@query("detect_threats", _detect_sql("(p1 + p2) / 2", "-0.5e0"))
def detect_threats(spark, folder):
    return tidy(detection.detect(_model_scores(spark, folder), ["p1", "p2"], "decision", keep=("flow_id",)))


@query("detect_threats_weighted", _detect_sql("p1 * 0.7e0 + p2 * 0.3e0", "0.0e0"))
def detect_threats_weighted(spark, folder):
    return tidy(detection.detect(
        _model_scores(spark, folder), ["p1", "p2"], "decision", anomaly_threshold=0.0,
        weights=detection.ENSEMBLE_WEIGHTS, keep=("flow_id",)))


@query("threshold_prediction", with_views(("flows",), """
SELECT flow_id, CAST(coalesce(CASE WHEN k % 10 <> 0 THEN p1 >= 0.55e0 END, k % 2 = 1) AS BIGINT) AS predicted
FROM (SELECT flow_id, k, least(1.0e0, value / 150) AS p1 FROM flows) x"""))
def threshold_prediction(spark, folder):
    rows = flows(spark, folder).withColumn("p", F.when(F.col("k") % 10 != 0, F.least(F.lit(1.0), F.col("value") / 150)))
    return tidy(rows.select("flow_id", detection.predict(F.col("p"), 0.55, F.col("k") % 2 == 1).alias("predicted")))


# Row-by-row fold, one recursion step per threat of an address: the plain definition of the state.
_FOLD = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, flow_id) AS rn FROM threats),
fold AS (
  SELECT flow_id, ip, ts, rn, least(1.0e0, 0.3e0 * score) AS rep, CAST(1 AS BIGINT) AS validations
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.flow_id, o.ip, o.ts, o.rn,
    CASE WHEN epoch_us(o.ts) - epoch_us(f.ts) >= floor(3600 * (1 + round(f.rep, 9))) * 1000000
      THEN least(1.0e0, 0.3e0 * o.score) ELSE least(1.0e0, f.rep + 0.3e0 * o.score) END,
    CASE WHEN epoch_us(o.ts) - epoch_us(f.ts) >= floor(3600 * (1 + round(f.rep, 9))) * 1000000
      THEN 1 ELSE f.validations + 1 END
  FROM fold f JOIN ordered o ON o.ip = f.ip AND o.rn = f.rn + 1),
history AS (
  SELECT t.*, round(f.rep, 9) AS reputation_score, f.validations FROM threats t JOIN fold f ON f.flow_id = t.flow_id),
malicious AS (
  SELECT * FROM history WHERE (reputation_score > 0.7e0 AND validations >= 3) OR reputation_score > 0.9e0)"""

_PLAN = _FOLD + """,
announced AS (
  SELECT *, CASE WHEN score > 0.95e0 THEN 'blackhole' WHEN attack_type IN ('volumetric','amplification') THEN 'blackhole'
    ELSE 'flowspec' END AS route_type,
    CASE WHEN attack_type IN ('volumetric','amplification') OR score > 0.9e0 THEN 'discard'
      WHEN attack_type = 'application_layer' OR score > 0.7e0 THEN 'rate_limit_1mbps' ELSE 'rate_limit_10mbps' END AS act,
    lead(ts) OVER (PARTITION BY ip ORDER BY ts, flow_id) AS next_ts FROM malicious)"""


def _history(spark, folder):
    rows = threats(spark, folder)
    return reputation.reputation_history(rows, tie=("flow_id",), chunk_seconds=chunk_for(rows, "ts"))


@query("reputation_history", with_views(("threats",), """
SELECT flow_id, ip, epoch_us(ts) AS ts, round(reputation_score, 6) AS reputation_score, validations,
  CAST(floor(3600 * (1 + reputation_score)) AS BIGINT) AS reputation_ttl FROM history""", _FOLD, recursive=True))
def reputation_history(spark, folder):
    return tidy(_history(spark, folder).select(
        "flow_id", "ip", "ts", "reputation_score", "validations", "reputation_ttl"))


@query("reputation_state", with_views(("threats",), """
SELECT ip, round(reputation_score, 6) AS score, validations, epoch_us(ts) AS last_seen, attack_type, detection_method
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, flow_id DESC) AS r FROM history) x WHERE r = 1""",
    _FOLD, recursive=True))
def reputation_state(spark, folder):
    state = reputation.latest_state(_history(spark, folder), tie=("flow_id",))
    return tidy(state.select("ip", "score", "validations", "last_seen", F.col("attack_types")[0].alias("attack_type"),
                             F.col("detection_methods")[0].alias("detection_method")))


@query("block_decisions", with_views(("threats",), """
SELECT f.flow_id, f.ip, CAST(coalesce((s.rep > 0.7e0 AND s.validations >= 3) OR s.rep > 0.9e0, FALSE) AS BIGINT)
  AS should_block
FROM (SELECT flow_id, concat('203.0.113.', user_id % 7) AS ip FROM flows) f
LEFT JOIN (SELECT * FROM (SELECT ip, reputation_score AS rep, validations, ts,
      row_number() OVER (PARTITION BY ip ORDER BY ts DESC, flow_id DESC) AS r FROM history) x
    WHERE r = 1 AND (SELECT max(epoch_us(ts)) FROM threats) - epoch_us(ts) < floor(3600 * (1 + rep)) * 1000000) s
  ON s.ip = f.ip""", _FOLD, recursive=True))
def block_decisions(spark, folder):
    state = reputation.latest_state(_history(spark, folder), tie=("flow_id",))
    now = threats(spark, folder).agg(F.max("ts")).scalar()
    seen = flows(spark, folder).select("flow_id", F.concat(F.lit("203.0.113."), F.col("user_id") % 7).alias("ip"))
    return tidy(reputation.with_reputation(seen, state, now).select("flow_id", "ip", "should_block"))


@query("malicious_messages", with_views(("threats",), """
SELECT flow_id, ip, round(score, 6) AS threat_score, round(reputation_score, 6) AS reputation_score, attack_type,
  round(score, 6) AS confidence, detection_method, epoch_us(ts) AS timestamp, CAST(ttl AS BIGINT) AS ttl, validations
FROM malicious""", _FOLD, recursive=True))
def malicious_messages(spark, folder):
    return tidy(reputation.malicious_messages(_history(spark, folder)))


def _announced(spark, folder):
    return mitigation.announcements(reputation.malicious_messages(_history(spark, folder)), keep=("flow_id",))


@query("route_announcements", with_views(("threats",), """
SELECT flow_id, 'announce' AS action, ip, route_type, route_type AS strategy, attack_type,
  round(score, 6) AS threat_score, epoch_us(ts) AS timestamp, CAST(ttl AS BIGINT) AS ttl,
  CASE WHEN route_type = 'blackhole' THEN concat('announce route ', ip, '/32 next-hop 192.0.2.1 community [65000:666]')
  ELSE concat('flow route {', chr(10), '    match {', chr(10), '        source ', ip, '/32;', chr(10), '    }', chr(10),
    '    then {', chr(10), '        ', act, ';', chr(10), '        community ',
    CASE act WHEN 'discard' THEN '65000:666' WHEN 'rate_limit_1mbps' THEN '65000:1' ELSE '65000:10' END, ';', chr(10),
    '    }', chr(10), '}') END AS command
FROM announced""", _PLAN, recursive=True))
def route_announcements(spark, folder):
    return tidy(_announced(spark, folder).drop("reason"))


@query("route_withdrawals", with_views(("threats",), """
SELECT 'withdraw' AS action, ip, route_type, epoch_us(ts) + ttl * 1000000 AS timestamp, 'ttl_expired' AS reason,
  concat(CASE WHEN route_type = 'blackhole' THEN 'withdraw route ' ELSE 'withdraw flow route ' END, ip, '/32') AS command
FROM announced WHERE next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + ttl * 1000000""", _PLAN, recursive=True))
def route_withdrawals(spark, folder):
    gone = mitigation.withdrawals(_announced(spark, folder), tie=("flow_id",))
    return tidy(gone.select("action", "ip", "route_type", "timestamp", "reason", "command"))


@query("route_withdrawals_swept", with_views(("threats",), """
SELECT ip, route_type, ((epoch_us(ts) + ttl * 1000000) // 60000000 + 1) * 60000000 AS timestamp
FROM announced WHERE (next_ts IS NULL OR epoch_us(next_ts) > epoch_us(ts) + ttl * 1000000)
  AND (SELECT max(epoch_us(ts)) FROM threats) > epoch_us(ts) + ttl * 1000000""", _PLAN, recursive=True))
def route_withdrawals_swept(spark, folder):
    now = threats(spark, folder).agg(F.max("ts")).scalar()
    gone = mitigation.withdrawals(_announced(spark, folder), now=now, tie=("flow_id",), sweep_seconds=60)
    return tidy(gone.select("ip", "route_type", "timestamp"))


@query("active_routes", with_views(("threats",), """
SELECT ip, route_type, epoch_us(ts) AS timestamp, '192.0.2.1' AS next_hop, '65000:666' AS community,
  CAST(32 AS BIGINT) AS prefix_length
FROM announced WHERE next_ts IS NULL AND ip NOT LIKE '%.3'""", _PLAN, recursive=True))
def active_routes(spark, folder):
    last = mitigation.active_routes(_announced(spark, folder), tie=("flow_id",))
    removed = threats(spark, folder).filter(F.col("ip").endswith(".3"))
    kept = mitigation.routes(mitigation.remove_routes(last, removed))
    return tidy(kept.select("ip", "route_type", "timestamp", "next_hop", "community", "prefix_length"))


@query("mitigation_strategy", with_views(("threats",), """
SELECT attack_type, CASE WHEN score > 0.95e0 OR attack_type IN ('volumetric','amplification') THEN 'blackhole'
    ELSE 'flowspec' END AS strategy,
  CASE WHEN attack_type IN ('volumetric','amplification') OR score > 0.9e0 THEN 'discard'
    WHEN attack_type = 'application_layer' OR score > 0.7e0 THEN 'rate_limit_1mbps' ELSE 'rate_limit_10mbps' END AS act,
  count(*) AS n FROM threats GROUP BY ALL"""))
def mitigation_strategy(spark, folder):
    t = threats(spark, folder)
    return tidy(t.groupBy(
        "attack_type", mitigation.strategy(F.col("attack_type"), F.col("score")).alias("strategy"),
        mitigation.rule_action(F.col("attack_type"), F.col("score")).alias("act"),
    ).agg(F.count(F.lit(1)).alias("n")))


@query("hourly_counters", with_views(("threats",), """
SELECT epoch_us(ts) // 3600000000 * 3600 AS hour_start, count(*) AS threats,
  count(*) FILTER (score < 0.25e0) AS false_positives FROM threats GROUP BY 1"""))
def hourly_counters(spark, folder):
    return tidy(windows.hourly_counters(threats(spark, folder), "ts", F.col("score") < 0.25))


@query("trailing_throughput", """
SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n_events, round(count(*) / 3600, 6) AS per_second
FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 3600000000
GROUP BY ROLLUP (event_type)""")
def trailing_throughput(spark, folder):
    e = table(spark, folder, "events")
    now = e.agg(F.max("ts")).scalar()
    return tidy(windows.trailing_throughput(e, "ts", "event_type", now, 3600))


@query("sliding_throughput", """
SELECT event_type, w * 600 AS window_start, count(*) AS n_events, round(count(*) / 3600, 6) AS per_second
FROM (SELECT event_type, unnest(generate_series(epoch_us(ts) // 600000000 - 5, epoch_us(ts) // 600000000)) AS w FROM events) x
GROUP BY ALL""")
def sliding_throughput(spark, folder):
    return tidy(windows.sliding_throughput(table(spark, folder, "events"), "ts", "event_type", 3600, 600))


_LATENCY = """
pairs AS (
  SELECT user_id AS flow_id, ts, CASE WHEN event_type IN ('view','click') THEN 0 ELSE 1 END AS kind
  FROM events WHERE event_type IN ('view','click','purchase')),
linked AS (
  SELECT *, lag(ts) OVER w AS p_ts, lag(kind) OVER w AS p_kind FROM pairs
  WINDOW w AS (PARTITION BY flow_id ORDER BY ts, kind)),
latencies AS (
  SELECT flow_id, p_ts AS start_ts, ts AS end_ts, (epoch_us(ts) - epoch_us(p_ts)) / 1000000 AS latency
  FROM linked WHERE kind = 1 AND p_kind = 0)"""


def _latencies(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("user_id", "flow_id")
    return latency.flow_latencies(
        e.filter(F.col("event_type").isin("view", "click")), e.filter("event_type = 'purchase'"))


@query("flow_latencies", with_views((), """
SELECT flow_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(latency, 6) AS latency
FROM latencies""", _LATENCY))
def flow_latencies(spark, folder):
    return tidy(_latencies(spark, folder))


_LATENCY_STATS = """count(*) AS count, round(avg(latency), 4) AS mean, round(min(latency), 4) AS min,
  round(max(latency), 4) AS max, round(coalesce(stddev_samp(latency), 0), 4) AS std_dev,
  round(quantile_cont(latency, 0.5), 4) AS median, round(quantile_cont(latency, 0.95), 4) AS p95,
  round(quantile_cont(latency, 0.99), 4) AS p99"""


@query("latency_stats", with_views((), f"SELECT {_LATENCY_STATS} FROM latencies", _LATENCY))
def latency_stats(spark, folder):
    return tidy(metrics.latency_stats(_latencies(spark, folder)), 4)


def _tests(spark, folder):
    named = _latencies(spark, folder).withColumn("test_type", F.concat(F.lit("test-"), F.col("flow_id") % 4))
    return metrics.latency_stats(named, keys=["test_type"])


@query("latency_stats_by_test", with_views((), f"""
SELECT concat('test-', flow_id % 4) AS test_type, {_LATENCY_STATS} FROM latencies GROUP BY 1""", _LATENCY))
def latency_stats_by_test(spark, folder):
    return tidy(_tests(spark, folder), 4)


@query("performance_report", with_views((), """
SELECT count(DISTINCT test_type) AS total_tests, round(avg(v), 4) AS mean_of_means, round(min(v), 4) AS best_latency,
  round(max(v), 4) AS worst_latency, count(DISTINCT test_type) AS n_test_types
FROM (SELECT concat('test-', flow_id % 4) AS test_type, unnest([avg(latency), quantile_cont(latency, 0.95),
    quantile_cont(latency, 0.99)]) AS v FROM latencies GROUP BY 1) x""", _LATENCY))
def performance_report(spark, folder):
    return tidy(metrics.performance_report(_tests(spark, folder)), 4)


STEP = 3600
TEST_RULES = (
    alerts.Rule("HighThreatDetectionRate", "threats_detected_total", "rate", 0.0011, 3 * STEP, 2 * STEP, "warning"),
    alerts.Rule("HighFalsePositiveRate", "false_positives_total", "ratio", 0.5, 3 * STEP, 2 * STEP, "warning",
                "threats_detected_total"),
    alerts.Rule("MLProcessorDown", "up:ml-processor", "below", 1, STEP, STEP, "critical"),
    alerts.Rule("KafkaConsumerLag", "kafka_consumer_lag_max", "above", 1000, STEP, STEP, "warning"),
)

_ALERTS = """
b AS (SELECT metric, instance, epoch_us(ts) // 3600000000 AS b, ts, value FROM samples),
ranged AS (
  SELECT metric, instance, step, sum(value) AS v
  FROM (SELECT metric, instance, value, unnest(generate_series(b + 1, b + 3)) AS step FROM b) x GROUP BY ALL),
gauges AS (SELECT metric, instance, b + 1 AS step, arg_max(value, ts) AS v FROM b GROUP BY 1, 2, 3),
breach AS (
  SELECT 'HighThreatDetectionRate' AS alertname, 'warning' AS severity, instance, step, v / 10800 AS value
  FROM ranged WHERE metric = 'threats_detected_total' AND v / 10800 > 0.0011e0
  UNION ALL
  SELECT 'HighFalsePositiveRate', 'warning', f.instance, f.step, f.v / t.v FROM ranged f JOIN ranged t
    ON t.instance = f.instance AND t.step = f.step AND t.metric = 'threats_detected_total'
  WHERE f.metric = 'false_positives_total' AND f.v / t.v > 0.5e0
  UNION ALL
  SELECT 'MLProcessorDown', 'critical', instance, step, v FROM gauges WHERE metric = 'up:ml-processor' AND v < 1
  UNION ALL
  SELECT 'KafkaConsumerLag', 'warning', instance, step, v FROM gauges
  WHERE metric = 'kafka_consumer_lag_max' AND v > 1000),
islands AS (
  SELECT alertname, severity, instance, min(step) AS f, max(step) AS t, max(value) AS peak_value
  FROM (SELECT *, step - row_number() OVER (PARTITION BY alertname, instance ORDER BY step) AS i FROM breach) x
  GROUP BY alertname, severity, instance, i),
fired AS (
  SELECT alertname, severity, instance, f * 3600 AS pending_since, f * 3600 + h AS firing_since, t * 3600 AS last_seen,
    peak_value
  FROM (SELECT *, CASE WHEN alertname LIKE 'High%' THEN 7200 ELSE 3600 END AS h FROM islands) x
  WHERE (t - f) * 3600 >= h)"""


def _fired(spark, folder):
    rows = samples(spark, folder)
    out = None
    for rule in TEST_RULES:
        found = alerts.firing(rows, rule, STEP)
        out = found if out is None else out.unionByName(found)
    return out


@query("alert_rules", with_views(("samples",), """
SELECT alertname, severity, instance, CAST(pending_since AS BIGINT) AS pending_since,
  CAST(firing_since AS BIGINT) AS firing_since, CAST(last_seen AS BIGINT) AS last_seen,
  round(peak_value, 6) AS peak_value FROM fired""", _ALERTS))
def alert_rules(spark, folder):
    return tidy(_fired(spark, folder))


@query("alert_groups", with_views(("samples",), """
SELECT alertname, count(*) AS n_alerts, count(DISTINCT instance) AS n_instances, max(severity) AS worst_severity,
  CAST(min(firing_since) AS BIGINT) AS first_firing FROM fired GROUP BY 1""", _ALERTS))
def alert_groups(spark, folder):
    return tidy(alerts.group_alerts(_fired(spark, folder)))


@query("alert_inhibition", with_views(("samples",), """
SELECT alertname, severity, instance, CAST(firing_since AS BIGINT) AS firing_since FROM fired
WHERE severity = 'critical' OR instance NOT IN (SELECT instance FROM fired WHERE severity = 'critical'
  AND instance = 'node-1')""", _ALERTS))
def alert_inhibition(spark, folder):
    fired = _fired(spark, folder)
    # Only one instance has its critical alerts taken into account here, so both outcomes occur.
    shown = fired.withColumn("label", F.when(
        (F.col("severity") == "warning") | (F.col("instance") == "node-1"), F.col("instance")).otherwise("other"))
    kept = alerts.inhibit(shown, equal=("label",))
    return tidy(kept.select("alertname", "severity", "instance", "firing_since"))
