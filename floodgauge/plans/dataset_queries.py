"""Queries of dataset preparation: features, cleaning, integration, samples and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from floodgauge.operators import clean, features, integrate, sampling, stats
from floodgauge.operators.ordered import dense_codes
from floodgauge.plans.registry import query, tidy
from floodgauge.plans.views import FEATURES, FLOW_KEY, gapped, labelled, netflow_v3, table, with_views
from floodgauge.session import checkpointed
from floodgauge.sources import tables
from floodgauge.sources.export import describe_export

#: Tables of a dataset with their numbers of columns.
TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
REQUIRED = {"lineitem": ("l_quantity", "l_returnflag"), "events": ("ts", "payload"), "labels": ("doc_id", "quality")}


@query("dataset_contract", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS dataset, CAST(1 AS BIGINT) AS present, count(*) AS n_rows, CAST({w} AS BIGINT) AS n_columns, "
    f"'{'payload' if t == 'events' else ''}' AS missing_columns, CAST({int(t != 'events')} AS BIGINT) AS usable FROM {t}"
    for t, w in TABLES.items()
) + "\nUNION ALL SELECT 'absent', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'x', CAST(0 AS BIGINT)")
def dataset_contract(spark, folder):
    found = {t: tables.try_table(spark, f"{folder}/{t}.parquet") for t in (*TABLES, "absent")}
    return tidy(tables.contract_report(spark, found, {**REQUIRED, "absent": ("x",)}))


@query("first_available_source", "SELECT 'orders' AS dataset, count(*) AS n FROM orders")
def first_available_source(spark, folder):
    candidates = [(n, f"{folder}/{n}.parquet") for n in ("real", "advanced", "orders", "lineitem")]
    name, found = tables.first_available(spark, candidates)
    return tidy(found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "n"))


# --- NetFlow features ---------------------------------------------------------------------------

E = "1e-8::DOUBLE"


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / (CAST({b} AS DOUBLE) + {E}))"


def _select(columns: dict[str, str], digits: int = 4) -> str:
    return ", ".join(f"round({sql}, {digits}) AS {name}" for name, sql in columns.items())


def _ints(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in columns.items())


@query("temporal_features", with_views(("netflow",), "SELECT flow_key, " + _ints({
    "flow_start_hour": "FLOW_START_MILLISECONDS // 3600000 % 24",
    "flow_start_day_of_week": "FLOW_START_MILLISECONDS // 86400000 % 7",
    "burst_indicator": "SRC_TO_DST_IAT_MIN < 10 AND SRC_TO_DST_IAT_MAX > 1000",
}) + ", " + _select({
    "duration_ratio": _ratio("DURATION_OUT", "DURATION_IN"),
    "flow_efficiency": _ratio("FLOW_DURATION_MILLISECONDS", "IN_PKTS + OUT_PKTS"),
    "iat_variability": _ratio("SRC_TO_DST_IAT_STDDEV", "SRC_TO_DST_IAT_AVG"),
    "iat_asymmetry": _ratio("SRC_TO_DST_IAT_AVG", "DST_TO_SRC_IAT_AVG"),
}) + " FROM netflow"))
def temporal_features(spark, folder):
    return tidy(features.temporal_features(netflow_v3(spark, folder)).select(
        "flow_key", "flow_start_hour", "flow_start_day_of_week", "burst_indicator", "duration_ratio",
        "flow_efficiency", "iat_variability", "iat_asymmetry"), 4)


_SIZED = ("NUM_PKTS_UP_TO_128_BYTES + NUM_PKTS_128_TO_256_BYTES + NUM_PKTS_256_TO_512_BYTES"
          " + NUM_PKTS_512_TO_1024_BYTES + NUM_PKTS_1024_TO_1514_BYTES")
_TRAFFIC = {
    "bytes_ratio": _ratio("OUT_BYTES", "IN_BYTES"),
    "bytes_per_packet_in": _ratio("IN_BYTES", "IN_PKTS"),
    "bytes_per_packet_out": _ratio("OUT_BYTES", "OUT_PKTS"),
    "bytes_asymmetry": _ratio("abs(IN_BYTES - OUT_BYTES)", "IN_BYTES + OUT_BYTES"),
    "throughput_ratio": _ratio("DST_TO_SRC_AVG_THROUGHPUT", "SRC_TO_DST_AVG_THROUGHPUT"),
    "throughput_stability": _ratio("SRC_TO_DST_AVG_THROUGHPUT", "SRC_TO_DST_SECOND_BYTES"),
    "small_packets_ratio": _ratio("NUM_PKTS_UP_TO_128_BYTES", _SIZED),
    "large_packets_ratio": _ratio("NUM_PKTS_1024_TO_1514_BYTES", _SIZED),
    "packet_size_diversity": _ratio("MAX_IP_PKT_LEN - MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN"),
    "retrans_ratio": _ratio("RETRANSMITTED_IN_BYTES + RETRANSMITTED_OUT_BYTES", "IN_BYTES + OUT_BYTES"),
    "retrans_efficiency": _ratio("RETRANSMITTED_IN_PKTS", "RETRANSMITTED_IN_BYTES"),
}


@query("traffic_features", with_views(("netflow",), f"SELECT flow_key, {_select(_TRAFFIC)} FROM netflow"))
def traffic_features(spark, folder):
    return tidy(features.traffic_features(netflow_v3(spark, folder)).select("flow_key", *_TRAFFIC), 4)


@query("protocol_features", with_views(("netflow",), "SELECT flow_key, " + _ints({
    "tcp_flag_diversity": "bit_count(TCP_FLAGS)", "is_tcp": "PROTOCOL = 6", "is_udp": "PROTOCOL = 17",
    "is_icmp": "PROTOCOL = 1", "has_dns": "DNS_QUERY_ID > 0", "has_ftp": "FTP_COMMAND_RET_CODE > 0",
}) + ", " + _select({"tcp_window_efficiency": _ratio("TCP_WIN_MAX_OUT", "TCP_WIN_MAX_IN")}) + " FROM netflow"))
def protocol_features(spark, folder):
    return tidy(features.protocol_features(netflow_v3(spark, folder)).select(
        "flow_key", "tcp_flag_diversity", "is_tcp", "is_udp", "is_icmp", "has_dns", "has_ftp",
        "tcp_window_efficiency"), 4)


_Z = {c: f"abs(({c} - m_{c}) / (s_{c} + {E}))" for c in features.ZSCORE_COLUMNS}


@query("anomaly_features", with_views(("netflow",), "SELECT flow_key, " + _select(
    {f"{c}_zscore": z for c, z in _Z.items()}) + ", " + _ints({
        **{f"{c}_is_outlier": f"{z} > 3" for c, z in _Z.items()},
        "suspicious_port": "L4_SRC_PORT < 1024 OR L4_DST_PORT < 1024",
        "high_throughput": "SRC_TO_DST_AVG_THROUGHPUT > q95",
        "unusual_packet_size": "MIN_IP_PKT_LEN < 40 OR MAX_IP_PKT_LEN > 1500",
    }) + " FROM netflow, (SELECT quantile_cont(SRC_TO_DST_AVG_THROUGHPUT, 0.95) AS q95, " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in features.ZSCORE_COLUMNS) + " FROM netflow) st"))
def anomaly_features(spark, folder):
    names = [f"{c}_{k}" for c in features.ZSCORE_COLUMNS for k in ("zscore", "is_outlier")]
    out = features.anomaly_features(netflow_v3(spark, folder))
    return tidy(out.select("flow_key", *names, "suspicious_port", "high_throughput", "unusual_packet_size"), 4)


# --- labels, columns, missing values ----------------------------------------------------------------


@query("attack_flags", """
SELECT p, CAST(CASE WHEN p IN ('Benign','BENIGN') THEN 0 ELSE 1 END AS BIGINT) AS mapped,
  CAST(upper(p) <> 'BENIGN' AS BIGINT) AS upper_case,
  CAST(p NOT IN ('BENIGN','Normal','normal','NORMAL') AS BIGINT) AS normal,
  CAST(p NOT IN ('BENIGN','Benign','benign','normal','Normal','NORMAL','0') AS BIGINT) AS any_spelling, count(*) AS n
FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'Benign' WHEN 2 THEN 'benign' WHEN 3 THEN 'Normal'
  WHEN 4 THEN '0' WHEN 5 THEN 'Syn' ELSE o_orderpriority END AS p FROM orders) x GROUP BY ALL""")
def attack_flags(spark, folder):
    key = F.col("o_orderkey") % 7
    name = reduce(lambda acc, i: F.when(key == i[0], i[1]).otherwise(acc),
                  enumerate(("BENIGN", "Benign", "benign", "Normal", "0", "Syn")), F.col("o_orderpriority"))
    rows = table(spark, folder, "orders").select(name.alias("p"))
    flags = {"mapped": "mapped", "upper_case": "upper", "normal": "normal", "any_spelling": "any"}
    return tidy(rows.groupBy("p", *[clean.attack_flag(F.col("p"), s).alias(n) for n, s in flags.items()]).agg(
        F.count(F.lit(1)).alias("n")))


@query("attack_flag_numeric", """
SELECT CAST(quality <> 0 AS BIGINT) AS is_attack, count(*) AS n FROM labels GROUP BY 1""")
def attack_flag_numeric(spark, folder):
    flag = clean.attack_flag(F.col("quality"), "normal", numeric=True)
    return tidy(table(spark, folder, "labels").groupBy(flag.alias("is_attack")).agg(F.count(F.lit(1)).alias("n")))


@query("label_lookup", """
SELECT coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, 'unknown') AS n_name, count(*) AS n
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def label_lookup(spark, folder):
    nation = table(spark, folder, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    named = clean.lookup(table(spark, folder, "customer"), nation, "c_nationkey", "n_name", "unknown")
    return tidy(named.groupBy("n_name").agg(F.count(F.lit(1)).alias("n")))


@query("numeric_projection", """
SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem""")
def numeric_projection(spark, folder):
    rows = table(spark, folder, "lineitem").withColumnsRenamed({"l_partkey": "Src Port", "l_suppkey": "Dst Port"})
    return tidy(clean.numeric_only(clean.drop_identifiers(rows)))


@query("missing_cells", with_views(("gapped", "finite"), """
SELECT CAST(count(*) - count(a) AS BIGINT) AS missing_a, count(*) - count(b) AS missing_b,
  count(*) - count(c) AS missing_c, count(*) - count(flag) AS missing_flag,
  4 * count(*) - count(a) - count(b) - count(c) - count(flag) AS missing_total FROM finite"""))
def missing_cells(spark, folder):
    cleaned = clean.infinite_to_null(gapped(spark, folder))
    return tidy(clean.missing_cells(cleaned, ["a", "b", "c", "flag"]))


_FILLED_SUMS = """round(sum(a), 2) AS a, round(sum(b), 2) AS b, round(sum(c), 2) AS c, count(*) AS n"""


@query("zero_filled", with_views(("gapped", "finite"), f"""
SELECT status, {_FILLED_SUMS} FROM (SELECT status, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c
  FROM finite) x GROUP BY 1"""))
def zero_filled(spark, folder):
    filled = clean.zero_fill(clean.infinite_to_null(gapped(spark, folder)), ["a", "b", "c"])
    return tidy(filled.groupBy("status").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")), 2)


@query("median_filled", with_views(("gapped", "finite"), f"""
SELECT status, {_FILLED_SUMS} FROM (
  SELECT status, coalesce(a, ma) AS a, coalesce(b, mb) AS b, coalesce(c, mc) AS c FROM finite,
    (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb, quantile_cont(c, 0.5) AS mc FROM finite) m) x
GROUP BY 1"""))
def median_filled(spark, folder):
    filled = clean.median_fill(clean.infinite_to_null(gapped(spark, folder)), ["a", "b", "c"])
    return tidy(filled.groupBy("status").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")), 2)


@query("numbers_from_text", with_views(("gapped",), """
SELECT text_number, round(coalesce(try_cast(text_number AS DOUBLE), 0), 6) AS number, count(*) AS n
FROM gapped GROUP BY ALL"""))
def numbers_from_text(spark, folder):
    rows = gapped(spark, folder).withColumn("number", F.col("text_number"))
    return tidy(clean.to_number(rows, ["number"]).groupBy("text_number", "number").agg(F.count(F.lit(1)).alias("n")))


@query("incomplete_rows_dropped", with_views(("gapped", "finite"), """
SELECT status, count(*) AS n, round(sum(a), 2) AS a FROM finite
WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND flag IS NOT NULL GROUP BY 1"""))
def incomplete_rows_dropped(spark, folder):
    kept = clean.drop_incomplete(clean.infinite_to_null(gapped(spark, folder)))
    return tidy(kept.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a")), 2)


@query("duplicates_dropped", """
SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""")
def duplicates_dropped(spark, folder):
    return tidy(clean.drop_duplicate_rows(table(spark, folder, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))


@query("duplicate_report", """
SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS removed
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax) x""")
def duplicate_report(spark, folder):
    return tidy(clean.duplicate_report(table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax")))


def _narrowest(c: str) -> str:
    fits = " ".join(f"WHEN min({c}) >= -{1 << b} AND max({c}) < {1 << b} THEN '{kind}'" for kind, b in (("tinyint", 7), ("smallint", 15), ("int", 31)))
    return f"CASE {fits} ELSE 'bigint' END"


_WHOLE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_REAL = ("l_quantity", "l_discount")


@query("narrowed_types", f"""
SELECT {", ".join(f"{_narrowest(c)} AS kind_{c}, CAST(sum({c}) AS BIGINT) AS {c}" for c in _WHOLE)},
  {", ".join(f"CASE WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float' ELSE 'double' END AS kind_{c}, round(sum({c}), 2) AS {c}" for c in _REAL)}
FROM lineitem""")
def narrowed_types(spark, folder):
    """The type of each column after narrowing, and the sum of what it holds then."""
    small = clean.narrow_types(table(spark, folder, "lineitem").select(*_WHOLE, *_REAL))
    kinds = [F.lit(kind).alias(f"kind_{c}") for c, kind in small.dtypes]
    return tidy(small.agg(*[F.sum(c).alias(c) for c in small.columns]).select("*", *kinds), 2)


@query("varying_columns", with_views(("gapped", "finite"), """
SELECT round(sum(a), 2) AS a, round(sum(b), 2) AS b, round(sum(c), 2) AS c FROM finite"""))
def varying_columns(spark, folder):
    kept = clean.drop_zero_variance(clean.infinite_to_null(gapped(spark, folder)).select("a", "b", "c", "d"))
    return tidy(kept.agg(*[F.sum(c).alias(c) for c in kept.columns]), 2)


@query("encoded_labels", """
SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def encoded_labels(spark, folder):
    coded = clean.encode_labels(table(spark, folder, "orders"), "o_orderpriority", "code")
    return tidy(coded.groupBy("o_orderpriority", "code").agg(F.count(F.lit(1)).alias("n")))


@query("encoded_names", """
SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS code FROM part""")
def encoded_names(spark, folder):
    return tidy(clean.encode_labels(table(spark, folder, "part"), "p_name", "code").select("p_partkey", "p_name", "code"))


@query("encoded_categories", with_views(("gapped",), """
SELECT flag, status, CAST(dense_rank() OVER (ORDER BY coalesce(flag, 'desconhecido')) - 1 AS BIGINT) AS flag_codificada,
  CAST(dense_rank() OVER (ORDER BY status) - 1 AS BIGINT) AS status_codificada, count(*) AS n
FROM gapped GROUP BY flag, status"""))
def encoded_categories(spark, folder):
    coded = clean.encode_categories(gapped(spark, folder), ["flag", "status", "text_number"])
    # The numbers kept as text have too many values at this scale to be coded, or are left out here.
    return tidy(coded.groupBy("flag", "status", "flag_codificada", "status_codificada").agg(F.count(F.lit(1)).alias("n")))


@query("clipped_columns", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(greatest(lo1, least(hi1, l_quantity)), 4) AS l_quantity,
  round(greatest(lo2, least(hi2, l_extendedprice)), 4) AS l_extendedprice
FROM lineitem, (SELECT quantile_cont(l_quantity, 0.01) AS lo1, quantile_cont(l_quantity, 0.99) AS hi1,
  quantile_cont(l_extendedprice, 0.01) AS lo2, quantile_cont(l_extendedprice, 0.99) AS hi2 FROM lineitem) q""")
def clipped_columns(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return tidy(clean.clip_per_column(rows, ["l_quantity", "l_extendedprice"]), 4)


@query("clipped_globally", """
SELECT l_orderkey, l_partkey, round(greatest(lo, least(hi, l_quantity)), 4) AS l_quantity,
  round(greatest(lo, least(hi, l_extendedprice)), 4) AS l_extendedprice, round(greatest(lo, least(hi, l_tax)), 4) AS l_tax
FROM lineitem, (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (
  SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem UNION ALL SELECT l_tax FROM lineitem) u) q""")
def clipped_globally(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return tidy(clean.clip_global(rows, ["l_quantity", "l_extendedprice", "l_tax"]), 4)


# --- several datasets ---------------------------------------------------------------------------


def _sources(spark, folder):
    rows = labelled(spark, folder)
    cic = rows.filter("source = 'cic'").select("l_tax", "l_quantity", "l_extendedprice", "is_attack")
    unsw = rows.filter("source = 'unsw'").select("l_quantity", "l_discount", "l_tax", "is_attack")
    return {"cic": cic, "unsw": unsw}


@query("integrated_by_name", with_views(("labelled",), """
SELECT source, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax, CAST(is_attack AS BIGINT) AS is_attack
FROM labelled"""))
def integrated_by_name(spark, folder):
    return tidy(integrate.integrate_by_name(_sources(spark, folder), "is_attack"))


@query("integrated_by_position", with_views(("labelled",), """
SELECT source, CASE source WHEN 'cic' THEN l_tax ELSE l_quantity END AS feature_0,
  CASE source WHEN 'cic' THEN l_quantity ELSE l_discount END AS feature_1, CAST(is_attack AS BIGINT) AS is_attack
FROM labelled"""))
def integrated_by_position(spark, folder):
    found = _sources(spark, folder)
    found["unsw"] = found["unsw"].drop("l_tax")
    return tidy(integrate.integrate_by_position(found, "is_attack"))


@query("prefixed_labels", with_views(("labelled",), """
SELECT concat(CASE source WHEN 'cic' THEN 'CIC_' ELSE 'UNSW_' END, label) AS label, source, count(*) AS n
FROM labelled GROUP BY ALL"""))
def prefixed_labels(spark, folder):
    rows = labelled(spark, folder).select("label", "source")
    parts = {s: rows.filter(F.col("source") == s).drop("source") for s in ("cic", "unsw")}
    return tidy(integrate.prefixed_labels(parts, "label").groupBy("label", "source").agg(F.count(F.lit(1)).alias("n")))


@query("integration_summary", with_views(("labelled",), """
SELECT coalesce('individual_' || source, 'combined') AS configuration, count(*) AS samples,
  CAST(sum(is_attack) AS BIGINT) AS attack_samples, CAST(count(*) - sum(is_attack) AS BIGINT) AS normal_samples,
  round(avg(is_attack), 6) AS attack_ratio FROM labelled GROUP BY ROLLUP (source)"""))
def integration_summary(spark, folder):
    return tidy(integrate.integration_summary(integrate.integrate_by_name(_sources(spark, folder), "is_attack"), "is_attack"))


@query("integration_configurations", with_views(("labelled",), """
SELECT c AS configuration, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM labelled, (SELECT unnest(['combined', 'ensemble_separate', 'individual_cic']) AS c) k
WHERE c <> 'individual_cic' OR source = 'cic' GROUP BY 1"""))
def integration_configurations(spark, folder):
    whole = integrate.integrate_by_name(_sources(spark, folder), "is_attack")
    parts = [
        integrate.configuration(whole, c).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")).select(
            F.lit(c).alias("configuration"), "n", "total")
        for c in ("combined", "ensemble_separate", "individual_cic")
    ]
    return tidy(reduce(lambda a, b: a.unionByName(b), parts), 2)


@query("class_distribution", with_views(("labelled",), """
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled), 6) AS share FROM labelled GROUP BY 1"""))
def class_distribution(spark, folder):
    return tidy(stats.class_distribution(labelled(spark, folder), "label"))


@query("balance_report", with_views(("labelled",), """
SELECT dataset, n, normal, attack, round(attack_ratio, 6) AS attack_ratio,
  CASE WHEN attack_ratio >= 1 THEN 'no_normal_samples' WHEN attack_ratio >= 0.95e0 THEN 'very_unbalanced'
    WHEN attack_ratio BETWEEN 0.3e0 AND 0.8e0 THEN 'well_balanced' ELSE 'questionable' END AS verdict
FROM (SELECT coalesce(source, 'total') AS dataset, count(*) AS n, CAST(sum(1 - is_attack) AS BIGINT) AS normal,
  CAST(sum(is_attack) AS BIGINT) AS attack, avg(is_attack) AS attack_ratio FROM labelled GROUP BY ROLLUP (source)) x"""))
def balance_report(spark, folder):
    return tidy(stats.balance_report(labelled(spark, folder), "source", "is_attack"))


@query("attack_types", with_views(("labelled",), """
SELECT label AS attack_type, count(*) AS n FROM labelled WHERE label <> 'BENIGN' GROUP BY 1"""))
def attack_types(spark, folder):
    return tidy(stats.attack_types(labelled(spark, folder), "label"))


@query("attack_type_count", with_views(("labelled",), """
SELECT count(DISTINCT label) AS n_attack_types FROM labelled WHERE label <> 'BENIGN'"""))
def attack_type_count(spark, folder):
    return tidy(stats.attack_type_count(labelled(spark, folder), "label"))


# --- samples and splits -------------------------------------------------------------------------

KEY = (FLOW_KEY,)
_RANKED = """
ranked AS (
  SELECT *, md5(concat('42|', flow_key)) AS h,
    row_number() OVER (PARTITION BY {by} ORDER BY md5(concat('42|', flow_key)), l_extendedprice) AS rk,
    count(*) OVER (PARTITION BY {by}) AS n_class, count(*) OVER () AS n_all,
    CAST(sum(is_attack) OVER () AS BIGINT) AS n_attack FROM labelled)"""


def _ranked(by: str, where: str) -> str:
    return with_views(("labelled",), f"SELECT flow_key, label, source FROM ranked WHERE {where}", _RANKED.format(by=by))


def _keys(df):
    return tidy(df.select("flow_key", "label", "source"))


@query("capped_classes", _ranked("label", "label <> 'Syn' AND rk <= 5000"))
def capped_classes(spark, folder):
    return _keys(sampling.cap_per_class(labelled(spark, folder), "label", 5000, ("Syn",), KEY))


@query("proportional_sample", _ranked("label", "rk <= round_even(least(1.0e0, 25000.0e0 / n_all) * n_class, 0)"))
def proportional_sample(spark, folder):
    return _keys(sampling.proportional_sample(labelled(spark, folder), "label", 25_000, KEY))


@query("mixed_sample", _ranked("is_attack", "rk <= CASE WHEN is_attack = 1 THEN 14000 ELSE 6000 END"))
def mixed_sample(spark, folder):
    return _keys(sampling.mixed_sample(labelled(spark, folder), "is_attack", 20_000, key=KEY))


@query("ratio_sample", _ranked("is_attack", """n_all <= 30000 OR rk <= CASE WHEN is_attack = 1
  THEN least(floor(30000 * (n_attack / n_all)), n_attack)
  ELSE 30000 - least(floor(30000 * (n_attack / n_all)), n_attack) END"""))
def ratio_sample(spark, folder):
    return _keys(sampling.ratio_sample(labelled(spark, folder), "is_attack", 30_000, KEY))


@query("capped_sample", _ranked("1", "rk <= 10000"))
def capped_sample(spark, folder):
    return _keys(sampling.capped_sample(labelled(spark, folder), 10_000, KEY))


@query("source_quota_sample", _ranked("source, is_attack", "rk <= CASE WHEN is_attack = 1 THEN 4800 ELSE 3200 END"))
def source_quota_sample(spark, folder):
    return _keys(sampling.source_quota_sample(labelled(spark, folder), "source", "is_attack", 8000, key=KEY))


@query("stratified_split", with_views(("labelled",), """
SELECT flow_key, label, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + round_even((n_class - t) * 0.1e0, 0) THEN 'val'
  ELSE 'train' END AS split FROM (SELECT *, round_even(n_class * 0.2e0, 0) AS t FROM ranked) x""", _RANKED.format(by="label")))
def stratified_split(spark, folder):
    return tidy(sampling.stratified_split(labelled(spark, folder), "label", 0.2, 0.1, KEY).select("flow_key", "label", "split"))


@query("stratified_folds", with_views(("labelled",), """
SELECT flow_key, label, CAST(CASE WHEN rk <= (b + 1) * e THEN (rk - 1) // (b + 1) ELSE e + (rk - 1 - (b + 1) * e) // b END
  AS BIGINT) AS fold FROM (SELECT *, n_class // 5 AS b, n_class % 5 AS e FROM ranked) x""", _RANKED.format(by="label")))
def stratified_folds(spark, folder):
    return tidy(sampling.stratified_folds(labelled(spark, folder), "label", 5, KEY).select("flow_key", "label", "fold"))


@query("subset_by_ids", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def subset_by_ids(spark, folder):
    ids = table(spark, folder, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tidy(sampling.subset_by_ids(rows, ids, "l_orderkey"))


@query("shuffled_rows", with_views(("labelled",), """
SELECT flow_key, label, row_number() OVER (ORDER BY md5(concat('42|', flow_key))) - 1 AS place FROM labelled"""))
def shuffled_rows(spark, folder):
    """Shuffled rows with their places in the order they come out in."""
    mixed = sampling.shuffled(labelled(spark, folder).select("flow_key", "label"), KEY)
    numbered = checkpointed(mixed.withColumn("_id", F.monotonically_increasing_id()))
    return tidy(numbered.join(dense_codes(numbered, "_id"), "_id").select("flow_key", "label", F.col("code").alias("place")))


@query("export_metadata", with_views(("labelled",), """
SELECT 'labelled' AS dataset, count(*) AS total_samples, CAST(sum(1 - is_attack) AS BIGINT) AS normal_samples,
  CAST(sum(is_attack) AS BIGINT) AS attack_samples, round(avg(is_attack), 6) AS attack_ratio,
  count(*) FILTER (rk > t) AS train_samples, CAST(0 AS BIGINT) AS val_samples, count(*) FILTER (rk <= t) AS test_samples,
  CAST(4 AS BIGINT) AS n_features FROM (SELECT *, round_even(n_class * 0.2e0, 0) AS t FROM ranked) x""",
  _RANKED.format(by="label")))
def export_metadata(spark, folder):
    split = sampling.stratified_split(labelled(spark, folder), "label", 0.2, key=KEY)
    return tidy(describe_export(split, "labelled", FEATURES, "is_attack").drop("feature_names"))



