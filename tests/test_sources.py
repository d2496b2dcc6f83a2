import struct
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodgauge.sources import export, ids_log, messages, netflow, tables


def datagram(records, version=5, count=None, cut=0):
    head = struct.pack("!HHIIIIBBH", version, len(records) if count is None else count, 7, 1_700_000_000, 0, 1, 0, 0, 0)
    body = b"".join(struct.pack("!IIIHHIIIIHHBBBBHHBBH", *r) for r in records)
    data = head + body
    return bytearray(data[: len(data) - cut])


RECORD = (0x0A000001, 0xFFFFFFFF, 0xC0000201, 1, 2, 4_000_000_000, 99, 1000, 6500, 65535, 53, 0, 0x12, 17, 0, 64512, 1, 24, 16, 0)
SHORT = (1, 2, 3, 1, 2, 1, 1, 1000, 1400, 1, 2, 0, 2, 6, 0, 1, 1, 24, 16, 0)


def decode(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload binary")
    return netflow.decode_datagrams(df)


def test_netflow_fields(spark):
    row = netflow.normalize_records(decode(spark, datagram([RECORD]))).first()
    assert (row.src_ip, row.dst_ip, row.next_hop) == ("10.0.0.1", "255.255.255.255", "192.0.2.1")
    assert (row.packets, row.bytes, row.src_port, row.dst_port) == (4_000_000_000, 99, 65535, 53)
    assert (row.tcp_flags, row.protocol, row.src_as, row.dst_as) == (0x12, 17, 64512, 1)
    assert row.duration == 5.5 and row.source == "netflow" and row.event_type == "flow"
    assert row.timestamp.timestamp() == 1_700_000_000


def test_netflow_limits(spark):
    assert decode(spark, datagram([RECORD], version=9)).count() == 0
    assert decode(spark, bytearray(b"\0\5\0\1" + b"x" * 19)).count() == 0
    assert decode(spark, datagram([])).count() == 0
    assert decode(spark, datagram([RECORD, SHORT], cut=1)).count() == 1
    assert decode(spark, datagram([RECORD, SHORT], count=30)).count() == 2
    assert decode(spark, datagram([RECORD, SHORT, SHORT], count=1)).count() == 1
    assert netflow.normalize_records(decode(spark, datagram([SHORT]))).first().duration == 1.0


LINES = [
    '{"timestamp": "2024-05-01T10:00:00.250000+0200", "event_type": "flow", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2",'
    ' "src_port": 5, "dest_port": 80, "proto": "TCP", "flow": {"bytes_toserver": 10, "bytes_toclient": 5, "age": 3}}',
    '{"timestamp": "2024-05-01T10:00:00Z", "event_type": "alert", "src_ip": "1.1.1.1", "alert": {"severity": 2}}',
    '{"event_type": "netflow", "proto": "udp"}',
    '{"event_type": "dns"}',
    "   ",
    "",
    '{"event_type": "flow", ',
]


def test_ids_lines(spark):
    parsed = ids_log.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()
    assert [r.line for r in ids_log.quarantine(parsed).collect()] == [LINES[-1].strip()]
    default = F.lit("2020-01-01 00:00:00").cast("timestamp")
    rows = {r.event_type: r for r in ids_log.normalize_events(ids_log.valid_events(parsed), default).collect()}
    assert set(rows) == {"flow", "alert", "netflow"}
    flow, alert, other = rows["flow"], rows["alert"], rows["netflow"]
    assert (flow.bytes, flow.packets, flow.duration, flow.protocol) == (15, 0, 3.0, 6)
    assert flow.timestamp.isoformat().startswith("2024-05-01T08:00:00.25")
    assert flow.alert_severity is None and flow.flow_state == ""
    assert (alert.alert_severity, alert.alert_signature, alert.dst_port, alert.dst_ip) == (2, "", 0, "")
    assert (other.protocol, other.src_ip) == (17, "") and other.timestamp.year == 2020


def test_messages_drop_broken(spark):
    schema = T.StructType([T.StructField("ip", T.StringType()), T.StructField("n", T.IntegerType())])
    raw = spark.createDataFrame([('{"ip": "a", "n": 1}',), ("{broken",)], "value string")
    assert messages.decode(raw, schema).collect() == [Row(ip="a", n=1)]


def write(path, name, text):
    import os

    os.makedirs(f"{path}/{os.path.dirname(name)}", exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


@pytest.fixture()
def csvs():
    path = tempfile.mkdtemp(prefix="run-")
    write(path, "a/one.csv", "x,Label\n1,BENIGN\n2,Syn\n")
    write(path, "a/b/two.csv", "Label,y\nSyn,3.5\n")
    write(path, "three.csv", "x,Label\n9,BENIGN\n")
    write(path, "empty.csv", "")
    write(path, "NetFlow_Features.csv", "Nome,info\nx,first\ny,second\n")
    return path


def test_scan_csv(spark, csvs):
    rows = tables.scan_csv(spark, csvs)
    assert sorted(rows.columns) == ["Label", "x", "y"] and rows.count() == 4
    assert rows.filter("y IS NULL").count() == 3
    declared = T.StructType([T.StructField("x", T.LongType()), T.StructField("Label", T.StringType())])
    assert dict(tables.scan_csv(spark, csvs, declared).dtypes)["x"] == "bigint"
    assert tables.scan_csv(spark, csvs, which="largest").count() == 2
    assert tables.scan_csv(spark, csvs, recursive=False).count() == 1
    assert tables.feature_names(spark, csvs) == ["x", "y"]
    with pytest.raises(FileNotFoundError):
        tables.scan_csv(spark, csvs + "/a/none")


def test_scan_preferred(spark, csvs):
    assert tables.scan_preferred(spark, csvs)[1] == "csv"
    target = tempfile.mkdtemp(prefix="run-")
    spark.range(3).write.mode("overwrite").parquet(target)
    found, kind = tables.scan_preferred(spark, target)
    assert kind == "parquet" and found.count() == 3


def test_first_available(spark):
    target = tempfile.mkdtemp(prefix="run-")
    spark.range(3).write.mode("overwrite").parquet(f"{target}/simple")
    name, found = tables.first_available(spark, [("real", f"{target}/real"), ("simple", f"{target}/simple")])
    assert name == "simple" and found.count() == 3
    with pytest.raises(FileNotFoundError):
        tables.first_available(spark, [("real", f"{target}/real")])


def test_export_and_snapshots(spark):
    target = tempfile.mkdtemp(prefix="run-")
    df = spark.createDataFrame([(1.0, 0, "train"), (2.0, 1, "train"), (3.0, 1, "test")], "a double, y int, split string")
    export.export_prepared(df, target, "d", ["a"], "y")
    meta = spark.read.json(f"{target}/metadata").first()
    assert (meta.total_samples, meta.attack_samples, meta.train_samples, meta.feature_names) == (3, 2, 2, ["a"])
    assert spark.read.parquet(f"{target}/data").filter("split = 'test'").count() == 1
    export.write_report(df, f"{target}/report")
    assert spark.read.json(f"{target}/report").count() == 3
    assert export.read_snapshot(spark, f"{target}/state") is None
    for v in (0, 1):
        export.write_snapshot(spark.createDataFrame([("ip", float(v))], "ip string, score double"), f"{target}/state", v, "ip", 2)
    assert export.read_snapshot(spark, f"{target}/state").first().score == 1.0
    assert export.read_snapshot(spark, f"{target}/state", 0).first().score == 0.0
