"""Declared schemas of every stream and table."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _TYPES[kind]))
    return T.StructType(fields)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}

# One line of the IDS event log, plus the slot for lines that are not valid JSON.
IDS_EVENT = T.StructType(
    _struct(
        "timestamp string,event_type string,src_ip string,dest_ip string,src_port int,"
        "dest_port int,proto string,app_proto string"
    ).fields
    + [
        T.StructField("alert", _struct("signature string,signature_id int,category string,severity int")),
        T.StructField(
            "flow",
            _struct(
                "bytes_toserver long,bytes_toclient long,pkts_toserver long,"
                "pkts_toclient long,age int,state string"
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

TRAFFIC_LOG = _struct(
    "timestamp timestamp,source string,event_type string,src_ip string,dst_ip string,src_port int,"
    "dst_port int,protocol int,packets long,bytes long,duration double,tcp_flags int,"
    "next_hop string,src_as int,dst_as int,app_proto string,alert_signature string,"
    "alert_category string,alert_severity int,alert_signature_id int,bytes_toserver long,"
    "bytes_toclient long,pkts_toserver long,pkts_toclient long,flow_age int,flow_state string,"
    "raw_data string"
)

THREAT = _struct(
    "ip string,score double,attack_type string,confidence double,detection_method string,"
    "ts timestamp,ttl int"
)

MALICIOUS_IP = _struct(
    "ip string,threat_score double,reputation_score double,attack_type string,confidence double,"
    "detection_method string,timestamp timestamp,ttl int,validations long"
)

ROUTE_UPDATE = _struct(
    "action string,ip string,route_type string,strategy string,attack_type string,"
    "threat_score double,timestamp timestamp,ttl int,reason string,command string"
)

REPUTATION_STATE = T.StructType(
    _struct("ip string,score double,validations long,last_seen timestamp").fields
    + [
        T.StructField("attack_types", T.ArrayType(T.StringType())),
        T.StructField("detection_methods", T.ArrayType(T.StringType())),
    ]
)

# Columns of the labelled NetFlow export that the feature operators use by name.
NETFLOW_V3 = _struct(
    "IPV4_SRC_ADDR string,IPV4_DST_ADDR string,L4_SRC_PORT int,L4_DST_PORT int,PROTOCOL int,"
    "L7_PROTO double,IN_BYTES long,OUT_BYTES long,IN_PKTS long,OUT_PKTS long,"
    "FLOW_START_MILLISECONDS long,FLOW_DURATION_MILLISECONDS long,DURATION_IN long,"
    "DURATION_OUT long,TCP_FLAGS int,TCP_WIN_MAX_IN int,TCP_WIN_MAX_OUT int,MIN_IP_PKT_LEN int,"
    "MAX_IP_PKT_LEN int,SRC_TO_DST_AVG_THROUGHPUT double,DST_TO_SRC_AVG_THROUGHPUT double,"
    "SRC_TO_DST_SECOND_BYTES double,SRC_TO_DST_IAT_MIN long,SRC_TO_DST_IAT_MAX long,"
    "SRC_TO_DST_IAT_AVG double,SRC_TO_DST_IAT_STDDEV double,DST_TO_SRC_IAT_AVG double,"
    "NUM_PKTS_UP_TO_128_BYTES long,NUM_PKTS_128_TO_256_BYTES long,NUM_PKTS_256_TO_512_BYTES long,"
    "NUM_PKTS_512_TO_1024_BYTES long,NUM_PKTS_1024_TO_1514_BYTES long,RETRANSMITTED_IN_BYTES long,"
    "RETRANSMITTED_OUT_BYTES long,RETRANSMITTED_IN_PKTS long,RETRANSMITTED_OUT_PKTS long,"
    "DNS_QUERY_ID long,FTP_COMMAND_RET_CODE long,Label int,Attack string"
)
