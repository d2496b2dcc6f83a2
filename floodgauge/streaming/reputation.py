"""Reputation on streams.

Two forms with the results of ``reputation_history``, whatever the order of arrival within the allowed lateness:

* ``stream_reputation``: keyed state that takes the threats of an address in event-time order. All threats of an
  address in a micro-batch pass through one task, as columns; the source's rate limit bounds them.
* ``ReputationBatches``: threats wait in a table until the watermark has passed them, then go through the batch operator together with the state
  table left by the micro-batch before. An address with a large part of the traffic is summed by pieces of time first and spread over many
  tasks, which makes this the form for very skewed streams.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.operators.reputation import (
    BASE_TTL_SECONDS,
    DIGITS,
    SCORE_WEIGHT,
    latest_state,
    reputation_history,
    ttl_seconds,
)
from floodgauge.sources.keyed_state import KeyedState
from floodgauge.streaming.event_order import Columns, in_event_order, micros
from floodgauge.streaming.windows import event_time

OUTPUT = (
    "ip string, ts timestamp, flow_id long, score double, attack_type string, confidence double, "
    "detection_method string, ttl int, reputation_score double, validations long"
)
STATE = "ip string, score double, validations long, last_seen timestamp, attack_types array<string>, detection_methods array<string>"
#: Versions of the state that stay: the last one, and the one before for a batch that is run again.
KEPT_VERSIONS = 2
FIELDS = ["ip", "ts", "flow_id", "score", "attack_type", "confidence", "detection_method", "ttl"]


def _lifetime(total: float) -> int:
    """Microseconds an entry lives."""
    return int(BASE_TTL_SECONDS * (1 + round(min(1.0, SCORE_WEIGHT * total), DIGITS))) * 1_000_000


class Reputation:
    """Sum of scores, validations and last moment of an address; an entry that has expired is forgotten."""

    def step(self, key: tuple, kept: Any, rows: Columns):
        total, validations, last = kept or (0.0, 0, None)
        totals, counts = [], []
        for moment, score in zip(micros(rows["ts"]).tolist(), np.nan_to_num(rows["score"].astype(np.float64), posinf=np.inf, neginf=-np.inf).tolist()):
            if last is not None and moment - last >= _lifetime(total):
                total, validations = 0.0, 0
            total, validations, last = total + score, validations + 1, moment
            totals.append(total)
            counts.append(validations)
        reputation = np.array([round(min(1.0, SCORE_WEIGHT * t), DIGITS) for t in totals])
        return (total, validations, last), {c: rows[c] for c in FIELDS} | {"reputation_score": reputation, "validations": np.array(counts)}

    def due(self, kept: Any) -> int:
        return kept[2] + _lifetime(kept[0])

    def expire(self, key: tuple, kept: Any, now: int):
        return None, None


def stream_reputation(threats: DataFrame, late_seconds: int = 10) -> DataFrame:
    """Threats with the reputation after each of them, once the watermark has passed them; entries are dropped when they expire.

    A threat without address or time comes back at once, without a state.
    """
    unplaced = F.col("ip").isNull() | F.col("ts").isNull()
    rows = event_time(threats.select(*FIELDS).filter(~unplaced), "ts", late_seconds)
    found = in_event_order(rows, ["ip"], "ts", ["flow_id"], Reputation(), OUTPUT)
    aside = threats.select(*FIELDS).filter(unplaced).withColumns({
        "ts": F.col("ts").cast("timestamp"), "reputation_score": F.lit(None).cast("double"), "validations": F.lit(None).cast("long"),
    })
    return found.unionByName(aside)


class ReputationBatches:
    """``foreachBatch`` function: writes the history of the threats that the watermark has passed, and the state after them.

    Below ``folder``, each batch writes ``history/batch=<id>``, ``waiting/batch=<id>`` (threats newer than the watermark), ``late/batch=<id>``
    (threats that came too late, left out of the history) and last the state of the addresses it has met, as version ``id`` of a ``KeyedState`` in ``state``, and the
    watermark. Of the state a batch reads and writes only its own addresses, and what merges of runs come to. A batch is read back only by the next one;
    running a batch again, after a crash at any point, overwrites all of it with the same rows. ``finish`` hands on what still waits when the stream has ended.
    """

    def __init__(self, folder: str, late_seconds: int = 10):
        self.folder, self.late_seconds = folder, late_seconds

    def state(self, spark) -> KeyedState:
        """State by address; entries that have expired may still be in it."""
        return KeyedState(spark, f"{self.folder}/state", STATE, ["ip"])

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch={batch_id}"

    def _before(self, spark, batch_id: int, schema):
        """Waiting threats and watermark in microseconds that the batch before has left."""
        if batch_id == 0:
            return spark.createDataFrame([], schema), None
        waiting = spark.read.schema(schema).parquet(self._path("waiting", batch_id - 1))
        return waiting, spark.read.parquet(self._path("watermark", batch_id - 1)).first()["micros"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch.select(*FIELDS), batch_id, self.late_seconds)

    def finish(self, spark, last_batch_id: int, schema) -> None:
        """One more batch, without lateness."""
        self._advance(spark.createDataFrame([], schema), last_batch_id + 1, None)

    def _advance(self, rows: DataFrame, batch_id: int, late_seconds: int | None) -> None:
        spark = rows.sparkSession
        waiting, mark = self._before(spark, batch_id, rows.schema)
        moment = epoch_micros(F.col("ts"))
        late = F.coalesce(moment <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        rows.filter(late).write.mode("overwrite").parquet(self._path("late", batch_id))
        pool_path = self._path("pool", batch_id)
        waiting.unionByName(rows.filter(~late)).write.mode("overwrite").parquet(pool_path)
        pool = spark.read.schema(rows.schema).parquet(pool_path)
        newest = pool.agg(F.max(moment)).first()[0]
        if newest is not None:
            newest = newest if late_seconds is None else newest - late_seconds * 1_000_000
            mark = newest if mark is None else max(mark, newest)
        passed: Column = F.coalesce(moment <= F.lit(mark), F.lit(True)) if mark is not None else moment.isNull()
        ready, state = pool.filter(passed), self.state(spark)
        before = state.read(batch_id - 1, only=ready.select("ip"))
        history = reputation_history(ready, ("flow_id",), before)
        history.write.mode("overwrite").parquet(self._path("history", batch_id))
        pool.filter(~passed).write.mode("overwrite").parquet(self._path("waiting", batch_id))
        written = spark.read.schema(history.schema).parquet(self._path("history", batch_id)).filter("ip is not null and ts is not null")
        # No threat to come can reach an entry that has expired at the watermark.
        expired = epoch_micros(F.col("last_seen")) + ttl_seconds(F.col("score")).cast("long") * 1_000_000 <= F.lit(mark) if mark is not None else None
        state.write(latest_state(written, ("flow_id",)), batch_id, expired=expired)
        state.keep_last(KEPT_VERSIONS)
        spark.createDataFrame([(mark,)], "micros long").coalesce(1).write.mode("overwrite").parquet(self._path("watermark", batch_id))
