"""All registered queries."""

from __future__ import annotations

from floodgauge.plans import alert_queries, dataset_queries, live_queries, metric_queries, model_queries, storage_queries, stream_queries  # noqa: F401
from floodgauge.plans.registry import ORACLES, QUERIES


def queries():
    """Queries by name; each pins the session to UTC, which the time arithmetic relies on."""

    def pinned(fn):
        def run(spark, folder):
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        return run

    return {name: pinned(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
