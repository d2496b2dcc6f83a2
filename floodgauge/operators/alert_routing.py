"""What becomes of firing alerts: muting while a worse one fires, and the times at which groups are notified.

Alerts are intervals ``[since, until)`` in epoch seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.operators.ordered import cumulate_by_value
from floodgauge.session import null_safe_join

# Labels that must be equal, and the waiting times of a group in seconds.
EQUAL_LABELS = ("alertname", "dev", "instance")
GROUP_WAIT, GROUP_INTERVAL, REPEAT_INTERVAL = 10, 10, 3600
#: Seconds of a bucket that intervals are cut at, so that alerts with the same labels are spread over many tasks.
BUCKET_SECONDS = 86_400


def merged_intervals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping and touching intervals of the same keys as one; NULL keys are equal."""
    in_order = W.partitionBy(*keys).orderBy("since", "until")
    reach = F.max("until").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce(F.col("since") > reach, F.lit(True)).cast("long")
    marked = rows.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def _cut(rows: DataFrame, seconds: int) -> DataFrame:
    """Intervals cut at the ends of buckets."""
    first, last = F.floor(F.col("since") / seconds), F.floor((F.col("until") - 1) / seconds)
    each = rows.filter("until > since").withColumn("_bucket", F.explode(F.sequence(first, last)))
    low, high = F.greatest("since", F.col("_bucket") * seconds), F.least("until", (F.col("_bucket") + 1) * seconds)
    return each.withColumns({"_low": low, "_high": high})


def audible(
    alerts: DataFrame, equal: Sequence[str] = EQUAL_LABELS, source: str = "critical", target: str = "warning", bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """The alerts, and of those of the ``target`` severity the parts during which no ``source`` alert with the same labels fires.

    A label that is missing, or that the table has no column for, equals a missing one. An alert that is muted in between comes back in several parts, one that is muted all the time not
    at all. Equal rows count once.
    """
    labels = [c for c in equal if c in alerts.columns]
    columns = alerts.columns
    rest = [c for c in columns if c not in ("since", "until")]
    loud = _cut(alerts.filter(F.col("severity") == source).select(*labels, "since", "until"), bucket_seconds)
    walls = merged_intervals(loud.select(*labels, "_bucket", F.col("_low").alias("since"), F.col("_high").alias("until")), [*labels, "_bucket"])
    soft = alerts.filter(F.col("severity") == target).distinct()
    parts = _cut(soft.withColumn("_whole", F.struct("since", "until")), bucket_seconds)
    walls = walls.withColumnsRenamed({"since": "_from", "until": "_to"})
    # Walls of a bucket do not overlap, so there are no more pairs than pieces of the result and one.
    met = null_safe_join(parts, walls, [*labels, "_bucket"], "left")
    met = met.withColumn("_wall", F.when((F.col("_from") < F.col("_high")) & (F.col("_to") > F.col("_low")), F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))))
    held = met.groupBy(*rest, "_whole", "_low", "_high").agg(F.array_sort(F.collect_list("_wall")).alias("_walls"))
    edges_from = F.concat(F.array("_low"), F.transform("_walls", lambda w: w["b"]))
    edges_to = F.concat(F.transform("_walls", lambda w: w["a"]), F.array("_high"))
    gaps = F.filter(F.arrays_zip(edges_from.alias("since"), edges_to.alias("until")), lambda g: g["since"] < g["until"])
    pieces = held.select(*rest, "_whole", F.inline(gaps).alias("since", "until"))
    # Parts that touch at the end of a bucket are one again.
    whole = merged_intervals(pieces, [*rest, "_whole"]).select(*columns)
    return whole.unionByName(alerts.filter(F.coalesce(F.col("severity") != target, F.lit(True))).select(*columns))


def notifications(
    alerts: DataFrame, by: Sequence[str] = ("alertname",), wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL, repeat: int = REPEAT_INTERVAL,
) -> DataFrame:
    """``by, opened, due, reason, n_firing``: every notification of every group, in epoch seconds.

    A group opens with its first alert and closes when none of its alerts fires. It is looked at ``wait`` seconds after it has opened and every ``interval``
    seconds from then on. It is notified at the first look (``first``), at a look before which alerts have begun or ended (``change``), and when the last
    notification is ``repeat`` seconds old (``repeat``). The look that finds the group closed ends it (``resolved``); a group that closes before its first look is not notified.
    """
    by = list(by)
    lives = merged_intervals(alerts.filter("until > since").select(*by, "since", "until"), by).withColumnsRenamed({"since": "opened", "until": "closed"})
    # The life of each change: the last one of the group that opened before it.
    changes = alerts.filter("until > since").select(*by, F.explode(F.array(
        F.struct(F.col("since").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("delta")))).alias("c")).select(*by, "c.*")
    net = changes.groupBy(*by, "at").agg(F.sum("delta").alias("delta"))
    timeline = net.select(*by, "at", "delta").unionByName(lives.select(*by, F.col("opened").alias("at"), F.lit(0).cast("long").alias("delta")))
    timeline = timeline.groupBy(*by, "at").agg(F.sum("delta").alias("delta"))
    firing = cumulate_by_value(timeline, by, "at", ["delta"]).withColumn("n_firing", F.col("delta") + F.col("delta_before"))
    # A life begins where nothing fired before.
    in_order = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    opened = firing.withColumn("opened", F.max(F.when(F.col("delta_before") == 0, F.col("at"))).over(in_order))
    look = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("opened") - wait) / interval))
    # The last change before a look decides how many fire at it.
    looks = opened.groupBy(*by, "opened", look.cast("long").alias("look")).agg(F.max_by("n_firing", "at").alias("n_firing"))
    life = W.partitionBy(*by, "opened").orderBy("look")
    ordered = looks.withColumns({"following": F.lead("look").over(life), "first": F.row_number().over(life) == 1})
    every = -(-repeat // interval)
    more = F.when(F.col("following").isNotNull() & (F.col("n_firing") > 0), F.filter(
        F.sequence(F.col("look"), F.col("following"), F.lit(every).cast("long")), lambda x: (x > F.col("look")) & (x < F.col("following"))))
    own = F.when(F.col("n_firing") == 0, "resolved").when(F.col("first"), "first").otherwise("change")
    sent = F.concat(
        F.array(F.struct(F.col("look").alias("look"), own.alias("reason"))),
        F.transform(F.coalesce(more, F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("look"), F.lit("repeat").alias("reason"))),
    )
    due = (F.col("opened") + wait + F.col("s.look") * interval).alias("due")
    return ordered.filter(~(F.col("first") & (F.col("n_firing") == 0))).select(*by, "opened", "n_firing", F.explode(sent).alias("s")).select(
        *by, "opened", due, F.col("s.reason").alias("reason"), "n_firing")
