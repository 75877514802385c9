"""A deterministic projection of the events table into records seen at four points of a path.

Each event is sent once along the points 0 to 3 (forward) or back. Some are lost on the way and sent
again, some appearances are missed by the recording, and clocks jitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKING_EVENTS = """ev AS (SELECT event_id, user_id AS flow, epoch_us(ts) AS t_us, event_type, value, props,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

_ROWS = """
  SELECT point, event_id * 8 + attempt * 4 + point AS row_id, flow, direction, hop, event_id, attempt, k, event_type,
    ts_us + attempt * (180000 + (event_id % 5) * 30000) + hop * 2000 + (event_id * (31 + hop * 57)) % 1700 + attempt * 7 AS t_us,
    event_id * 2 + attempt AS packet_key, 40 + (event_id * 13) % 1400 AS len,
    (flow * 7919 + event_id * 1400) % 4294967296 AS seq,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 4 WHEN 'click' THEN 18 WHEN 'purchase' THEN 17 ELSE 16 END AS flags,
    64 - hop - CASE WHEN event_id % 97 = 0 AND hop > 1 THEN 1 ELSE 0 END AS ttl,
    CASE WHEN event_id % 89 = 0 AND hop > 1 THEN 0 ELSE 46 END AS dscp
  FROM raw WHERE (attempt = 0 AND (hop = 0 OR NOT ((event_id * 7919) % 97 = 0 AND hop > event_id % 3))
      AND (event_id * 31 + hop * 101) % 53 <> 0)
    OR (attempt = 1 AND (event_id * 7919) % 97 = 0 AND event_id % 2 = 0)"""

CHECKING_OBS = f"""raw AS (SELECT *, CASE WHEN direction = 'forward' THEN point ELSE 3 - point END AS hop FROM (
    SELECT *, unnest(range(0, 4)) AS point FROM (SELECT event_id, flow, t_us AS ts_us, k, event_type, unnest(range(0, 2)) AS attempt,
      CASE WHEN event_id % 3 = 0 THEN 'reverse' ELSE 'forward' END AS direction FROM ev))),
  obs AS ({_ROWS})"""


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def micro_events(events: DataFrame) -> DataFrame:
    """event_id, flow, t_us, event_type, value, props and k."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", F.col("user_id").alias("flow"), micros("ts").alias("t_us"), "event_type", "value", "props", k.alias("k"))


def path_obs(events: DataFrame) -> DataFrame:
    """One row per appearance of a record at a point."""
    direction = F.when(F.col("event_id") % 3 == 0, "reverse").otherwise("forward")
    rows = micro_events(events).withColumnRenamed("t_us", "ts_us").withColumn("direction", direction)
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    rows = rows.withColumn("hop", F.when(F.col("direction") == "forward", F.col("point")).otherwise(3 - F.col("point")))
    return rows.sparkSession.sql(_ROWS.replace("FROM raw", "FROM {raw}"), raw=rows)
