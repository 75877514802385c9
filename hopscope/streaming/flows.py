"""Structured Streaming forms: resumable ingest, windows, deduplication, matching and onsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.net import timestamp_reason

SCHEMA = "row_id bigint, flow bigint, point int, packet_key bigint, t timestamp, len bigint"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 100) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append good rows to ``out``/rows and those set aside to ``out``/quarantine, once each: a batch rewrites its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        reason = timestamp_reason(F.unix_micros("t"), F.unix_micros(F.current_timestamp()))
        held = batch.withColumn("reason", reason).persist()
        held.filter("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        held.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        held.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_counts(rows: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Records and bytes per point and tumbling window; windows close when the watermark passes them."""
    return rows.withWatermark("t", late).groupBy(F.window("t", width), "point").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))


def sliding_rates(rows: DataFrame, width: str, slide: str, late: str = "10 seconds") -> DataFrame:
    return rows.withWatermark("t", late).groupBy(F.window("t", width, slide), "point").agg(F.sum("len").alias("bytes"))


def sessions(rows: DataFrame, gap: str, late: str = "10 seconds") -> DataFrame:
    """Episodes of a flow parted by gaps."""
    return rows.withWatermark("t", late).groupBy(F.session_window("t", gap), "flow").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(rows: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The first of equal keys at a point within the watermark."""
    return rows.withWatermark("t", late).dropDuplicatesWithinWatermark(["point", "packet_key"])


def matched(rows: DataFrame, here: int, there: int, within: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Records at point ``here`` with their time at ``there``; null once the watermark shows that none can come: missing."""
    a = rows.filter(F.col("point") == here).select("packet_key", F.col("t").alias("t_a")).withWatermark("t_a", late).alias("a")
    b = rows.filter(F.col("point") == there).select("packet_key", F.col("t").alias("t_b")).withWatermark("t_b", late).alias("b")
    same = F.expr(f"a.packet_key = b.packet_key AND t_b >= t_a - INTERVAL {within} AND t_b <= t_a + INTERVAL {within}")
    return a.join(b, same, "leftOuter").select(F.col("a.packet_key"), "t_a", "t_b")


class OnsetState(StatefulProcessor):
    """Per key the values of its buckets so far, and the onset once the shared fold finds it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "bucket long", "n double")
        self.done = handle.getValueState("done", "onset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        from ..operators.series import count_onset

        for part in rows:
            for bucket, n in zip(part["bucket"], part["n"]):
                old = self.values.getValue((int(bucket),))
                self.values.updateValue((int(bucket),), ((old[0] if old else 0.0) + float(n),))
        if self.done.exists():
            return
        seen = {int(k[0]): float(v[0]) for k, v in self.values.iterator()}
        first, last = min(seen), max(seen)
        at = count_onset([seen.get(b, 0.0) for b in range(first, last + 1)])
        if at is not None:
            self.done.update((first + at,))
            yield pd.DataFrame({"flow": [key[0]], "onset": [first + at]})

    def close(self) -> None:
        pass


def onsets(counts: DataFrame) -> DataFrame:
    """(flow, onset) as soon as the fold finds a rise in a flow's counts; ``counts`` has flow, bucket and n."""
    grouped = counts.select("flow", "bucket", "n").groupBy("flow")
    return grouped.transformWithStateInPandas(OnsetState(), "flow long, onset long", "Update", "None")
