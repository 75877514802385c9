from datetime import datetime, timedelta


from hopscope.streaming import flows

T0 = datetime(2024, 1, 1)


def write(spark, folder, rows):
    data = [(k, f, p, key, T0 + timedelta(seconds=s), n) for k, (f, p, key, s, n) in enumerate(rows)]
    spark.createDataFrame(data, flows.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name).collect()


def test_ingest_is_resumable(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    write(spark, src, [(1, 0, 1, 0, 5), (1, 0, 2, -10**9, 5)])
    flows.ingest(flows.read(spark, src), out, mark).awaitTermination()
    write(spark, src, [(1, 1, 1, 1, 5)])
    flows.ingest(flows.read(spark, src), out, mark).awaitTermination()
    assert spark.read.parquet(f"{out}/rows").count() == 2
    assert [r.reason for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["before 2000"]


def test_windows_duplicates_and_missing(spark, tmp_path):
    src = f"{tmp_path}/in"
    write(spark, src, [(1, 0, 1, 0.1, 5), (1, 0, 1, 0.2, 5), (1, 1, 1, 0.3, 5), (1, 0, 2, 1.5, 7), (1, 1, 2, 1.6, 7), (1, 0, 3, 2.0, 9)])
    write(spark, src, [(9, 0, 99, 500, 1), (9, 1, 98, 500, 1)])
    write(spark, src, [(9, 0, 97, 900, 1), (9, 1, 96, 900, 1)])
    rows = flows.read(spark, src, files=1)
    got = {(r.window.start.second, r.point): (r.n, r.bytes) for r in run(flows.bucket_counts(rows), "buckets") if r.window.start < T0 + timedelta(seconds=10)}
    assert got[0, 0] == (2, 10) and got[1, 1] == (1, 7)
    assert sum(r.packet_key == 1 for r in run(flows.deduplicated(rows), "dedup")) == 2
    pairs = {r.packet_key: r.t_b is not None for r in run(flows.matched(rows, 0, 1), "matched")}
    assert pairs[1] and pairs[2] and pairs[3] is False
    assert max(r.n for r in run(flows.sessions(rows, "5 seconds"), "sessions")) == 6


def test_onset_state(spark, tmp_path):
    src = f"{tmp_path}/counts"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ([1, 0, 1, 1, 0], [0, 5], [6, 7]):
            at = spark.read.parquet(src).count() if (tmp_path / "counts").exists() else 0
            spark.createDataFrame([(3, at + k, float(n)) for k, n in enumerate(part)], "flow long, bucket long, n double").coalesce(1).write.mode("append").parquet(src)
        counts = flows.read(spark, src, "flow long, bucket long, n double", 1)
        assert [(r.flow, r.onset) for r in run(flows.onsets(counts), "onsets", "update")] == [(3, 6)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
