"""Queries on clocks, bucketed series, onsets, bursts and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching, series, windows
from .paths import LOSSES, MATCHES
from .registry import portable, query

#: A planted clock error of the hops after the first: offset and drift.
SKEW_US, DRIFT = 250_000, 2e-9
_T0 = 1704067200000000

_SAMPLES = f"""s AS (SELECT 'hop' || CAST(hop + 1 AS VARCHAR) AS pair, t_a AS ref_us, t_b + 250000 + CAST(floor((t_b - {_T0}) * 2e-9::DOUBLE) AS BIGINT) AS other_us, direction = 'forward' AS fwd
    FROM m WHERE direction = 'forward' AND hop < 3 UNION ALL
  SELECT 'hop' || CAST(3 - hop AS VARCHAR), t_b, t_a + 250000 + CAST(floor((t_a - {_T0}) * 2e-9::DOUBLE) AS BIGINT), false FROM m WHERE direction = 'reverse')"""


def two_way_samples(obs: DataFrame) -> DataFrame:
    """Pairs of times of one record at neighbouring points, the farther point's clock being off."""
    m = matching.hop_matches(obs)

    def far(t: str) -> Column:
        return F.col(t) + SKEW_US + F.floor((F.col(t) - _T0) * DRIFT)

    ahead = m.filter("direction = 'forward'").select(F.concat(F.lit("hop"), F.col("hop") + 1).alias("pair"), F.col("t_a").alias("ref_us"), far("t_b").alias("other_us"), F.lit(True).alias("forward"))
    back = m.filter("direction = 'reverse'").select(F.concat(F.lit("hop"), 3 - F.col("hop")).alias("pair"), F.col("t_b").alias("ref_us"), far("t_a").alias("other_us"), F.lit(False).alias("forward"))
    return ahead.unionByName(back)



@query(f"""WITH {MATCHES}, {_SAMPLES} SELECT pair, count(*) AS n, round(quantile_cont(other_us - ref_us, 0.01) FILTER (fwd), 3) AS quick_forward, round(quantile_cont(other_us - ref_us, 0.99) FILTER (NOT fwd), 3) AS quick_reverse,
  round((quantile_cont(other_us - ref_us, 0.01) FILTER (fwd) + quantile_cont(other_us - ref_us, 0.99) FILTER (NOT fwd)) / 2, 3) AS offset_us FROM s GROUP BY pair""")
def clock_offsets(obs: DataFrame) -> DataFrame:
    """The plain two-way offset per pair of points, without drift."""
    s = two_way_samples(obs).withColumn("d", F.col("other_us") - F.col("ref_us"))
    quick = s.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("forward"), F.col("d")), F.lit(0.01)).alias("quick_forward"), F.percentile(F.when(~F.col("forward"), F.col("d")), F.lit(0.99)).alias("quick_reverse"))
    offset = F.round((F.col("quick_forward") + F.col("quick_reverse")) / 2, 3)
    return quick.select("pair", "n", F.round("quick_forward", 3).alias("quick_forward"), F.round("quick_reverse", 3).alias("quick_reverse"), offset.alias("offset_us"))


@query()
def clock_models(obs: DataFrame) -> DataFrame:
    """Offset and drift per pair of points from at most 20,000 samples each; tests hold it against the planted clock."""
    return series.clock_models(series.sample_by_hash(two_way_samples(obs), ["pair"], ["ref_us", "other_us"], 20_000), "pair")


@query()
def clock_corrected_latency(obs: DataFrame) -> DataFrame:
    """Transit times after correction by the fitted clocks."""
    samples = two_way_samples(obs)
    models = F.broadcast(series.clock_models(series.sample_by_hash(samples, ["pair"], ["ref_us", "other_us"], 20_000), "pair"))  # a row per pair of points
    fixed = samples.join(models, "pair").withColumn("t", series.corrected(F.col("other_us"), F.col("epoch_us"), F.col("offset_us"), F.col("drift")))
    return fixed.groupBy("pair", "forward").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(F.abs(F.col("t") - F.col("ref_us")), F.lit(0.5)), 3).alias("p50_us"))


portable("shared_clock_pairs", """WITH d AS (SELECT a.point AS p, b.point AS q, b.t_us - a.t_us AS d, a.direction FROM {obs} a JOIN {obs} b ON a.packet_key = b.packet_key AND a.direction = b.direction AND b.point = a.point + 1)
  SELECT p, q, count(*) FILTER (WHERE direction = 'forward') AS n_forward, count(*) FILTER (WHERE direction = 'reverse') AS n_reverse,
    CASE WHEN count(*) FILTER (WHERE direction = 'forward') >= 8 AND count(*) FILTER (WHERE direction = 'reverse') >= 8 THEN QUANTILE(CASE WHEN direction = 'forward' THEN d END, 0.5) BETWEEN 0 AND 250 END AS shared FROM d GROUP BY p, q""")
portable("transit_quality", """WITH d AS (SELECT a.direction, a.hop, b.t_us - a.t_us - 2500 AS d FROM {obs} a JOIN {obs} b ON a.packet_key = b.packet_key AND a.direction = b.direction AND b.hop = a.hop + 1)
  SELECT direction, hop, QUANTILE(d, 0.5) AS p50, CASE WHEN QUANTILE(d, 0.5) < -300 THEN 'systematic negative' END AS reason FROM d GROUP BY direction, hop""")

_BUCKETS = f"""{LOSSES}, c AS (SELECT direction, hop, min(t_us) AS a, max(t_us) AS b FROM obs GROUP BY direction, hop),
  cell AS (SELECT c.*, unnest(generate_series(a // 3600000000, b // 3600000000)) AS bucket FROM c WHERE hop < 3),
  e AS (SELECT direction, hop, t_us // 3600000000 AS bucket, count(*) AS eligible FROM seen WHERE hop < 3 GROUP BY ALL),
  x AS (SELECT direction, hop, t_us // 3600000000 AS bucket, count(*) FILTER (kind <> 'capture_miss') AS lost, count(*) FILTER (kind = 'capture_miss') AS missed FROM kinds GROUP BY ALL),
  g AS (SELECT cell.direction, cell.hop, cell.bucket, CASE WHEN a <= cell.bucket * 3600000000 AND b >= (cell.bucket + 1) * 3600000000 THEN 'capturing' ELSE 'partial' END AS coverage,
    coalesce(eligible, 0) AS eligible, coalesce(lost, 0) AS lost, coalesce(eligible, 0) - coalesce(missed, 0) AS matchable
    FROM cell LEFT JOIN e USING (direction, hop, bucket) LEFT JOIN x USING (direction, hop, bucket))"""


def buckets(obs: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """A row per segment and bucket of time with loss_percent, null with a reason unless it is known."""
    spans = obs.groupBy("direction", "hop").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b")).filter("hop < 3")
    cells = series.grid(spans, F.col("a"), F.col("b"), width)
    bucket = F.floor(F.col("t_us") / width).alias("bucket")
    eligible = obs.filter("attempt = 0 AND hop < 3").groupBy("direction", "hop", bucket).agg(F.count(F.lit(1)).alias("eligible"))
    lost = matching.classify_losses(obs).groupBy("direction", "hop", bucket).agg(F.count_if(F.col("kind") != "capture_miss").alias("lost"), F.count_if(F.col("kind") == "capture_miss").alias("missed"))
    keys = ["direction", "hop", "bucket"]
    rows = cells.join(eligible, keys, "left").join(lost, keys, "left").fillna(0, ["eligible", "lost", "missed"])
    start = F.col("bucket") * width
    rows = rows.withColumns({"coverage": series.coverage_state(start, start + width, F.col("a"), F.col("b")), "matchable": F.col("eligible") - F.col("missed")})
    value, reason = series.gated(F.round(100 * F.col("lost") / F.nullif("eligible", F.lit(0)), 6), F.col("coverage"), F.col("eligible"), F.col("matchable"))
    return rows.select(*keys, "coverage", "eligible", "lost", "matchable", value.alias("loss_percent"), reason.alias("reason"))



@query(f"""WITH {_BUCKETS}, r AS (SELECT *, CASE WHEN coverage <> 'capturing' THEN 'coverage: ' || coverage WHEN eligible = 0 THEN 'no eligible records' WHEN matchable < 0.9 * eligible THEN 'too few matchable records' END AS reason FROM g)
  SELECT direction, hop, bucket, coverage, eligible, lost, matchable, CASE WHEN reason IS NULL THEN round(100.0::DOUBLE * lost / eligible, 6) END AS loss_percent, reason FROM r""")
def segment_buckets(obs: DataFrame) -> DataFrame:
    return buckets(obs)


@query()
def count_onset(obs: DataFrame) -> DataFrame:
    """The onset of losses per segment, by a fold in time order that tests and streaming share."""
    return series.detect_onsets(buckets(obs), ["direction", "hop"], "bucket", "lost")


@query()
def latency_onset(obs: DataFrame) -> DataFrame:
    per = matching.hop_matches(obs).groupBy("direction", "hop", F.floor(F.col("t_a") / 3_600_000_000).alias("bucket")).agg(F.percentile("transit_us", F.lit(0.95)).alias("p95_us"))
    return series.detect_onsets(per, ["direction", "hop"], "bucket", "p95_us", "latency", floor=500.0)


portable("onset_status", """WITH b AS (SELECT flow, CAST(floor(t_us / 86400000000e0) AS BIGINT) AS day, count(*) AS n FROM {ev} WHERE event_type = 'error' GROUP BY 1, 2), s AS (SELECT flow, count(*) AS days, max(n) AS peak FROM b GROUP BY flow)
  SELECT CASE WHEN days < 5 THEN 'unknown' WHEN peak >= 4 THEN 'detected' WHEN peak >= 3 THEN 'partial' ELSE 'none' END AS status, count(*) AS n FROM s GROUP BY 1""")


@query("""WITH r AS (SELECT *, sum(len) OVER w AS amount, min(t_us) OVER w AS lo FROM obs WINDOW w AS (PARTITION BY point ORDER BY t_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)),
  bins AS (SELECT point, t_us // 600000000 AS bin, sum(len) AS amount, count(*) AS n FROM obs GROUP BY ALL),
  base AS (SELECT point, quantile_cont(amount, 0.5) AS baseline, sum(n) AS n FROM bins GROUP BY point HAVING sum(n) >= 8),
  hot AS (SELECT r.*, max(t_us) OVER (PARTITION BY r.point ORDER BY t_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM r JOIN base USING (point) WHERE r.amount > greatest(4000.0, 2.0 * baseline)),
  e AS (SELECT *, sum(CASE WHEN ahead IS NULL OR lo > ahead THEN 1 ELSE 0 END) OVER (PARTITION BY point ORDER BY t_us, row_id ROWS UNBOUNDED PRECEDING) AS episode FROM hot)
  SELECT point, CAST(episode AS BIGINT) AS episode, min(lo) AS start_us, max(t_us) AS end_us, CAST(max(amount) AS BIGINT) AS peak, count(*) AS rows FROM e GROUP BY point, episode""")
def microbursts(obs: DataFrame) -> DataFrame:
    return series.microbursts(obs, ["point"], "t_us", "len", "row_id", 600_000_000, 600_000_000, 2.0, 4000.0)


portable("burst_summary", """WITH b AS (SELECT point, CAST(floor(t_us / 600000000e0) AS BIGINT) AS bin, CAST(sum(len) AS BIGINT) AS amount FROM {obs} GROUP BY 1, 2), m AS (SELECT point, QUANTILE(amount, 0.5) AS med FROM b GROUP BY point)
  SELECT b.point, count(*) AS bins, count(*) FILTER (WHERE amount > 4 * med) AS bursts, max(amount) AS peak FROM b JOIN m ON m.point = b.point GROUP BY b.point""")
portable("burst_associations", """WITH l AS (SELECT a.flow, a.t_us FROM {obs} a WHERE hop = 0 AND NOT EXISTS (SELECT 1 FROM {obs} b WHERE b.packet_key = a.packet_key AND b.hop = 1)),
  e AS (SELECT flow, t_us, event_id FROM {ev} WHERE event_type = 'error') SELECT e.event_id, min(l.t_us - e.t_us) AS next_us, count(l.t_us) AS n FROM e LEFT JOIN l ON l.flow = e.flow AND l.t_us BETWEEN e.t_us AND e.t_us + 86400000000 GROUP BY e.event_id""")


@query("""WITH g AS (SELECT flow, least(t_us, 1706000000000000) - greatest(lag(t_us) OVER (PARTITION BY flow ORDER BY t_us), 1705000000000000) AS gap FROM ev)
  SELECT flow, max(greatest(gap, 0)) FILTER (gap IS NOT NULL) AS silence_us FROM g GROUP BY flow""")
def longest_silence(ev: DataFrame) -> DataFrame:
    rows = windows.longest_silence(ev, ["flow"], "t_us", F.lit(1705000000000000), F.lit(1706000000000000))
    return rows


portable("period_split", """WITH w AS (SELECT flow, QUANTILE(t_us, 0.3) AS a, QUANTILE(t_us, 0.6) AS b FROM {ev} GROUP BY flow)
  SELECT e.flow, CASE WHEN t_us < a THEN 'before' WHEN t_us < b THEN 'event' ELSE 'recovery' END AS period, count(*) AS n, round(QUANTILE(value, 0.95), 6) AS p95 FROM {ev} e JOIN w ON w.flow = e.flow GROUP BY 1, 2""")
portable("period_pivot", """WITH p AS (SELECT event_type, CASE WHEN k < 30 THEN 'before' WHEN k < 60 THEN 'event' ELSE 'recovery' END AS period, value FROM {ev})
  SELECT event_type, round(QUANTILE(CASE WHEN period = 'before' THEN value END, 0.95), 6) AS before, round(QUANTILE(CASE WHEN period = 'event' THEN value END, 0.95), 6) AS event,
    round(QUANTILE(CASE WHEN period = 'recovery' THEN value END, 0.95), 6) AS recovery FROM p GROUP BY event_type""")
portable("chronic_losses", """WITH l AS (SELECT a.direction, a.hop, CASE WHEN a.k < 30 THEN 0 WHEN a.k < 60 THEN 1 ELSE 2 END AS period, CASE WHEN b.row_id IS NULL THEN 1 ELSE 0 END AS lost FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop < 3 AND a.attempt = 0),
  r AS (SELECT direction, hop, period, 100e0 * sum(lost) / count(*) AS pct, sum(lost) AS lost FROM l GROUP BY 1, 2, 3)
  SELECT direction, hop, count(*) = 3 AND min(lost) > 0 AND max(pct) / nullif(min(pct), 0) <= 3 AND max(CASE WHEN period = 1 THEN pct END) <= 2.5 * min(CASE WHEN period <> 1 THEN pct END) AS chronic, round(CAST(max(pct) AS DOUBLE), 6) AS worst FROM r GROUP BY direction, hop""")


@query("""WITH d AS (SELECT flow, k, row_number() OVER (PARTITION BY flow ORDER BY t_us, event_id) AS rn, count(*) OVER (PARTITION BY flow) AS n FROM ev)
  SELECT flow, round(sum(k / 16.0::DOUBLE * pow(15 / 16.0::DOUBLE, n - rn)), 6) AS jitter FROM d GROUP BY flow""")
def jitter_ewma(ev: DataFrame) -> DataFrame:
    return windows.ewma(ev, ["flow"], ["t_us", "event_id"], "k", 1 / 16, "jitter").withColumn("jitter", F.round("jitter", 6))


portable("stream_gaps", """WITH s AS (SELECT flow, t_us, event_id, (event_id * 3) % 65536 AS sn FROM {ev}), d AS (SELECT *, max(sn) OVER (PARTITION BY flow ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s)
  SELECT flow, count(*) AS n, count(*) FILTER (WHERE sn > high + 3) AS gaps, count(*) FILTER (WHERE sn < high) AS late FROM d GROUP BY flow""")
