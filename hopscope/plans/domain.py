"""Queries on ranges, delivery, turns, lifecycles, heuristics, transactions, transport, media and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .registry import portable, query

_RANGES = """rg AS (SELECT flow, point, packet_key, len, seq AS lo, least(seq + len, 4294967296) AS hi FROM obs WHERE direction = 'forward'
    UNION ALL SELECT flow, point, packet_key, len, 0, seq + len - 4294967296 FROM obs WHERE direction = 'forward' AND seq + len > 4294967296),
  ed AS (SELECT flow, lo AS p FROM rg UNION SELECT flow, hi FROM rg), ce AS (SELECT flow, p AS lo, lead(p) OVER (PARTITION BY flow ORDER BY p) AS hi FROM ed),
  at AS (SELECT ce.flow, ce.lo, ce.hi, rg.point, rg.packet_key FROM ce JOIN rg ON rg.flow = ce.flow AND ce.lo >= rg.lo AND ce.hi <= rg.hi WHERE ce.hi IS NOT NULL)""".replace("at AS", "atom AS")


def _cut(obs: DataFrame) -> DataFrame:
    rows = obs.filter("direction = 'forward'")
    return ranges.atom_rows(ranges.intervals(rows, "seq", F.col("len"), ["flow", "point", "packet_key"]), ["flow"], ["point", "packet_key"])


@query(f"""WITH {_RANGES}, p AS (SELECT flow, lo, hi, bool_or(point = 0) AS h, bool_or(point = 3) AS t FROM atom GROUP BY ALL)
  SELECT flow, CAST(sum(hi - lo) AS BIGINT) AS bytes, CAST(sum(CASE WHEN t THEN hi - lo ELSE 0 END) AS BIGINT) AS seen, CAST(sum(CASE WHEN t THEN 0 ELSE hi - lo END) AS BIGINT) AS missing,
    CASE WHEN bool_and(t) THEN 'seen' WHEN bool_or(t) THEN 'unknown' ELSE 'missing' END AS state FROM p WHERE h GROUP BY flow""")
def range_coverage(obs: DataFrame) -> DataFrame:
    return ranges.coverage(_cut(obs), ["flow"], 0, 3)


@query(f"""WITH {_RANGES} SELECT flow, lo, hi, count(DISTINCT packet_key) AS copies FROM atom GROUP BY flow, lo, hi HAVING bool_or(point = 0) AND NOT bool_or(point = 3)""")
def missing_ranges(obs: DataFrame) -> DataFrame:
    found = _cut(obs).groupBy("flow", "lo", "hi").agg(F.countDistinct("packet_key").alias("copies"), F.bool_or(F.col("point") == 0).alias("h"), F.bool_or(F.col("point") == 3).alias("t"))
    return found.filter("h AND NOT t").select("flow", "lo", "hi", "copies")


@query(f"""WITH {_RANGES}, m AS (SELECT DISTINCT packet_key AS k, flow, lo, hi FROM atom a WHERE point = 0 AND NOT EXISTS (SELECT 1 FROM atom b WHERE b.point = 3 AND b.packet_key = a.packet_key AND b.lo = a.lo)),
  r AS (SELECT m.*, EXISTS (SELECT 1 FROM atom b WHERE b.point = 3 AND b.flow = m.flow AND b.lo = m.lo AND b.packet_key > m.k) AS again FROM m)
  SELECT k AS packet_key, count(*) AS atoms, CASE WHEN bool_and(again) THEN 'recovered' WHEN bool_or(again) THEN 'unknown' ELSE 'missing' END AS state FROM r GROUP BY k""")
def range_recoveries(obs: DataFrame) -> DataFrame:
    """A lost record is recovered only if each of its atoms was seen again in a later one."""
    cut = _cut(obs).checkpoint()
    there = cut.filter("point = 3").select("packet_key", "lo").distinct()
    gone = cut.filter("point = 0").select("packet_key", "flow", "lo", "hi").distinct().join(there, ["packet_key", "lo"], "left_anti")
    latest = cut.filter("point = 3").groupBy("flow", "lo").agg(F.max("packet_key").alias("latest"))
    rows = gone.join(latest, ["flow", "lo"], "left").withColumn("again", F.coalesce(F.col("latest") > F.col("packet_key"), F.lit(False)))
    state = F.when(F.bool_and("again"), "recovered").when(F.bool_or("again"), "unknown").otherwise("missing")
    return rows.groupBy("packet_key").agg(F.count(F.lit(1)).alias("atoms"), state.alias("state"))


portable("repeat_groups", """WITH g AS (SELECT point, flow, direction, seq, len, count(DISTINCT row_id) AS n FROM {obs} GROUP BY point, flow, direction, seq, len)
  SELECT point, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM g WHERE n > 1 GROUP BY point""")
portable("payload_conflicts", """SELECT DISTINCT a.flow FROM {obs} a JOIN {obs} b ON a.flow = b.flow AND a.point = b.point AND a.len = b.len AND a.seq = b.seq AND a.packet_key < b.packet_key""")
portable("range_ack_guard", """WITH p AS (SELECT event_id, flow, t_us FROM {obs} WHERE hop = 0 AND attempt = 0), r AS (SELECT event_id, min(t_us) AS retry_us FROM {obs} WHERE attempt = 1 AND hop = 0 GROUP BY event_id)
  SELECT p.event_id, min(k.t_us) AS ack_us FROM p JOIN {ev} k ON k.flow = p.flow AND k.event_type = 'view' AND k.t_us > p.t_us AND k.t_us <= p.t_us + 3600000000 LEFT JOIN r ON r.event_id = p.event_id
  WHERE r.retry_us IS NULL OR k.t_us < r.retry_us GROUP BY p.event_id""")
portable("delivery_series", """WITH d AS (SELECT a.direction, a.hop, CAST(floor(a.t_us / 3600000000e0) AS BIGINT) AS hour, CASE WHEN b.row_id IS NULL THEN 'dropped' WHEN b.t_us - a.t_us > 3000 THEN 'delayed' ELSE 'delivered' END AS fate
    FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop < 3)
  SELECT direction, hop, hour, count(*) FILTER (WHERE fate = 'delivered') AS delivered, count(*) FILTER (WHERE fate = 'delayed') AS delayed, count(*) FILTER (WHERE fate = 'dropped') AS dropped FROM d GROUP BY direction, hop, hour""")
portable("id_preservation", """WITH p AS (SELECT a.flow, a.hop, a.ttl - b.ttl AS step FROM {obs} a JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 AND b.direction = a.direction),
  m AS (SELECT flow, hop, min(step) AS usual FROM p GROUP BY flow, hop) SELECT p.hop, count(*) AS n, count(*) FILTER (WHERE step <> usual) AS odd FROM p JOIN m ON m.flow = p.flow AND m.hop = p.hop GROUP BY p.hop""")
portable("hold_release", """WITH c AS (SELECT flow, len, t_us, lag(t_us) OVER (PARTITION BY flow, len ORDER BY t_us, event_id, attempt) AS before FROM {obs} WHERE hop = 0),
  g AS (SELECT flow, len, count(*) AS copies, max(t_us) - min(t_us) AS span_us, min(t_us - before) AS least_gap_us FROM c GROUP BY flow, len) SELECT * FROM g WHERE copies BETWEEN 2 AND 8 AND span_us <= 600000000""")

_TURNS = """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY flow ORDER BY t_us, event_id) AS prev FROM {ev} WHERE event_type IN ('click', 'view')),
  i AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM l),
  b AS (SELECT flow, turn, min(event_type) AS side, min(t_us) AS first_us, max(t_us) AS last_us, min_by(event_id, t_us) AS first_id, count(*) AS n FROM i GROUP BY flow, turn),
  cyc AS (SELECT a.flow, CAST(a.turn AS BIGINT) AS turn, a.first_id, a.last_us AS request_us, r.first_us AS response_us, r.first_us - a.last_us AS wait_us, a.n AS requests, r.n AS responses FROM b a JOIN b r ON r.flow = a.flow AND r.turn = a.turn + 1 WHERE a.side = 'click')"""
portable("turn_cycles", _TURNS + " SELECT * FROM cyc")
portable("cycle_series", _TURNS + " SELECT CAST(floor(request_us / 86400000000e0) AS BIGINT) AS day, count(*) AS n, QUANTILE(wait_us, 0.5) AS p50_us, max(wait_us) AS max_us FROM cyc GROUP BY 1")
portable("top_cycles", _TURNS + " SELECT flow, turn, wait_us FROM cyc ORDER BY wait_us DESC, flow, turn LIMIT 20")
portable("cycle_added_time", _TURNS + ", m AS (SELECT flow, QUANTILE(wait_us, 0.5) AS usual, count(*) AS n FROM cyc GROUP BY flow HAVING count(*) >= 3) SELECT c.flow, c.turn, CASE WHEN wait_us - usual > 1000 THEN wait_us - usual END AS added_us, CASE WHEN wait_us - usual > 1000 THEN NULL ELSE 'within uncertainty' END AS reason FROM cyc c JOIN m ON m.flow = c.flow")
portable("cycle_findings", _TURNS + ", m AS (SELECT flow, QUANTILE(wait_us, 0.5) AS usual FROM cyc GROUP BY flow HAVING count(*) >= 3) SELECT c.flow, count(*) AS stalled, max(wait_us) AS worst_us FROM cyc c JOIN m ON m.flow = c.flow WHERE wait_us > 3 * usual AND wait_us >= 100000 GROUP BY c.flow HAVING count(*) >= 3")
portable("conversation_cycles", """WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations}), i AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM t)
  SELECT conv_id, CAST(burst AS BIGINT) AS burst, min(role) AS role, count(*) AS n, min(turn) AS first_turn FROM i GROUP BY conv_id, burst""")
portable("host_delay_shares", """WITH d AS (SELECT a.packet_key, a.direction, CAST(sum(CASE WHEN a.hop = 0 THEN b.t_us - a.t_us END) AS BIGINT) AS first_us, CAST(sum(b.t_us - a.t_us) AS BIGINT) AS all_us, count(*) AS hops FROM {obs} a JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 GROUP BY a.packet_key, a.direction)
  SELECT direction, count(*) AS n, round(100e0 * sum(first_us) / nullif(CAST(sum(all_us) AS DOUBLE), 0), 6) AS first_share FROM d WHERE hops = 3 GROUP BY direction""")
portable("incident_bars", """WITH d AS (SELECT a.packet_key, a.direction, a.hop, b.t_us - a.t_us AS d FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop < 3 AND a.attempt = 0)
  SELECT packet_key, CASE WHEN count(*) FILTER (WHERE d IS NULL) > 0 THEN NULL ELSE CAST(sum(d) AS BIGINT) END AS total_us, count(*) AS parts FROM d GROUP BY packet_key""")

_LIFE = """WITH s AS (SELECT event_id, flow, t_us FROM {ev} WHERE event_type = 'signup'), a AS (SELECT s.event_id, min(v.t_us) AS answer_us FROM s JOIN {ev} v ON v.flow = s.flow AND v.event_type = 'view' AND v.t_us > s.t_us AND v.t_us <= s.t_us + 43200000000 GROUP BY s.event_id),
  c AS (SELECT a.event_id, min(v.t_us) AS done_us FROM a JOIN s ON s.event_id = a.event_id JOIN {ev} v ON v.flow = s.flow AND v.event_type = 'click' AND v.t_us > a.answer_us AND v.t_us <= a.answer_us + 43200000000 GROUP BY a.event_id),
  f AS (SELECT s.*, a.answer_us, c.done_us FROM s LEFT JOIN a ON a.event_id = s.event_id LEFT JOIN c ON c.event_id = s.event_id)"""
portable("lifecycle_funnel", _LIFE + " SELECT CAST(floor(t_us / 86400000000e0) AS BIGINT) AS day, count(*) AS opened, count(answer_us) AS answered, count(done_us) AS completed, count(*) - count(done_us) AS half_open FROM f GROUP BY 1")
portable("half_open_buckets", _LIFE + ", h AS (SELECT UNNEST(SERIES(CAST(CAST(floor(t_us / 3600000000e0) AS BIGINT) AS BIGINT), CAST(CAST(floor(least(coalesce(done_us, t_us + 36000000000), t_us + 36000000000) / 3600000000e0) AS BIGINT) AS BIGINT))) AS hour FROM f) SELECT hour, count(*) AS half_open FROM h GROUP BY hour")
portable("syn_waves", _LIFE + ", b AS (SELECT CAST(CAST(floor(t_us / 21600000000e0) AS BIGINT) AS BIGINT) AS slot, count(*) AS opened, count(DISTINCT flow) AS sources, count(done_us) AS done FROM f GROUP BY 1), g AS (SELECT *, slot - row_number() OVER (ORDER BY slot) AS run FROM b WHERE opened >= 10 AND sources >= 5 AND done < 0.5 * opened) SELECT min(slot) AS first, max(slot) AS last, count(*) AS length FROM g GROUP BY run HAVING count(*) >= 3")
portable("scan_fanout", """WITH p AS (SELECT a.event_id, a.flow, b.k AS target, b.event_type FROM {ev} a JOIN {ev} b ON b.flow = a.flow AND b.t_us BETWEEN a.t_us - 172800000000 AND a.t_us)
  SELECT event_id, flow, count(DISTINCT target) AS targets, round(1e0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failed FROM p GROUP BY event_id, flow HAVING count(DISTINCT target) >= 8""")
portable("pressure_checks", """WITH d AS (SELECT CAST(CAST(floor(t_us / 86400000000e0) AS BIGINT) AS BIGINT) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM {ev} GROUP BY 1),
  base AS (SELECT QUANTILE(failed, 0.5) AS usual, count(*) AS days FROM d) SELECT day, n, failed, CASE WHEN days < 3 THEN NULL ELSE failed > 1.2 * usual END AS spike FROM d CROSS JOIN base""")
portable("reconnects", """WITH e AS (SELECT event_id, flow, t_us FROM {ev} WHERE event_type = 'error'), n AS (SELECT e.event_id, min(s.t_us) - min(e.t_us) AS after_us FROM e JOIN {ev} s ON s.flow = e.flow AND s.event_type = 'signup' AND s.t_us > e.t_us AND s.t_us <= e.t_us + 86400000000 GROUP BY e.event_id)
  SELECT e.event_id, e.flow, n.after_us FROM e LEFT JOIN n ON n.event_id = e.event_id""")
portable("reset_storms", """WITH r AS (SELECT event_id, flow, t_us, lag(t_us) OVER (ORDER BY t_us, event_id) AS before FROM {ev} WHERE event_type = 'error'), i AS (SELECT *, sum(CASE WHEN before IS NULL OR t_us - before > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS storm FROM r)
  SELECT min(t_us) AS start_us, count(*) AS resets, count(DISTINCT flow) AS flows FROM i GROUP BY storm HAVING count(DISTINCT flow) >= 2""")
portable("rate_drops", """WITH b AS (SELECT flow, CAST(CAST(floor(t_us / 86400000000e0) AS BIGINT) AS BIGINT) AS day, CAST(sum(k) AS BIGINT) AS amount FROM {ev} GROUP BY 1, 2), m AS (SELECT flow, QUANTILE(amount, 0.5) AS usual, count(*) AS n FROM b GROUP BY flow HAVING count(*) >= 12),
  l AS (SELECT b.flow, day, day - row_number() OVER (PARTITION BY b.flow ORDER BY day) AS run FROM b JOIN m ON m.flow = b.flow WHERE amount <= 0.6 * usual)
  SELECT flow, min(day) AS first, max(day) AS last, count(*) AS days FROM l GROUP BY flow, run HAVING count(*) >= 3""")
portable("session_summary", """SELECT flow, count(*) FILTER (WHERE event_type = 'signup') AS opened, count(*) FILTER (WHERE event_type = 'error') AS reset, max_by(event_type, t_us) AS ended_with, (max(t_us) - min(t_us)) AS span_us FROM {ev} GROUP BY flow""")

_PAIRS = """WITH q AS (SELECT event_id AS q, flow, k, t_us FROM {ev} WHERE event_type = 'click'), r AS (SELECT event_id AS r, flow, k, t_us FROM {ev} WHERE event_type = 'view'),
  c AS (SELECT q, r, q.flow, q.t_us AS asked_us, r.t_us - q.t_us AS wait_us FROM q JOIN r ON r.flow = q.flow AND r.t_us > q.t_us AND r.t_us <= q.t_us + 21600000000),
  u AS (SELECT *, count(*) OVER (PARTITION BY q) AS nq, count(*) OVER (PARTITION BY r) AS nr FROM c), p AS (SELECT q, r, flow, asked_us, wait_us FROM u WHERE nq = 1 AND nr = 1)"""
portable("request_response_pairs", _PAIRS + " SELECT * FROM p")
portable("transaction_summary", _PAIRS + ", o AS (SELECT q.flow, CASE WHEN p.r IS NOT NULL THEN 'answered' WHEN c.q IS NOT NULL THEN 'unknown' ELSE 'timed out' END AS outcome, p.wait_us FROM q LEFT JOIN p ON p.q = q.q LEFT JOIN (SELECT DISTINCT q FROM c) c ON c.q = q.q) SELECT flow, outcome, count(*) AS n, QUANTILE(wait_us, 0.5) AS p50_us, max(wait_us) AS max_us FROM o GROUP BY flow, outcome")
portable("message_ambiguity", _PAIRS + " SELECT q, count(*) AS candidates, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unique' END AS state FROM c GROUP BY q")
portable("disappeared", """SELECT a.event_id, CASE WHEN b.row_id IS NOT NULL AND d.row_id IS NULL THEN 'response disappeared' WHEN b.row_id IS NULL THEN 'query disappeared' ELSE 'answered' END AS outcome FROM (SELECT * FROM {obs} WHERE hop = 0 AND attempt = 0) a
  LEFT JOIN (SELECT * FROM {obs} WHERE hop = 2 AND attempt = 0) b ON b.event_id = a.event_id LEFT JOIN (SELECT * FROM {obs} WHERE hop = 3 AND attempt = 0) d ON d.event_id = a.event_id""")
portable("retry_kinds", """WITH o AS (SELECT event_id, flow, t_us FROM {obs} WHERE hop = 0 AND attempt = 0), y AS (SELECT event_id, t_us FROM {obs} WHERE hop = 0 AND attempt = 1), s AS (SELECT DISTINCT event_id FROM {obs} WHERE hop = 3 AND attempt = 0)
  SELECT y.event_id, y.t_us - o.t_us AS after_us, CASE WHEN s.event_id IS NOT NULL THEN 'spurious' WHEN y.t_us - o.t_us < 240000 THEN 'fast' WHEN y.t_us - o.t_us >= 300000 THEN 'timeout' ELSE 'unknown' END AS kind FROM y JOIN o ON o.event_id = y.event_id LEFT JOIN s ON s.event_id = y.event_id""")
portable("prior_rtt", """SELECT a.row_id, count(b.row_id) AS n, round(QUANTILE(b.k, 0.5), 6) AS median_k, round(stddev_pop(b.k), 6) AS sd_k FROM (SELECT * FROM {obs} WHERE attempt = 1 AND hop = 0) a LEFT JOIN {obs} b ON b.flow = a.flow AND b.hop = 0 AND b.t_us < a.t_us AND b.t_us >= a.t_us - 86400000000 GROUP BY a.row_id""")
portable("rtt_degradation", """WITH h AS (SELECT flow, QUANTILE(t_us, 0.25) AS a, QUANTILE(t_us, 0.75) AS b FROM {ev} GROUP BY flow) SELECT e.flow, round(QUANTILE(CASE WHEN t_us <= a THEN value END, 0.5), 6) AS early, round(QUANTILE(CASE WHEN t_us >= b THEN value END, 0.5), 6) AS late FROM {ev} e JOIN h ON h.flow = e.flow GROUP BY e.flow""")
portable("limitation_class", """WITH m AS (SELECT flow, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, avg(k) AS mean_k, max(k) AS max_k FROM {ev} GROUP BY flow)
  SELECT flow, CASE WHEN n < 8 THEN 'unknown' WHEN mean_k > 55 THEN 'receiver' WHEN errors > 0.25 * n THEN 'network' WHEN max_k < 97 THEN 'application' ELSE 'unknown' END AS limited_by FROM m""")
portable("ack_proof", """SELECT p.event_id, min(c.t_us - p.t_us) AS proof_us FROM (SELECT * FROM {obs} WHERE hop = 0 AND attempt = 0 AND direction = 'forward') p JOIN (SELECT * FROM {obs} WHERE hop = 0 AND direction = 'reverse') c
  ON c.flow = p.flow AND c.t_us > p.t_us AND c.t_us <= p.t_us + 600000000 WHERE ((c.seq - p.seq) % 4294967296 + 4294967296) % 4294967296 < 2147483648 GROUP BY p.event_id""")
portable("reply_proof", """SELECT q.event_id, min(r.event_id) AS reply FROM {ev} q JOIN {ev} r ON r.flow = q.flow AND r.k = q.k AND r.event_type = 'view' AND r.t_us > q.t_us AND r.t_us <= q.t_us + 864000000000 WHERE q.event_type = 'click'
  AND NOT EXISTS (SELECT 1 FROM {ev} x WHERE x.flow = q.flow AND x.k = q.k AND x.event_type = 'click' AND x.event_id <> q.event_id) GROUP BY q.event_id""")
portable("reset_proof", """WITH a AS (SELECT flow, count(*) AS n FROM {obs} WHERE hop = 0 AND flags = 4 GROUP BY flow), b AS (SELECT flow, count(*) AS n FROM {obs} WHERE hop = 3 AND flags = 4 GROUP BY flow) SELECT a.flow, a.n AS sent, coalesce(b.n, 0) AS arrived, a.n = coalesce(b.n, 0) AS complete FROM a LEFT JOIN b ON b.flow = a.flow""")
portable("failure_after", """SELECT o.event_id, min(e.t_us - o.t_us) AS failure_us, min_by(e.event_type, e.t_us) AS failure FROM (SELECT * FROM {obs} WHERE hop = 0 AND attempt = 0) o JOIN {ev} e ON e.flow = o.flow AND e.t_us > o.t_us AND e.t_us <= o.t_us + 7200000000 AND (e.event_type = 'error' OR e.k > 90) GROUP BY o.event_id""")

portable("field_changes", """WITH p AS (SELECT a.packet_key, a.direction, a.hop, a.ttl - b.ttl AS ttl_step, a.dscp AS dscp_a, b.dscp AS dscp_b FROM {obs} a JOIN {obs} b ON b.packet_key = a.packet_key AND b.direction = a.direction AND b.hop = a.hop + 1)
  SELECT direction, hop, count(*) AS n, count(*) FILTER (WHERE dscp_a <> dscp_b) AS remarked, count(*) FILTER (WHERE ttl_step <> 1) AS odd_ttl, min(CASE WHEN dscp_a <> dscp_b THEN packet_key END) AS example FROM p GROUP BY direction, hop""")


@query("""WITH p AS (SELECT a.packet_key, a.hop, a.ttl AS ta, b.ttl AS tb, a.dscp AS da, b.dscp AS db, a.len AS la, b.len AS lb FROM obs a JOIN obs b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1)
  SELECT packet_key, hop, field, before, after FROM (SELECT packet_key, hop, 'ttl' AS field, ta AS before, tb AS after FROM p UNION ALL SELECT packet_key, hop, 'dscp', da, db FROM p UNION ALL SELECT packet_key, hop, 'len', la, lb FROM p) WHERE before <> after""")
def field_diff(obs: DataFrame) -> DataFrame:
    """Field by field, what differs between neighbouring appearances."""
    rows = obs.selectExpr("packet_key", "hop", "stack(3, 'ttl', CAST(ttl AS BIGINT), 'dscp', CAST(dscp AS BIGINT), 'len', len) AS (field, value)")
    after = rows.select("packet_key", (F.col("hop") - 1).alias("hop"), "field", F.col("value").alias("after"))
    return rows.withColumnRenamed("value", "before").join(after, ["packet_key", "hop", "field"]).filter("before <> after")


portable("payload_changes", """WITH a AS (SELECT flow, len, packet_key, t_us, count(*) OVER (PARTITION BY flow, len) AS n FROM {obs} WHERE hop = 1), b AS (SELECT flow, len, packet_key, t_us, count(*) OVER (PARTITION BY flow, len) AS n FROM {obs} WHERE hop = 2)
  SELECT a.flow, a.packet_key, b.packet_key AS changed_key FROM a JOIN b ON b.flow = a.flow AND b.len = a.len AND a.n = 1 AND b.n = 1 WHERE a.packet_key <> b.packet_key""")
portable("downstream_only", """SELECT packet_key, min(hop) AS first_hop, min(t_us) AS first_us FROM {obs} b WHERE hop > 0 AND NOT EXISTS (SELECT 1 FROM {obs} a WHERE a.packet_key = b.packet_key AND a.hop < b.hop) GROUP BY packet_key""")
portable("size_blackhole", """WITH o AS (SELECT a.flow, a.len, b.row_id IS NULL AS lost FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = 3 WHERE a.hop = 0) SELECT flow, count(*) FILTER (WHERE lost AND len > 1000) AS large_lost, count(*) FILTER (WHERE NOT lost AND len < 500) AS small_passed FROM o GROUP BY flow HAVING count(*) FILTER (WHERE lost AND len > 1000) >= 2 AND count(*) FILTER (WHERE NOT lost AND len < 500) >= 3""")
portable("duplicate_pairs", """SELECT row_id, CASE WHEN ttl = before_ttl THEN 'identical' ELSE 'loop' END AS kind FROM (SELECT row_id, ttl, lag(ttl) OVER w AS before_ttl, t_us - lag(t_us) OVER w AS gap FROM {obs} WINDOW w AS (PARTITION BY event_id, point ORDER BY t_us, row_id)) WHERE gap BETWEEN 0 AND 300000""")
portable("asymmetric_paths", """WITH p AS (SELECT flow, count(DISTINCT CASE WHEN direction = 'forward' THEN point END) AS f, count(DISTINCT CASE WHEN direction = 'reverse' THEN point END) AS r FROM {obs} GROUP BY flow) SELECT flow, f, r FROM p WHERE f <> r""")
portable("reset_origins", """SELECT event_id, min_by(point, t_us) AS origin, CASE WHEN count(*) = 4 THEN 'propagated' WHEN count(*) = 1 THEN 'unknown' ELSE 'originated' END AS kind FROM {obs} WHERE flags = 4 AND attempt = 0 GROUP BY event_id""")
portable("downstream_grouping", """WITH m AS (SELECT event_id, hop, t_us FROM {obs} a WHERE attempt = 0 AND hop < 3 AND NOT EXISTS (SELECT 1 FROM {obs} b WHERE b.packet_key = a.packet_key AND b.hop = a.hop + 1)) SELECT hop, count(*) AS n, min(event_id) AS first_event, count(DISTINCT CAST(floor(t_us / 86400000000e0) AS BIGINT)) AS days FROM m GROUP BY hop""")
portable("fragment_groups", """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS size, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi FROM {lineitem}),
  g AS (SELECT k, n, hi - size + CASE WHEN p % 17 = 0 THEN 1 ELSE 0 END AS lo, hi, lag(hi) OVER (PARTITION BY k ORDER BY n, p, size) AS before FROM f) SELECT k, count(*) AS parts, max(hi) AS bytes, CASE WHEN count(*) FILTER (WHERE before IS NOT NULL AND lo > before) > 0 THEN 'incomplete' WHEN count(*) <> max(n) THEN 'unknown' ELSE 'complete' END AS status FROM g GROUP BY k""")
portable("equal_length_translation", """WITH d AS (SELECT a.flow, ((b.seq - a.seq) % 4294967296 + 4294967296) % 4294967296 AS delta FROM {obs} a JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop = 0) SELECT flow, count(*) AS samples, CASE WHEN min(delta) = max(delta) AND count(*) >= 3 THEN min(delta) END AS offset_seq, CASE WHEN min(delta) <> max(delta) THEN 'inconsistent' WHEN count(*) < 3 THEN 'too few samples' END AS reason FROM d GROUP BY flow""")
portable("taint_flows", """SELECT DISTINCT flow, max(CASE WHEN len < 45 THEN 'short record' END) OVER (PARTITION BY flow) AS taint FROM {obs}""")
portable("reciprocal_ids", """WITH s AS (SELECT s_suppkey AS a, s_nationkey AS b FROM {supplier}), p AS (SELECT x.a, x.b, y.a AS c FROM s x JOIN s y ON x.a = y.b AND x.b = y.a) SELECT a, b, c, count(*) OVER (PARTITION BY a) AS uses FROM p""")
portable("next_certificate", """WITH s AS (SELECT event_id, flow, t_us, lead(t_us) OVER (PARTITION BY flow ORDER BY t_us, event_id) AS until_us FROM {ev} WHERE event_type = 'signup') SELECT s.event_id, min_by(v.event_id, v.t_us) AS answer FROM s LEFT JOIN {ev} v ON v.flow = s.flow AND v.event_type = 'view' AND v.t_us > s.t_us AND (s.until_us IS NULL OR v.t_us < s.until_us) GROUP BY s.event_id""")
portable("sequence_of_parts", """WITH o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) AS n, l_linenumber AS ln FROM {lineitem}) SELECT k, count(*) AS parts, min(ln) AS first_line, bool_and(n = ln) AS in_order FROM o GROUP BY k""")
portable("completion_time", """WITH o AS (SELECT l_orderkey AS k, l_shipdate, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}), t AS (SELECT k, CAST(sum(q) AS BIGINT) AS total, max(l_shipdate) AS last FROM o GROUP BY k) SELECT k, total, last FROM t WHERE total > 100""")
portable("evidence_rows", """WITH keys AS (SELECT event_id FROM {ev} WHERE event_type = 'error' ORDER BY event_id LIMIT 50) SELECT o.event_id, o.point, o.row_id, o.t_us FROM {obs} o JOIN keys ON keys.event_id = o.event_id""")
portable("flow_filters", """SELECT flow, concat('flow == ', CAST(flow AS STRING), ' && len >= ', CAST(min(len) AS STRING)) AS filter FROM {obs} GROUP BY flow""")
portable("topology_overlay", """SELECT point, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes, count(DISTINCT flow) AS flows FROM {obs} WHERE t_us >= 1704800000000000 AND t_us < 1705800000000000 GROUP BY point""")
portable("path_order", """WITH p AS (SELECT a.point AS p, b.point AS q, QUANTILE(a.ttl - b.ttl, 0.5) AS step FROM {obs} a JOIN {obs} b ON a.packet_key = b.packet_key AND a.direction = 'forward' AND b.direction = 'forward' AND a.point <> b.point GROUP BY 1, 2) SELECT p, count(*) FILTER (WHERE step > 0) AS wins, count(*) FILTER (WHERE step = 0) AS ties FROM p GROUP BY p""")
portable("client_degree", """SELECT concat('c', CAST(flow % 50 AS STRING)) AS host, count(DISTINCT k) AS peers, count(*) FILTER (WHERE event_type = 'signup') AS opened FROM {ev} GROUP BY 1""")
portable("mismatch_split", """WITH o AS (SELECT a.hop, CAST(floor(a.t_us / 86400000000e0) AS BIGINT) AS day, b.row_id IS NULL AS gone, a.len > 1400 AS large FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop < 3)
  SELECT hop, day, count(*) AS n, count(*) FILTER (WHERE gone) AS missed, least(count(*) FILTER (WHERE large), count(*) FILTER (WHERE gone)) AS offload, count(*) FILTER (WHERE gone) - least(count(*) FILTER (WHERE large), count(*) FILTER (WHERE gone)) AS other FROM o GROUP BY hop, day""")
