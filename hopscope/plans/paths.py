"""Queries on matching, joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..operators import joins, matching, windows
from .registry import portable, query

portable("path_obs_counts", "SELECT direction, hop, attempt, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM {obs} GROUP BY direction, hop, attempt")

MATCHES = """m AS (SELECT a.packet_key, a.flow, a.direction, a.hop, a.t_us AS t_a, b.t_us AS t_b, a.len, b.t_us - a.t_us AS transit_us
  FROM obs a JOIN obs b ON a.packet_key = b.packet_key AND a.direction = b.direction AND b.hop = a.hop + 1)"""
LOSSES = """seen AS (SELECT * FROM obs WHERE attempt = 0), gone AS (SELECT s.* FROM seen s WHERE hop < 3 AND NOT EXISTS (
    SELECT 1 FROM seen n WHERE n.packet_key = s.packet_key AND n.hop = s.hop + 1)),
  rec AS (SELECT g.event_id, g.hop, min(c.t_us - g.t_us) AS recovery_us, count(*) AS attempts FROM gone g JOIN obs c ON c.event_id = g.event_id
    AND c.attempt > 0 AND c.hop = g.hop + 1 AND c.t_us > g.t_us AND c.t_us <= g.t_us + 60000000 GROUP BY ALL),
  loss AS (SELECT g.*, r.recovery_us, r.attempts, EXISTS (SELECT 1 FROM seen n WHERE n.packet_key = g.packet_key AND n.hop > g.hop) AS later_seen
    FROM gone g LEFT JOIN rec r ON r.event_id = g.event_id AND r.hop = g.hop),
  kinds AS (SELECT *, CASE WHEN later_seen THEN 'capture_miss' WHEN recovery_us < 200000 AND attempts = 1 THEN 'recovered'
    WHEN recovery_us IS NOT NULL THEN 'impactful' ELSE 'unrecovered' END AS kind FROM loss)"""


@query(f"""WITH {MATCHES} SELECT direction, hop, count(*) AS matched, min(transit_us) AS min_us, quantile_cont(transit_us, 0.05) AS p05_us, quantile_cont(transit_us, 0.5) AS p50_us,
  quantile_cont(transit_us, 0.95) AS p95_us, max(transit_us) AS max_us, count(*) FILTER (transit_us < 0) AS negative FROM m GROUP BY direction, hop""")
def segment_latency(obs: DataFrame) -> DataFrame:
    return matching.latency_stats(matching.hop_matches(obs), "direction", "hop")


@query(f"""WITH {MATCHES}, {LOSSES}, l AS (SELECT direction, hop, count(*) AS matched, min(transit_us) AS min_us, quantile_cont(transit_us, 0.05) AS p05_us,
    quantile_cont(transit_us, 0.5) AS p50_us, quantile_cont(transit_us, 0.95) AS p95_us, max(transit_us) AS max_us, count(*) FILTER (transit_us < 0) AS negative
    FROM m GROUP BY direction, hop),
  k AS (SELECT direction, hop, count(*) FILTER (kind = 'capture_miss') AS capture_miss, count(*) FILTER (kind = 'recovered') AS recovered,
    count(*) FILTER (kind = 'impactful') AS impactful, count(*) FILTER (kind = 'unrecovered') AS unrecovered FROM kinds GROUP BY direction, hop)
  SELECT direction, hop, coalesce(matched, 0) AS matched, min_us, p05_us, p50_us, p95_us, max_us, negative, coalesce(capture_miss, 0) AS capture_miss, coalesce(recovered, 0) AS recovered,
    coalesce(impactful, 0) AS impactful, coalesce(unrecovered, 0) AS unrecovered, round(100.0::DOUBLE * (coalesce(recovered, 0) + coalesce(impactful, 0) + coalesce(unrecovered, 0))
      / (coalesce(matched, 0) + coalesce(recovered, 0) + coalesce(impactful, 0) + coalesce(unrecovered, 0)), 6) AS loss_percent, CAST(NULL AS VARCHAR) AS reason
  FROM l FULL JOIN k USING (direction, hop)""")
def segment_loss_classes(obs: DataFrame) -> DataFrame:
    return matching.segment_report(obs)


@query("""SELECT a.row_id, a.flow, a.t_us, b.row_id AS r_row_id, b.t_us AS r_t_us FROM (SELECT * FROM obs WHERE hop = 1) a
  ASOF LEFT JOIN (SELECT flow, t_us, max(row_id) AS row_id FROM obs WHERE hop = 0 GROUP BY flow, t_us) b ON a.flow = b.flow AND a.t_us >= b.t_us""")
def asof_backward(obs: DataFrame) -> DataFrame:
    left = obs.filter("hop = 1").select("row_id", "flow", "t_us")
    return joins.asof(left, obs.filter("hop = 0"), ["flow"], "t_us", ["row_id"])


@query("""SELECT a.row_id, a.flow, a.t_us, b.row_id AS r_row_id, b.t_us AS r_t_us FROM (SELECT * FROM obs WHERE hop = 1) a
  ASOF LEFT JOIN (SELECT flow, t_us, max(row_id) AS row_id FROM obs WHERE hop = 2 GROUP BY flow, t_us) b ON a.flow = b.flow AND a.t_us <= b.t_us""")
def asof_forward(obs: DataFrame) -> DataFrame:
    left = obs.filter("hop = 1").select("row_id", "flow", "t_us")
    return joins.asof(left, obs.filter("hop = 2"), ["flow"], "t_us", ["row_id"], forward=True)


_NEAR = """a AS (SELECT row_id, flow, t_us FROM obs WHERE hop = 1), b AS (SELECT flow, t_us, max(row_id) AS row_id FROM obs WHERE hop = 3 GROUP BY flow, t_us),
  bk AS (SELECT a.*, b.row_id AS br, a.t_us - b.t_us AS bg FROM a ASOF LEFT JOIN b ON a.flow = b.flow AND a.t_us >= b.t_us),
  fw AS (SELECT a.row_id, b.row_id AS fr, b.t_us - a.t_us AS fg FROM a ASOF LEFT JOIN b ON a.flow = b.flow AND a.t_us <= b.t_us),
  n AS (SELECT bk.row_id, flow, t_us, CASE WHEN bg IS NOT NULL AND (fg IS NULL OR bg <= fg) THEN br ELSE fr END AS near_row_id,
    CASE WHEN bg IS NOT NULL AND (fg IS NULL OR bg <= fg) THEN bg ELSE fg END AS gap FROM bk JOIN fw USING (row_id)),
  w AS (SELECT * FROM n WHERE gap <= 2000000)"""


@query(f"""WITH {_NEAR} SELECT row_id, flow, t_us, near_row_id, gap FROM w QUALIFY row_number() OVER (PARTITION BY near_row_id ORDER BY gap, row_id) = 1""")
def nearest_one_to_one(obs: DataFrame) -> DataFrame:
    left = obs.filter("hop = 1").select("row_id", "flow", "t_us")
    near = joins.nearest(left, obs.filter("hop = 3"), ["flow"], "t_us", "row_id", 2_000_000).filter("near_row_id IS NOT NULL")
    return joins.one_to_one(near, "row_id", "near_row_id", "gap")


@query("""WITH a AS (SELECT flow, len, t_us, row_id, row_number() OVER (PARTITION BY flow, len ORDER BY t_us, row_id) AS n, count(*) OVER (PARTITION BY flow, len) AS c FROM obs WHERE hop = 0),
  b AS (SELECT flow, len, t_us, row_id, row_number() OVER (PARTITION BY flow, len ORDER BY t_us, row_id) AS n, count(*) OVER (PARTITION BY flow, len) AS c FROM obs WHERE hop = 1)
  SELECT a.flow, a.len, a.t_us AS a_t_us, a.row_id AS a_row_id, b.t_us AS b_t_us, b.row_id AS b_row_id FROM a JOIN b ON a.flow = b.flow AND a.len = b.len AND a.n = b.n AND a.c = b.c
  QUALIFY bool_and(abs(a.t_us - b.t_us) <= 2000000) OVER (PARTITION BY a.flow, a.len)""")
def balanced_rank_match(obs: DataFrame) -> DataFrame:
    return joins.balanced(obs.filter("hop = 0"), obs.filter("hop = 1"), ["flow", "len"], "t_us", "row_id", 2_000_000)


@query("""WITH d AS (SELECT *, md5(concat_ws('|', CAST(flow AS VARCHAR), CAST(len AS VARCHAR))) AS base_key FROM obs),
  g AS (SELECT *, coalesce(t_us - lag(t_us) OVER (PARTITION BY point, base_key ORDER BY t_us, row_id) BETWEEN 0 AND 20, false) AS dup FROM d)
  SELECT row_id, point, NOT dup AS eligible, row_number() OVER (PARTITION BY point, base_key, dup ORDER BY t_us, row_id) AS occurrence,
    NOT dup AND count(*) OVER (PARTITION BY point, base_key, dup) = 1 AS calibration FROM g""")
def occurrence_index(obs: DataFrame) -> DataFrame:
    rows = matching.prepare_occurrences(obs, ["flow", "len"], "t_us", "row_id")
    return rows.select("row_id", "point", "eligible", "occurrence", "calibration")


@query()
def occurrence_match(obs: DataFrame) -> DataFrame:
    """Balanced pairing, else nearest, else collision; held against its rules by tests."""
    rows = matching.prepare_occurrences(obs.select("point", "row_id", "flow", "direction", "len", "t_us"), ["flow", "direction", "len"], "t_us", "row_id")
    return matching.match_occurrences(rows, 1, "t_us", "row_id", 2_000_000).select("point", "row_id", "packet_key", "eligible", "excluded_reason")


portable("semi_scope", """WITH keep AS (SELECT flow FROM {obs} GROUP BY flow HAVING count(DISTINCT point) >= 2 AND bool_or(flags = 2))
  SELECT row_id, flow, point FROM {obs} WHERE flow IN (SELECT flow FROM keep)""")
portable("anti_missing", "SELECT row_id, packet_key, hop FROM {obs} a WHERE hop < 3 AND NOT EXISTS (SELECT 1 FROM {obs} b WHERE b.packet_key = a.packet_key AND b.hop = a.hop + 1)")
portable("overlap_guard", "SELECT event_id, attempt, point, count(*) AS n FROM {obs} GROUP BY event_id, attempt, point HAVING count(*) > 1")


@query(f"WITH {LOSSES} SELECT event_id, hop, direction, later_seen, recovery_us, attempts, kind FROM kinds")
def range_recovery_60s(obs: DataFrame) -> DataFrame:
    return matching.classify_losses(obs).select("event_id", "hop", "direction", "later_seen", "recovery_us", "attempts", "kind")


@query("""WITH q AS (SELECT event_id AS q, flow, t_us AS tq FROM ev WHERE event_type = 'click'), r AS (SELECT event_id AS r, flow, t_us AS tr FROM ev WHERE event_type = 'purchase'),
  p AS (SELECT q, r, flow, tr - tq AS wait_us FROM q JOIN r USING (flow) WHERE tr > tq AND tr <= tq + 7200000000)
  SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY q) = 1 AND count(*) OVER (PARTITION BY r) = 1""")
def unique_owner_pairs(ev: DataFrame) -> DataFrame:
    q = ev.filter("event_type = 'click'").select(F.col("event_id").alias("q"), "flow", F.col("t_us").alias("tq"))
    r = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("r"), "flow", F.col("t_us").alias("tr"))
    pairs = q.join(r, "flow").filter("tr > tq AND tr <= tq + 7200000000").select("q", "r", "flow", (F.col("tr") - F.col("tq")).alias("wait_us"))
    return joins.unique_owner(pairs, "q", "r")


@query("""SELECT a.event_id, a.flow, a.t_us, count(DISTINCT b.event_type) AS targets FROM ev a JOIN ev b ON a.flow = b.flow AND b.t_us BETWEEN a.t_us - 21600000000 AND a.t_us
  GROUP BY ALL HAVING count(DISTINCT b.event_type) >= 3""")
def rolling_fanout(ev: DataFrame) -> DataFrame:
    found = joins.rolling_distinct(ev, "flow", "t_us", "event_type", 21_600_000_000)
    return found.filter("targets >= 3").select("event_id", "flow", "t_us", "targets")


@query("""WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
  r AS (SELECT k, p % 3 AS side, coalesce(sum(q) OVER w - q, 0) AS lo, sum(q) OVER w AS hi FROM li WINDOW w AS (PARTITION BY k, p % 3 ORDER BY n, p, q ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT k, lo AS p FROM r UNION SELECT k, hi FROM r), a AS (SELECT k, p AS lo, lead(p) OVER (PARTITION BY k ORDER BY p) AS hi FROM e)
  SELECT a.k, CAST(a.lo AS BIGINT) AS lo, CAST(a.hi AS BIGINT) AS hi, count(DISTINCT r.side) AS sides FROM a JOIN r ON r.k = a.k AND a.lo >= r.lo AND a.hi <= r.hi WHERE a.hi IS NOT NULL GROUP BY ALL""")
def interval_atoms(lineitem: DataFrame) -> DataFrame:
    """Elementary intervals between all edges of an order's running quantities, and how many sides cover each."""
    rows = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    rows = rows.withColumn("side", F.col("p") % 3)
    total = F.sum("q").over(Window.partitionBy("k", "side").orderBy("n", "p", "q").rowsBetween(Window.unboundedPreceding, 0))
    ranges = rows.select("k", "side", (total - F.col("q")).alias("r_lo"), total.alias("r_hi"))
    edges = ranges.select("k", F.col("r_lo").alias("lo")).union(ranges.select("k", "r_hi")).distinct()
    atoms = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy("k").orderBy("lo"))).filter("hi IS NOT NULL")
    inside = joins.interval_join(atoms, ranges, ["k"], "r_lo", "r_hi", 64, "lo", "hi")
    return inside.groupBy("k", "lo", "hi").agg(F.countDistinct("side").alias("sides"))


portable("carried_state_grid", """WITH s AS (SELECT flow, min(t_us) AS t0, max(t_us) AS t1 FROM {ev} GROUP BY flow),
  o AS (SELECT min(t0) AS base FROM s),
  d AS (SELECT flow, UNNEST(SERIES(CAST(CAST(floor((t0 - base) / 86400000000e0) AS BIGINT) AS BIGINT), CAST(CAST(floor((t1 - base) / 86400000000e0) AS BIGINT) AS BIGINT))) AS day FROM s CROSS JOIN o)
  SELECT day, count(*) AS open_flows FROM d GROUP BY day""")


portable("first_cover_lateral", """WITH d AS (SELECT flow, row_id, t_us, seq + len AS seq_end FROM {obs} WHERE hop = 0 AND direction = 'forward'),
  c AS (SELECT d.row_id, min(a.row_id) AS cover_row, min(a.t_us - d.t_us) AS cover_us FROM d
    JOIN {obs} a ON a.flow = d.flow AND a.direction = 'reverse' AND a.hop = 3 AND a.seq >= d.seq_end AND a.t_us > d.t_us AND a.t_us <= d.t_us + 86400000000 GROUP BY d.row_id)
  SELECT d.row_id, d.flow, c.cover_row, c.cover_us FROM d LEFT JOIN c ON c.row_id = d.row_id""")


@query("""WITH d AS (SELECT row_id, flow, t_us, seq, seq + len AS seq_end FROM obs WHERE hop = 0 AND direction = 'forward'), k AS (SELECT flow, t_us, max(seq) AS ack FROM obs WHERE hop = 3 AND direction = 'reverse' GROUP BY ALL)
  SELECT d.row_id, d.flow, d.seq_end - k.ack AS in_flight FROM d ASOF LEFT JOIN k ON d.flow = k.flow AND d.t_us >= k.t_us""")
def window_flight(obs: DataFrame) -> DataFrame:
    """Data beyond the latest acknowledgement seen before it."""
    data = obs.filter("hop = 0 AND direction = 'forward'").select("row_id", "flow", "t_us", (F.col("seq") + F.col("len")).alias("seq_end"))
    acks = obs.filter("hop = 3 AND direction = 'reverse'").select("flow", "t_us", F.col("seq").alias("ack"))
    return joins.asof(data, acks, ["flow"], "t_us", ["ack"]).select("row_id", "flow", (F.col("seq_end") - F.col("r_ack")).alias("in_flight"))


@query("""WITH d AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY point, flow ORDER BY t_us, row_id) AS gap FROM obs) SELECT row_id, coalesce(gap BETWEEN 0 AND 60000000, false) AS duplicate FROM d""")
def near_duplicate_gap(obs: DataFrame) -> DataFrame:
    return windows.near_duplicates(obs, ["point", "flow"], "t_us", "row_id", 60_000_000).select("row_id", "duplicate")


portable("unique_calibration", "SELECT point, count(*) AS unique_keys FROM (SELECT point, flow, len FROM {obs} GROUP BY point, flow, len HAVING count(*) = 1) GROUP BY point")
portable("unique_window", "SELECT row_id, point FROM (SELECT row_id, point, count(*) OVER (PARTITION BY point, flow, len) AS n FROM {obs}) WHERE n = 1")


@query("""WITH l AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY flow ORDER BY t_us, event_id)),
  i AS (SELECT *, sum(CASE WHEN n = 1 OR event_type IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM l)
  SELECT flow, CAST(turn AS BIGINT) AS turn, min(event_type) AS event_type, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM i GROUP BY flow, turn""")
def direction_islands(ev: DataFrame) -> DataFrame:
    order = ["t_us", "event_id"]
    turns = windows.islands(ev, ["flow"], order, windows.changed("event_type", ["flow"], order), "turn")
    return turns.groupBy("flow", "turn").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("""WITH l AS (SELECT *, coalesce(t_us - lag(t_us) OVER (PARTITION BY flow ORDER BY t_us, event_id) > 43200000000, true) AS s FROM ev),
  i AS (SELECT *, sum(CAST(s AS BIGINT)) OVER (PARTITION BY flow ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM l)
  SELECT flow, CAST(episode AS BIGINT) AS episode, count(*) AS n, max(t_us) - min(t_us) AS span_us FROM i GROUP BY flow, episode""")
def gap_episodes(ev: DataFrame) -> DataFrame:
    order = ["t_us", "event_id"]
    rows = windows.islands(ev, ["flow"], order, windows.gap_over("t_us", ["flow"], order, 43_200_000_000), "episode")
    return rows.groupBy("flow", "episode").agg(F.count(F.lit(1)).alias("n"), (F.max("t_us") - F.min("t_us")).alias("span_us"))


@query("""WITH b AS (SELECT flow, t_us // 86400000000 AS day, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 2),
  r AS (SELECT *, day - row_number() OVER (PARTITION BY flow ORDER BY day) AS g FROM b)
  SELECT flow, min(day) AS first, max(day) AS last, count(*) AS length FROM r GROUP BY flow, g HAVING count(*) >= 3""")
def bucket_runs(ev: DataFrame) -> DataFrame:
    days = ev.groupBy("flow", F.floor(F.col("t_us") / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return windows.runs(days.select("flow", "day"), ["flow"], "day", 3)


@query("""SELECT event_id, count(*) OVER w AS n, CAST(sum(k) OVER w AS BIGINT) AS k_sum, min(t_us) OVER w AS first_us FROM ev
  WINDOW w AS (PARTITION BY flow ORDER BY t_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def rolling_rate_range_frame(ev: DataFrame) -> DataFrame:
    rows = windows.rolling(ev, ["flow"], "t_us", 3_600_000_000, n=F.count(F.lit(1)), k_sum=F.sum("k"), first_us=F.min("t_us"))
    return rows.select("event_id", "n", "k_sum", "first_us")


@query("""WITH c AS (SELECT event_id, flow, t_us, (event_id * 7001) % 65536 AS c16 FROM ev),
  d AS (SELECT *, coalesce((c16 - lag(c16) OVER w + 98304) % 65536 - 32768, 0) AS d FROM c WINDOW w AS (PARTITION BY flow ORDER BY t_us, event_id))
  SELECT event_id, CAST(first_value(c16) OVER w + sum(d) OVER w AS BIGINT) AS unwrapped FROM d WINDOW w AS (PARTITION BY flow ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)""")
def counter_unwrap(ev: DataFrame) -> DataFrame:
    rows = ev.withColumn("c16", (F.col("event_id") * 7001) % 65536)
    return windows.unwrap(rows, ["flow"], ["t_us", "event_id"], "c16", 16, "unwrapped").select("event_id", "unwrapped")


portable("running_high_water", """SELECT row_id, max(seq) OVER (PARTITION BY flow, point ORDER BY t_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {obs}""")
portable("order_reversals", """WITH a AS (SELECT packet_key, hop, direction, flow, t_us, row_number() OVER (PARTITION BY flow, direction, hop ORDER BY t_us, row_id) AS n FROM {obs}),
  p AS (SELECT x.flow, x.direction, x.packet_key, x.t_us, y.n AS m FROM a x JOIN a y ON x.packet_key = y.packet_key AND x.direction = y.direction AND x.hop = 0 AND y.hop = 3)
  SELECT flow, direction, packet_key, lead_key FROM (SELECT *, lead(m) OVER w AS next_m, lead(packet_key) OVER w AS lead_key FROM p WINDOW w AS (PARTITION BY flow, direction ORDER BY t_us, packet_key)) WHERE next_m < m""")
portable("first_failure", """SELECT event_id, flow, min(CASE WHEN event_type = 'error' THEN t_us END) OVER (PARTITION BY flow) AS first_error_us,
  max(t_us) OVER (PARTITION BY flow) - min(t_us) OVER (PARTITION BY flow) AS flow_us FROM {ev}""")
portable("prefix_refinement", """WITH m AS (SELECT event_id, flow, substr(md5(CAST(event_id % 50 AS STRING)), 1, CAST(1 + k % 8 AS INT)) AS prefix FROM {ev}),
  n AS (SELECT *, min(length(prefix)) OVER (PARTITION BY flow) AS shortest FROM m)
  SELECT event_id, md5(concat(CAST(flow AS STRING), left(prefix, CAST(shortest AS INT)))) AS refined FROM n""")


@query("""WITH c AS (SELECT r.event_id AS r, q.event_id AS q, r.flow, abs(r.t_us - q.t_us) AS gap FROM ev r JOIN ev q ON r.flow = q.flow AND q.event_type = 'view' AND r.event_type = 'signup' AND abs(r.t_us - q.t_us) <= 3600000000)
  SELECT r, q, flow, gap FROM c QUALIFY row_number() OVER (PARTITION BY r ORDER BY gap, q) = 1 AND row_number() OVER (PARTITION BY q ORDER BY gap, r) = 1""")
def proof_assignment(ev: DataFrame) -> DataFrame:
    """Evidence assigned one to one: best of both ends."""
    r = ev.filter("event_type = 'signup'").select(F.col("event_id").alias("r"), "flow", F.col("t_us").alias("a"))
    q = ev.filter("event_type = 'view'").select(F.col("event_id").alias("q"), "flow", F.col("t_us").alias("b"))
    pairs = r.join(q, "flow").withColumn("gap", F.abs(F.col("a") - F.col("b"))).filter("gap <= 3600000000").select("r", "q", "flow", "gap")
    return joins.one_to_one(pairs, "r", "q", "gap")


@query()
def mutual_best_requests(ev: DataFrame) -> DataFrame:
    """Rounds of mutual best until nothing is left; ties stay unresolved."""
    r = ev.filter("event_type = 'click'").select(F.col("event_id").alias("r"), "flow", "k", F.col("t_us").alias("a"))
    q = ev.filter("event_type = 'view'").select(F.col("event_id").alias("q"), "flow", F.col("k").alias("k2"), F.col("t_us").alias("b"))
    pairs = r.join(q, "flow").filter("abs(a - b) <= 86400000000").select("r", "q", (F.col("k") != F.col("k2")).cast("int").alias("other"), F.abs(F.col("a") - F.col("b")).alias("gap"))
    return joins.mutual_best(pairs, "r", "q", "other", "gap")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, 100 + s_suppkey % 30 AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT CAST(node AS BIGINT) AS node, CAST(min(seen) AS BIGINT) AS component FROM r GROUP BY node""")
def components(supplier: DataFrame) -> DataFrame:
    from ..operators.graph import connected_components

    edges = supplier.select(F.col("s_nationkey").cast("long").alias("src"), (100 + F.col("s_suppkey") % 30).cast("long").alias("dst")).distinct()
    return connected_components(edges)


@query("""SELECT event_id, ((seq_a - seq_b) % 4294967296 + 4294967296) % 4294967296 AS ahead, ((seq_a - seq_b) % 4294967296 + 4294967296) % 4294967296 < 2147483648 AS at_or_after
  FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS seq_a, (event_id * 40503 * 65537) % 4294967296 AS seq_b FROM ev)""")
def modular_u32(ev: DataFrame) -> DataFrame:
    a, b = (F.col("event_id") * 2654435761) % net.U32, (F.col("event_id") * 40503 * 65537) % net.U32
    return ev.select("event_id", net.u32_sub(a, b).alias("ahead"), net.u32_at_or_after(a, b).alias("at_or_after"))
