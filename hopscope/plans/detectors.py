"""Queries on the session, transport, transaction and finding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, matching, sessions, transactions, transport
from .paths import LOSSES, MATCHES
from .registry import portable, query

DAY, HOUR = 86_400_000_000, 3_600_000_000


def _kind(ev: DataFrame, kind: str) -> DataFrame:
    return ev.filter(F.col("event_type") == kind)


_LIFE = """o AS (SELECT event_id, flow, t_us FROM ev WHERE event_type = 'signup'),
  a AS (SELECT o.event_id, min(v.t_us) AS answer_us FROM o JOIN ev v ON v.flow = o.flow AND v.event_type = 'view' AND v.t_us > o.t_us AND v.t_us <= o.t_us + 43200000000 GROUP BY o.event_id),
  c AS (SELECT a.event_id, min(v.t_us) AS done_us FROM a JOIN o ON o.event_id = a.event_id JOIN ev v ON v.flow = o.flow AND v.event_type = 'click' AND v.t_us > a.answer_us AND v.t_us <= a.answer_us + 43200000000 GROUP BY a.event_id),
  life AS (SELECT o.*, answer_us, done_us, least(coalesce(done_us, t_us + 43200000000), t_us + 43200000000) AS half_until FROM o LEFT JOIN a USING (event_id) LEFT JOIN c USING (event_id))"""


def _life(ev: DataFrame) -> DataFrame:
    return sessions.lifecycle(_kind(ev, "signup"), _kind(ev, "view"), _kind(ev, "click"), "flow", "t_us", "event_id", DAY // 2)


@query(f"WITH {_LIFE} SELECT event_id, flow, t_us, answer_us, done_us, half_until FROM life")
def session_lifecycle(ev: DataFrame) -> DataFrame:
    return _life(ev).select("event_id", "flow", "t_us", "answer_us", "done_us", "half_until")


@query(f"WITH {_LIFE}, h AS (SELECT unnest(generate_series(t_us // 3600000000, half_until // 3600000000)) AS bucket FROM life) SELECT bucket, count(*) AS half_open FROM h GROUP BY bucket")
def half_open_per_hour(ev: DataFrame) -> DataFrame:
    return sessions.half_open(_life(ev), "t_us", HOUR)


@query(f"""WITH {_LIFE}, b AS (SELECT t_us // 21600000000 AS bucket, count(*) AS n, count(DISTINCT flow) AS s, count(done_us) AS d FROM life GROUP BY ALL),
  r AS (SELECT bucket, bucket - row_number() OVER (ORDER BY bucket) AS run FROM b WHERE n >= 8 AND s >= 5 AND d < 0.9 * n)
  SELECT min(bucket) AS first, max(bucket) AS last, count(*) AS length FROM r GROUP BY run HAVING count(*) >= 3""")
def opening_waves(ev: DataFrame) -> DataFrame:
    return sessions.waves(_life(ev), "flow", "t_us", DAY // 4, 8, 5, 0.9, 3)


@query("""WITH p AS (SELECT a.event_id, a.flow, a.t_us, count(DISTINCT b.k) AS targets, count(*) AS tries, count(*) FILTER (b.event_type = 'error') AS failures FROM ev a JOIN ev b ON b.flow = a.flow AND b.t_us BETWEEN a.t_us - 172800000000 AND a.t_us GROUP BY ALL)
  SELECT event_id, flow, targets, tries, failures FROM p WHERE targets >= 6 AND failures >= 0.3 * tries""")
def scan_checks(ev: DataFrame) -> DataFrame:
    return sessions.fan_out(ev, "flow", "t_us", "k", F.col("event_type") == "error", 2 * DAY, 6, 0.3).select("event_id", "flow", "targets", "tries", "failures")


@query("""WITH r AS (SELECT event_id, flow, t_us, coalesce(t_us - lag(t_us) OVER (ORDER BY t_us, event_id) > 1800000000, true) AS s FROM ev WHERE event_type = 'error'), i AS (SELECT *, sum(CAST(s AS INT)) OVER (ORDER BY t_us, event_id) AS storm FROM r)
  SELECT min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS resets, count(DISTINCT flow) AS flows FROM i GROUP BY storm HAVING count(DISTINCT flow) >= 2""")
def storm_clusters(ev: DataFrame) -> DataFrame:
    return sessions.reset_storms(_kind(ev, "error"), "t_us", "event_id", "flow", 1_800_000_000)


@query("""SELECT e.event_id, e.flow, min(s.t_us) - e.t_us AS after_us FROM (SELECT * FROM ev WHERE event_type = 'error') e LEFT JOIN ev s ON s.flow = e.flow AND s.event_type = 'signup' AND s.t_us >= e.t_us + 1 AND s.t_us - e.t_us <= 86400000000 GROUP BY e.event_id, e.flow, e.t_us""")
def stream_reconnects(ev: DataFrame) -> DataFrame:
    return sessions.reconnects(_kind(ev, "error"), _kind(ev, "signup"), "flow", "t_us", "event_id", DAY)


@query("""WITH RECURSIVE s AS (SELECT DISTINCT flow, k * 1000 + event_id % 40 AS key FROM ev), e AS (SELECT DISTINCT x.flow AS a, y.flow AS b FROM s x JOIN s y USING (key)),
  r AS (SELECT a AS stream, a AS seen FROM e UNION SELECT r.stream, e.b FROM r JOIN e ON e.a = r.seen) SELECT stream, min(seen) AS session FROM r GROUP BY stream""")
def linked_sessions(ev: DataFrame) -> DataFrame:
    rows = ev.select(F.col("flow").alias("stream"), (F.col("k") * 1000 + F.col("event_id") % 40).alias("key"))
    return sessions.link_sessions(rows, "stream", "key")


@query("""SELECT row_id, md5(concat_ws('|', CAST(packet_key AS VARCHAR), CASE WHEN point <= 1 THEN '0' ELSE '2' END)) AS packet_key FROM obs""")
def proxy_legs(obs: DataFrame) -> DataFrame:
    """Keys are kept apart on both sides of an opaque hop between points 1 and 2."""
    edges = obs.sparkSession.createDataFrame([(0, 1, False), (1, 2, True), (2, 3, False)], "a long, b long, opaque boolean")
    return sessions.partition_legs(obs.select("row_id", "point", "packet_key"), edges, "packet_key").select("row_id", "packet_key")


@query("""WITH p AS (SELECT a.flow, a.seq AS sa, (b.seq + a.flow * 1000) % 4294967296 + CASE WHEN a.flow % 10 = 0 AND a.k > 80 THEN 1 ELSE 0 END AS sb FROM obs a JOIN obs b ON b.packet_key = a.packet_key AND a.hop = 1 AND b.hop = 2)
  SELECT flow, count(*) AS samples, CASE WHEN min((sb - sa + 4294967296) % 4294967296) = max((sb - sa + 4294967296) % 4294967296) AND count(*) >= 3 THEN min((sb - sa + 4294967296) % 4294967296) END AS "offset",
    CASE WHEN min((sb - sa + 4294967296) % 4294967296) <> max((sb - sa + 4294967296) % 4294967296) THEN 'inconsistent' WHEN count(*) < 3 THEN 'too few samples' END AS reason FROM p GROUP BY flow""")
def sequence_offsets(obs: DataFrame) -> DataFrame:
    a = obs.filter("hop = 1").select("packet_key", "flow", "k", F.col("seq").alias("sa"))
    odd = F.when((F.col("flow") % 10 == 0) & (F.col("k") > 80), 1).otherwise(0)
    b = obs.filter("hop = 2").select("packet_key", F.col("seq").alias("sb"))
    pairs = a.join(b, "packet_key").withColumn("sb", (F.col("sb") + F.col("flow") * 1000) % (1 << 32) + odd)
    return transport.learn_offsets(pairs, ["flow"], "sa", "sb")


@query("""WITH m AS (SELECT flow, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(k) AS top, avg(k) AS mean FROM ev GROUP BY flow)
  SELECT flow, CASE WHEN n < 30 THEN 'unknown' WHEN top >= 99 AND mean > 49 THEN 'receiver' WHEN errors > 0.22 * n THEN 'network' WHEN mean > 51 AND NOT n < 60 THEN 'network' WHEN n < 60 THEN 'application' ELSE 'unknown' END AS limited_by FROM m""")
def limitation_classes(ev: DataFrame) -> DataFrame:
    m = ev.groupBy("flow").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("k").alias("top"), F.avg("k").alias("mean"))
    found = transport.limitation((F.col("top") >= 99) & (F.col("mean") > 49), F.lit(False), F.col("errors") > 0.22 * F.col("n"), F.col("mean") > 51, F.col("n") < 60, F.col("n") >= 30)
    return m.select("flow", found.alias("limited_by"))


@query("""WITH o AS (SELECT event_id, t_us FROM obs WHERE hop = 0 AND attempt = 0), s AS (SELECT DISTINCT event_id FROM obs WHERE hop = 3 AND attempt = 0)
  SELECT y.event_id, y.t_us - o.t_us AS wait_us, CASE WHEN s.event_id IS NOT NULL THEN 'spurious' WHEN k % 7 = 0 THEN 'selective' WHEN k % 5 >= 3 THEN 'fast' WHEN y.t_us - o.t_us >= greatest(20000 + 4 * 50000, 200000) THEN 'timeout' ELSE 'unknown' END AS kind
  FROM obs y JOIN o USING (event_id) LEFT JOIN s USING (event_id) WHERE y.hop = 0 AND y.attempt = 1""")
def retry_subtypes(obs: DataFrame) -> DataFrame:
    first = obs.filter("hop = 0 AND attempt = 0").select("event_id", F.col("t_us").alias("_t"))
    there = obs.filter("hop = 3 AND attempt = 0").select("event_id").distinct().withColumn("_s", F.lit(True))
    rows = obs.filter("hop = 0 AND attempt = 1").join(first, "event_id").join(there, "event_id", "left").withColumn("wait_us", F.col("t_us") - F.col("_t"))
    kind = transport.retry_kind(F.col("_s").isNotNull(), F.col("k") % 7 == 0, F.col("k") % 5, F.col("wait_us"), F.lit(20_000), F.lit(50_000))
    return rows.select("event_id", "wait_us", kind.alias("kind"))


@query("""WITH q AS (SELECT event_id AS request, flow, t_us AS asked_us FROM ev WHERE event_type = 'click'), r AS (SELECT event_id AS response, flow, t_us FROM ev WHERE event_type = 'view'),
  n AS (SELECT request, response, t_us - asked_us AS wait_us, count(*) OVER (PARTITION BY request) AS a, count(*) OVER (PARTITION BY response) AS b FROM q JOIN r USING (flow) WHERE t_us > asked_us AND t_us <= asked_us + 21600000000),
  e AS (SELECT max(t_us) AS last FROM ev)
  SELECT q.request, flow, asked_us, o.response, o.wait_us, CASE WHEN o.response IS NOT NULL THEN 'answered' WHEN s.request IS NOT NULL THEN 'ambiguous' WHEN last < asked_us + 21600000000 THEN 'unknown' ELSE 'unanswered' END AS outcome
  FROM q LEFT JOIN (SELECT * FROM n WHERE a = 1 AND b = 1) o USING (request) LEFT JOIN (SELECT DISTINCT request FROM n) s USING (request), e""")
def transaction_outcomes(ev: DataFrame) -> DataFrame:
    last = ev.agg(F.max("t_us").alias("_last"))
    asked = _kind(ev, "click").crossJoin(F.broadcast(last))  # one row
    return transactions.transactions(asked, _kind(ev, "view"), ["flow"], "t_us", "event_id", 21_600_000_000, F.col("_last"))


@query("""WITH q AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY t_us, event_id) AS ordinal, event_id AS request, t_us AS request_us FROM ev WHERE event_type = 'click'),
  r AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY t_us, event_id) AS ordinal, event_id AS response, t_us AS response_us FROM ev WHERE event_type = 'purchase')
  SELECT flow, ordinal, request, request_us, response, response_us, CASE WHEN response IS NULL THEN 'no response' WHEN response_us < request_us THEN 'out of order' END AS reason FROM q LEFT JOIN r USING (flow, ordinal)""")
def requests_by_ordinal(ev: DataFrame) -> DataFrame:
    return transactions.by_ordinal(_kind(ev, "click"), _kind(ev, "purchase"), ["flow"], "t_us", "event_id")


_SIDES = """u AS (SELECT event_id AS id, CASE WHEN k % 4 = 0 THEN 'i' || CAST(event_id // 10 AS VARCHAR) END AS identity, 'a' || CAST(flow AS VARCHAR) AS origin, CASE WHEN k > 70 THEN 's' || CAST(k AS VARCHAR) || CAST(flow AS VARCHAR) END AS sni, t_us FROM ev WHERE event_type = 'click'),
  d AS (SELECT event_id AS id, CASE WHEN k % 3 = 0 THEN 'i' || CAST(event_id // 10 AS VARCHAR) END AS identity, list_value('a' || CAST(flow AS VARCHAR), 'p') AS xff, CASE WHEN k > 60 THEN 's' || CAST(k AS VARCHAR) || CAST(flow AS VARCHAR) END AS sni, t_us FROM ev WHERE event_type = 'view')"""


@query(f"""WITH {_SIDES}, c AS (SELECT u.id AS up, d.id AS down, d.t_us - u.t_us AS gap, CASE WHEN u.identity = d.identity THEN 0 WHEN list_contains(d.xff, u.origin) THEN 1 WHEN u.sni = d.sni THEN 2 END AS rank FROM u JOIN d ON d.t_us BETWEEN u.t_us AND u.t_us + 7200000000)
  SELECT up, down, rank, gap FROM c WHERE rank IS NOT NULL""")
def proxy_candidates(ev: DataFrame) -> DataFrame:
    f, k, e = F.col("flow"), F.col("k"), F.col("event_id")
    identity, origin, sni = F.concat(F.lit("i"), F.floor(e / 10)), F.concat(F.lit("a"), f), F.concat(F.lit("s"), k, f)
    up = _kind(ev, "click").select(e.alias("id"), F.when(k % 4 == 0, identity).alias("identity"), origin.alias("origin"), F.when(k > 70, sni).alias("sni"), "t_us")
    down = _kind(ev, "view").select(e.alias("id"), F.when(k % 3 == 0, identity).alias("identity"), F.array(origin, F.lit("p")).alias("xff"), F.when(k > 60, sni).alias("sni"), "t_us")
    return transactions.request_candidates(up, down, "t_us", 7_200_000_000)


@query(f"""WITH {MATCHES}, t AS (SELECT packet_key, direction, hop, t_a, t_b - CASE WHEN packet_key % 11 = 0 THEN 3000 WHEN packet_key % 13 = 0 THEN 2100 ELSE 0 END AS t_b FROM m)
  SELECT packet_key, direction, hop, CASE WHEN t_b - t_a >= -200 THEN greatest(t_b - t_a, 0) END AS dwell_us, CASE WHEN t_b - t_a < -200 THEN 'negative beyond the clocks'' uncertainty' END AS reason FROM t""")
def dwell_times(obs: DataFrame) -> DataFrame:
    off = F.when(F.col("packet_key") % 11 == 0, 3000).when(F.col("packet_key") % 13 == 0, 2100).otherwise(0)
    took, reason = transactions.dwell(F.col("t_a"), F.col("t_b") - off, F.lit(200))
    return matching.hop_matches(obs).select("packet_key", "direction", "hop", took.alias("dwell_us"), reason.alias("reason"))


@query("""WITH c AS (SELECT flow, hop, 'c' || CAST((flow + CASE WHEN hop >= 2 AND flow % 9 = 0 THEN 1 ELSE 0 END) % 30 AS VARCHAR) || CASE WHEN flow % 17 = 0 THEN CAST(k % 2 AS VARCHAR) ELSE '' END AS chain FROM obs WHERE hop IN (1, 2)),
  n AS (SELECT flow, list_sort(list(DISTINCT chain) FILTER (hop = 1)) AS a, list_sort(list(DISTINCT chain) FILTER (hop = 2)) AS b FROM c GROUP BY flow)
  SELECT flow, CASE WHEN coalesce(len(a), 0) <> 1 OR coalesce(len(b), 0) <> 1 THEN 'unknown' WHEN a = b THEN 'same' ELSE 'replaced' END AS state FROM n""")
def certificate_chains(obs: DataFrame) -> DataFrame:
    moved = F.when((F.col("hop") >= 2) & (F.col("flow") % 9 == 0), 1).otherwise(0)
    chain = F.concat(F.lit("c"), (F.col("flow") + moved) % 30, F.when(F.col("flow") % 17 == 0, (F.col("k") % 2).cast("string")).otherwise(""))
    rows = obs.filter("hop IN (1, 2)").select("flow", "hop", chain.alias("chain"))
    return transactions.chain_comparison(rows.filter("hop = 1"), rows.filter("hop = 2"), ["flow"], "chain")


@query("""WITH a AS (SELECT event_id, attempt, len, 'c' || CAST(flow AS VARCHAR) AS a, t_us FROM obs WHERE hop = 0), b AS (SELECT event_id, attempt, len, 'n' || CAST(flow % 50 AS VARCHAR) AS b, t_us FROM obs WHERE hop = 1)
  SELECT a, b, count(*) AS samples, max(b.t_us - a.t_us) - min(b.t_us - a.t_us) AS spread_us FROM a JOIN b USING (event_id, attempt, len) GROUP BY a, b HAVING count(*) >= 3 AND max(b.t_us - a.t_us) - min(b.t_us - a.t_us) <= 3200""")
def translation_pairs(obs: DataFrame) -> DataFrame:
    a = obs.filter("hop = 0").withColumn("a", F.concat(F.lit("c"), F.col("flow")))
    b = obs.filter("hop = 1").withColumn("b", F.concat(F.lit("n"), F.col("flow") % 50))
    return transactions.translation_candidates(a, b, ["event_id", "attempt", "len"], ["a", "b"], "t_us", spread=3200)


@query("""WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, epoch_us(l_shipdate) AS t FROM lineitem), r AS (SELECT k, t, sum(q) OVER w - q + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS lo, sum(q) OVER w AS hi FROM li WINDOW w AS (PARTITION BY k ORDER BY n, p, q, t ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, lo > coalesce(max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hole FROM r), o AS (SELECT *, bool_or(hole) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS bad FROM g)
  SELECT k, CAST(max(hi) AS BIGINT) AS reached, max(t) AS completed_us FROM o WHERE NOT bad GROUP BY k""")
def contiguous_completion(lineitem: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rows = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"))
    total = F.sum("q").over(Window.partitionBy("k").orderBy("n", "p", "q", "t").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.select("k", "t", (total - F.col("q") + F.when(F.col("p") % 7 == 0, 1).otherwise(0)).alias("lo"), total.alias("hi"))
    return transport.contiguous_until(parts, ["k"], "lo", "hi", "t")


@query(f"""WITH {MATCHES}, i AS (SELECT a.flow, a.k % 7 AS ia, a.k % 7 + CASE WHEN a.flow % 6 = 0 AND a.k > 20 THEN 1 ELSE 0 END AS ib FROM obs a JOIN obs b ON b.packet_key = a.packet_key AND a.hop = 1 AND b.hop = 2)
  SELECT flow, CASE WHEN count(*) < 3 THEN 'unknown' WHEN count(*) FILTER (ia = ib) > 0.9 * count(*) THEN 'kept' ELSE 'changed' END AS policy, count(*) AS n FROM i GROUP BY flow""")
def identity_policies(obs: DataFrame) -> DataFrame:
    pairs = obs.filter("hop = 1").select("packet_key", "flow", "k").join(obs.filter("hop = 2").select("packet_key"), "packet_key")
    pairs = pairs.select("flow", (F.col("k") % 7).alias("ia"), (F.col("k") % 7 + F.when((F.col("flow") % 6 == 0) & (F.col("k") > 20), 1).otherwise(0)).alias("ib"))
    return transport.identity_policy(pairs, ["flow"], "ia", "ib")


@query(f"""WITH {LOSSES} SELECT y.row_id, y.flow, CASE WHEN EXISTS (SELECT 1 FROM kinds l WHERE l.flow = y.flow AND l.t_us <= y.t_us AND l.t_us >= y.t_us - 600000) THEN 'symptom' ELSE 'suspect' END AS label FROM obs y WHERE attempt = 1 AND hop = 0""")
def retry_labels(obs: DataFrame) -> DataFrame:
    retries = obs.filter("attempt = 1 AND hop = 0").select("row_id", "flow", "t_us")
    return findings.label_retries(retries, matching.classify_losses(obs), "flow", "t_us", 600_000).select("row_id", "flow", "label")


@query("SELECT first // 86400000000 AS bucket, count(*) AS failed_connections FROM (SELECT flow, min(t_us) AS first FROM ev WHERE event_type = 'error' GROUP BY flow) GROUP BY ALL")
def failed_connections(ev: DataFrame) -> DataFrame:
    return findings.connection_failures(ev, "flow", "t_us", "event_type = 'error'", DAY)


@query("""SELECT (t_us - 1704500000000000) // 4000000000 AS cell, count(*) AS n, min(k) AS least, max(k) AS largest, round(avg(k), 6) AS mean FROM ev WHERE t_us >= 1704500000000000 AND t_us < 1705500000000000 GROUP BY ALL""")
def stream_chart(ev: DataFrame) -> DataFrame:
    return findings.chart(ev, "t_us", "k", 1704500000000000, 1705500000000000, 250)


portable("contained_segments", "SELECT DISTINCT a.flow FROM {obs} a JOIN {obs} b ON b.flow = a.flow AND b.direction = a.direction AND b.seq <= a.seq AND b.seq + b.len >= a.seq + a.len AND b.len > a.len")
portable("clock_range_candidates", """WITH a AS (SELECT flow, t_us, row_number() OVER (PARTITION BY flow ORDER BY t_us, row_id) AS n, count(*) OVER (PARTITION BY flow) AS c FROM {obs} WHERE hop = 0),
  b AS (SELECT flow, t_us, row_number() OVER (PARTITION BY flow ORDER BY t_us, row_id) AS n, count(*) OVER (PARTITION BY flow) AS c FROM {obs} WHERE hop = 1) SELECT a.flow, a.t_us AS ref_us, b.t_us AS other_us FROM a JOIN b ON b.flow = a.flow AND b.n = a.n AND b.c = a.c""")
portable("reset_propagation", """WITH r AS (SELECT event_id, min(hop) AS low, max(hop) AS high, count(*) AS n, min_by(hop, t_us) AS first FROM {obs} WHERE flags = 4 AND attempt = 0 GROUP BY event_id)
  SELECT event_id, CASE WHEN first = 0 AND high - low + 1 = n THEN 'propagated' WHEN first > 0 THEN 'originated' ELSE 'unknown' END AS kind FROM r""")
portable("one_way_streams", """WITH s AS (SELECT flow, bool_or(direction = 'forward' AND hop = 0) AS sent, bool_or(direction = 'forward' AND hop = 3) AS arrived, bool_or(direction = 'reverse' AND hop = 3) AS back FROM {obs} GROUP BY flow) SELECT flow, sent AND NOT arrived AND back AS one_way FROM s""")
portable("path_fragments", """SELECT flow, hop, count(*) AS n, count(DISTINCT ttl) AS ttls, max(ttl) - min(ttl) AS ttl_spread FROM {obs} GROUP BY flow, hop HAVING count(DISTINCT ttl) > 1""")
