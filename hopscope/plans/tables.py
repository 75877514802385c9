"""Queries on aggregates, pages, sets and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .paths import LOSSES, MATCHES
from .registry import portable, query

portable("flow_summary", """WITH b AS (SELECT flow, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, count(*) FILTER (WHERE (flags & 2) = 2) AS syn, count(*) FILTER (WHERE (flags & 4) = 4) AS rst,
    count(DISTINCT point) AS points FROM {obs} GROUP BY flow), y AS (SELECT flow, CAST(sum(len) AS BIGINT) AS bytes FROM (SELECT flow, packet_key, max(len) AS len FROM {obs} GROUP BY flow, packet_key) GROUP BY flow)
  SELECT b.*, y.bytes FROM b JOIN y USING (flow)""")
portable("quality_counts", "SELECT point, count(*) AS n, count(*) FILTER (WHERE attempt > 0) AS copies, count(*) FILTER (WHERE dscp = 0) AS unmarked, count(DISTINCT flow) AS flows, max(ttl) AS max_ttl FROM {obs} GROUP BY point")
portable("argmin_argmax", """SELECT flow, min_by(event_id, t_us) FILTER (WHERE event_id IS NOT NULL) AS first_event, max_by(event_type, t_us) FILTER (WHERE event_type IS NOT NULL) AS last_type,
  bool_or(event_type = 'error') AS any_error, bool_and(k < 50) AS all_low FROM {ev} GROUP BY flow""")
portable("two_level_distinct", "SELECT direction, CAST(sum(len) AS BIGINT) AS bytes, count(*) AS n FROM (SELECT direction, packet_key, max(len) AS len FROM {obs} GROUP BY direction, packet_key) GROUP BY direction")
portable("mode_stddev_xor", "SELECT event_type, round(stddev_pop(value), 6) AS sd, bit_xor(event_id) AS x, count(DISTINCT k) AS ks, round(QUANTILE(value, 0.5), 6) AS med FROM {ev} GROUP BY event_type")
portable("having_alias", "SELECT flow, count(*) AS n, CAST(sum(k) AS BIGINT) AS ks FROM {ev} GROUP BY ALL HAVING n >= 60")
portable("match_percentages", """SELECT a.direction, a.hop, count(b.row_id) AS matched, count(*) AS n, round(100e0 * count(b.row_id) / nullif(count(*), 0), 6) AS match_percent,
  round(100e0 * (count(*) - count(b.row_id)) / nullif(count(*), 0), 6) AS miss_percent FROM {obs} a LEFT JOIN {obs} b ON b.packet_key = a.packet_key AND b.hop = a.hop + 1 WHERE a.hop < 3 GROUP BY a.direction, a.hop""")
portable("eligibility_breakdown", """SELECT point, direction, CASE WHEN attempt > 0 THEN 'copy' WHEN len < 64 THEN 'too short' WHEN dscp = 0 THEN 'unmarked' ELSE 'eligible' END AS status, count(*) AS n FROM {obs} GROUP BY ALL""")
portable("weighted_excess", """WITH m AS (SELECT a.direction, a.hop, b.t_us - a.t_us AS d, a.len FROM {obs} a JOIN {obs} b ON a.packet_key = b.packet_key AND b.hop = a.hop + 1)
  SELECT direction, hop, CAST(sum(greatest(0, d - 2500) * len) AS BIGINT) AS excess, round(sum(greatest(0, d - 2500) * len) / nullif(CAST(sum(len) AS DOUBLE), 0), 6) AS mean_excess FROM m GROUP BY direction, hop""")


@query("""SELECT flow, CAST(to_json(list(event_id ORDER BY t_us, event_id)) AS VARCHAR) AS events, CAST(to_json(list_sort(list(DISTINCT event_type))) AS VARCHAR) AS types FROM ev GROUP BY flow""")
def ordered_lists(ev: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_us", "event_id"))), lambda r: r["event_id"])
    return ev.groupBy("flow").agg(F.to_json(ordered).alias("events"), F.to_json(F.array_sort(F.collect_set("event_type"))).alias("types"))


portable("flow_page", """WITH s AS (SELECT flow, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes, min(t_us) AS first_us FROM {obs} GROUP BY flow)
  SELECT * FROM s WHERE CAST(flow AS STRING) LIKE '%1%' ORDER BY bytes DESC NULLS LAST, flow LIMIT 20 OFFSET 10""")
portable("ladder", """SELECT packet_key, min(t_us) AS first_us, count(*) AS points, CAST(min(CASE WHEN hop = 3 THEN t_us END) AS BIGINT) AS last_hop_us FROM {obs}
  WHERE flow = (SELECT min(flow) FROM {obs}) GROUP BY packet_key ORDER BY first_us, packet_key LIMIT 25 OFFSET 5""")
portable("event_page", """SELECT event_id, flow, t_us, k FROM {ev} WHERE event_type = 'error' AND (k >= 50 OR k IS NULL) ORDER BY t_us DESC, event_id LIMIT 30 OFFSET 15""")
portable("transaction_page", """SELECT q.event_id, q.flow, min(r.t_us - q.t_us) AS wait_us FROM {ev} q LEFT JOIN {ev} r ON r.flow = q.flow AND r.event_type = 'purchase' AND r.t_us > q.t_us AND r.t_us <= q.t_us + 86400000000
  WHERE q.event_type = 'click' GROUP BY q.event_id, q.flow ORDER BY wait_us DESC NULLS LAST, q.event_id LIMIT 40""")
portable("per_group_cap", "SELECT flow, event_id, n FROM (SELECT flow, event_id, CAST(row_number() OVER (PARTITION BY flow ORDER BY value DESC NULLS LAST, event_id) AS BIGINT) AS n FROM {ev}) WHERE n <= 3")
portable("hash_sample", "SELECT event_id, flow FROM {ev} ORDER BY md5(concat(CAST(event_id AS STRING), '|', CAST(flow AS STRING))), event_id LIMIT 500")
portable("severity_order", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS severity, t_us FROM {ev} ORDER BY severity, t_us, event_id LIMIT 200""")
portable("union_edges", "SELECT flow, point FROM {obs} WHERE hop = 0 UNION SELECT flow, point FROM {obs} WHERE hop = 3")
portable("union_all_counts", "SELECT side, count(*) AS n FROM (SELECT 'a' AS side, flow FROM {obs} WHERE hop = 0 UNION ALL SELECT 'b', flow FROM {obs} WHERE hop = 1) GROUP BY side")
portable("distinct_keys", "SELECT DISTINCT packet_key, direction FROM {obs}")
portable("coverage_intersection", "SELECT direction, max(a) AS start_us, min(b) AS end_us FROM (SELECT direction, point, min(t_us) AS a, max(t_us) AS b FROM {obs} GROUP BY direction, point) GROUP BY direction")
portable("source_inventory", "SELECT point, max(len) AS max_len, min(len) FILTER (WHERE len > 100) AS min_long, count(*) AS n FROM {obs} GROUP BY point")
portable("json_fields", """SELECT event_id, k, CASE WHEN JSON_TEXT(props, '$.none') IS NULL THEN 1 ELSE 0 END AS absent, k * 2 AS twice FROM {ev} WHERE JSON_TEXT(props, '$.k') IS NOT NULL""")
portable("string_fields", """SELECT doc_id, substr(text, 2, 12) AS head, CAST(length(text) AS BIGINT) AS n, text ILIKE '%THE%' AS has_the, nullif(lang, 'en') AS other, md5(text) AS digest FROM {documents}""")
portable("duplicate_content", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM {documents} GROUP BY md5(text) HAVING count(*) > 1")
portable("turn_pairs", """SELECT a.conv_id, a.turn, a.role, b.role AS next_role, CAST(length(b.text) - length(a.text) AS BIGINT) AS growth FROM {conversations} a JOIN {conversations} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
portable("transit_orders", """SELECT o.o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN l.l_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_lines FROM {orders} o LEFT JOIN
  (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority""")


@query("""SELECT row_id, (flags & 2) = 2 AS syn, (flags & 18) = 18 AS syn_ack, (flags & 4) <> 0 AS rst, (flags & 7) <> 0 OR len > 100 AS countable FROM obs""")
def bit_flags(obs: DataFrame) -> DataFrame:
    f = F.col("flags")
    countable = (f.bitwiseAND(F.lit(7)) != 0) | (F.col("len") > 100)
    return obs.select("row_id", net.has_flags(f, 2).alias("syn"), net.has_flags(f, 18).alias("syn_ack"), (f.bitwiseAND(F.lit(4)) != 0).alias("rst"), countable.alias("countable"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 5 WHEN event_id % 107 = 0 THEN t_us + 400000000000000 ELSE t_us END AS t FROM ev),
  n AS (SELECT max(t_us) AS now FROM ev) SELECT event_id, t, CASE WHEN t IS NULL THEN 'missing' WHEN t < 946684800000000 THEN 'before 2000' WHEN t > now + 86400000000 THEN 'in the future' END AS reason FROM t, n""")
def quarantine_timestamps(ev: DataFrame) -> DataFrame:
    odd = F.when(F.col("event_id") % 101 == 0, F.lit(None)).when(F.col("event_id") % 103 == 0, F.lit(5)).when(F.col("event_id") % 107 == 0, F.col("t_us") + 400000000000000).otherwise(F.col("t_us"))
    now = ev.agg(F.max("t_us").alias("now"))
    rows = ev.select("event_id", odd.alias("t")).crossJoin(F.broadcast(now))  # one row
    return rows.select("event_id", "t", net.timestamp_reason(F.col("t"), F.col("now")).alias("reason"))


_ADDRESSES = """SELECT event_id, concat('10.', CAST(flow % 3 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR), '.7') AS src, concat('192.0.2.', CAST(k % 300 AS VARCHAR)) AS dst FROM ev"""


@query(f"""WITH a AS ({_ADDRESSES}), n AS (SELECT *, list_transform(str_split(src, '.'), lambda x: CAST(x AS BIGINT)) AS s, list_transform(str_split(dst, '.'), lambda x: CAST(x AS BIGINT)) AS d FROM a),
  v AS (SELECT event_id, src, dst, s[1] * 16777216 + s[2] * 65536 + s[3] * 256 + s[4] AS sn, CASE WHEN d[4] < 256 THEN d[1] * 16777216 + d[2] * 65536 + d[3] * 256 + d[4] END AS dn FROM n)
  SELECT event_id, sn, dn, CASE WHEN sn BETWEEN 167772160 AND 167903231 THEN 'forward' ELSE 'unknown' END AS direction FROM v""")
def cidr_direction(ev: DataFrame) -> DataFrame:
    src = F.concat(F.lit("10."), F.col("flow") % 3, F.lit("."), F.col("event_id") % 256, F.lit(".7"))
    dst = F.concat(F.lit("192.0.2."), F.col("k") % 300)
    rows = ev.select("event_id", src.alias("src"), dst.alias("dst"))
    return rows.select("event_id", net.ipv4(F.col("src")).alias("sn"), net.ipv4(F.col("dst")).alias("dn"), net.direction(F.col("src"), F.col("dst"), ["10.0.0.0/15"]).alias("direction"))


@query("""WITH t AS (SELECT event_id, concat('c', CAST(flow AS VARCHAR)) AS a, concat('s', CAST(k AS VARCHAR)) AS b FROM ev)
  SELECT event_id, md5(concat_ws('|', least(a, b), greatest(a, b))) AS flow_key, md5(concat_ws('|', a, b, CAST(event_id % 100 AS VARCHAR))) AS packet_key FROM t""")
def canonical_keys(ev: DataFrame) -> DataFrame:
    a, b = F.concat(F.lit("c"), F.col("flow")), F.concat(F.lit("s"), F.col("k"))
    return ev.select("event_id", net.key(F.least(a, b), F.greatest(a, b)).alias("flow_key"), net.key(a, b, F.col("event_id") % 100).alias("packet_key"))


@query("""SELECT event_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%g') AS utc, strftime(make_timestamp(t_us + 19800000000), '%Y-%m-%dT%H:%M:%S.%g') AS local FROM ev""")
def time_labels(ev: DataFrame) -> DataFrame:
    at, form = F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS"
    return ev.select("event_id", F.date_format(at, form).alias("utc"), F.date_format(F.from_utc_timestamp(at, "Asia/Kolkata"), form).alias("local"))


@query(f"""WITH {MATCHES}, {LOSSES}, k AS (SELECT direction, hop, kind, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, max(recovery_us) AS worst_us FROM kinds GROUP BY ALL)
  SELECT * FROM k""")
def class_rollup(obs: DataFrame) -> DataFrame:
    from ..operators.matching import classify_losses

    rows = classify_losses(obs).groupBy("direction", "hop", "kind")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.max("recovery_us").alias("worst_us"))


@query("""WITH t AS (SELECT event_id, flow, concat('host-', CAST(k AS VARCHAR)) AS name FROM ev), d AS (SELECT name, min(event_id) AS first FROM t GROUP BY name),
  n AS (SELECT name, row_number() OVER (ORDER BY first) AS i FROM d) SELECT event_id, concat('name-', CAST(i AS VARCHAR)) AS token FROM t JOIN n USING (name)""")
def redacted_tokens(ev: DataFrame) -> DataFrame:
    from ..operators.privacy import tokens

    rows = ev.select("event_id", F.concat(F.lit("host-"), F.col("k")).alias("name"))
    return tokens(rows, "name", "event_id", "name").select("event_id", "token")


@query()
def anonymised_addresses(ev: DataFrame) -> DataFrame:
    """Keyed prefix-preserving addresses; tests check that shared prefixes stay shared."""
    from ..operators.privacy import anonymise_ipv4

    src = F.concat(F.lit("10."), F.col("flow") % 3, F.lit("."), F.col("event_id") % 256, F.lit(".7"))
    return ev.select("event_id", src.alias("src")).withColumn("mapped", anonymise_ipv4(F.col("src"), b"key"))
