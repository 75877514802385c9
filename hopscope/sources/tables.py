"""Typed field dumps, text logs and JSON events as frames, with what is set aside and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import key, timestamp_reason

FIELDS = "row_id bigint, ts double, iface int, src string, dst string, sport int, dport int, proto string, seq bigint, ack bigint, flags int, length int, ttl int, dscp int, ipid int, prefix string, extra string"
#: A cluster member is read through the others' addresses if it is so many times larger, and fully if under this share remains.
PREFILTER_FACTOR, PREFILTER_LEAST = 5, 0.1


def field_dump(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tab-separated decoder output under a fixed schema; source is the file."""
    return spark.read.schema(FIELDS).option("sep", "\t").csv(paths).withColumn("source", F.col("_metadata.file_path"))


def parse_records(rows: DataFrame, now_us: Column) -> tuple[DataFrame, DataFrame]:
    """(good, set aside): typed rows with t_us, signature, tuple and reverse keys, and the rest with a reason."""
    typed = rows.withColumn("t_us", F.floor(F.col("ts") * 1_000_000).cast("long"))
    unsupported = F.when(F.col("src").isNull() | F.col("dst").isNull(), "no addresses").when(~F.col("proto").isin("tcp", "udp", "icmp"), "unsupported protocol")
    reason = F.coalesce(timestamp_reason(F.when(~F.isnan("ts"), F.col("t_us")), now_us), unsupported)
    identity = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("proto", "seq", "ack", "flags", "length", "ipid", "prefix")])), 256)
    a, b = [F.col("src"), F.col("sport")], [F.col("dst"), F.col("dport")]
    typed = typed.withColumns({"reason": reason, "signature": identity, "tuple_key": key(F.col("proto"), *a, *b), "reverse_tuple": key(F.col("proto"), *b, *a)})
    typed = typed.withColumn("flow", F.least("tuple_key", "reverse_tuple"))
    return typed.filter("reason IS NULL").drop("reason"), typed.filter("reason IS NOT NULL")


def prefilter(large: DataFrame, small: DataFrame) -> DataFrame:
    """Rows of ``large`` between pairs of addresses that ``small`` has; all of ``large`` if that leaves under a tenth.

    Pairs are a join on both ends' order; Spark chooses a broadcast if the pairs are few.
    """

    def pair(df: DataFrame) -> DataFrame:
        return df.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})

    kept = pair(large).join(pair(small).select("_a", "_b").distinct(), ["_a", "_b"], "left_semi").drop("_a", "_b")
    return kept if kept.count() >= PREFILTER_LEAST * large.count() else large


def choose_prefilter(sizes: dict[str, int]) -> list[str]:
    """Names of the sources over five times the largest of the other half."""
    ordered = sorted(sizes.values())
    base = ordered[(len(ordered) - 1) // 2] if ordered else 0
    return sorted(n for n, s in sizes.items() if s > PREFILTER_FACTOR * base)


_HEAD = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\.\d+|\d+\.\d+)\s+(\S+)\s+(in|out|--)\b"
_HEX = r"^\s*0x([0-9a-fA-F]+)[\s:]+((?:[0-9a-fA-F]{2,4}\s?)+)"


def text_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skipped): hex dumps below header lines of a text log; ``lines`` has source, line (a number) and value.

    A hex row counts only if its offset is the number of bytes so far; a gap or overlap makes the record bad, and
    one of under 14 bytes is none. Other lines are counted by reason.
    """
    order = Window.partitionBy("source").orderBy("line")
    hexed = F.regexp_replace(F.regexp_extract("value", _HEX, 2), r"\s", "")
    rows = lines.withColumns({"stamp": F.regexp_extract("value", _HEAD, 1), "iface": F.regexp_extract("value", _HEAD, 2), "hex": hexed, "at": F.conv(F.regexp_extract("value", _HEX, 1), 16, 10).cast("long")})
    rows = rows.withColumn("record", F.sum((F.col("stamp") != "").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("source", "record").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    data = rows.filter("hex != '' AND record > 0").withColumn("so_far", F.coalesce(F.sum(F.length("hex")).over(part), F.lit(0)) / 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "hex"))), lambda r: r["hex"]), "")
    bodies = data.groupBy("source", "record").agg(F.unhex(joined).alias("data"), F.bool_or(F.col("at") != F.col("so_far")).alias("bad"))
    heads = rows.filter("stamp != ''").select("source", "record", "line", "iface", "stamp")
    absolute = F.unix_micros(F.try_to_timestamp(F.translate("stamp", "T", " ")))
    t_us = F.coalesce(absolute, F.floor(F.col("stamp").try_cast("double") * 1_000_000)).cast("long")
    found = heads.join(bodies, ["source", "record"], "left")
    reason = F.when(F.col("data").isNull(), "no bytes").when(F.col("bad"), "gap or overlap").when(F.octet_length("data") < 14, "too short")
    found = found.select("source", "record", "iface", t_us.alias("t_us"), "data", reason.alias("reason"))
    noise = rows.filter("stamp = '' AND (hex = '' OR record = 0)").select("source", F.when(F.trim("value") == "", "blank").when(F.col("record") == 0, "before the first header").otherwise("other text").alias("reason"))
    skipped = noise.unionByName(found.filter("reason IS NOT NULL").select("source", "reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("lines"))
    return found.filter("reason IS NULL").drop("reason"), skipped


def application_events(lines: DataFrame) -> DataFrame:
    """Typed events of decoded records, none to several each; ``lines`` has source, row_id and value (JSON)."""
    parsed = lines.select("source", "row_id", F.from_json("value", "method string, uri string, status int, sni string, certificate string, syn boolean, fin boolean, rst boolean").alias("j"))

    def event(kind: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))

    j = F.col("j")
    made = F.array(
        event("request", j.method.isNotNull(), F.concat_ws(" ", j.method, j.uri)), event("response", j.status.isNotNull(), j.status), event("hello", j.sni.isNotNull(), j.sni),
        event("certificate", j.certificate.isNotNull(), F.sha2(j.certificate, 256)), event("open", F.coalesce(j.syn, F.lit(False)), F.lit(None)),
        event("close", F.coalesce(j.fin, F.lit(False)) | F.coalesce(j.rst, F.lit(False)), F.when(j.rst, "reset").otherwise("end")),
    )
    return parsed.select("source", "row_id", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("source", "row_id", "e.kind", "e.detail")


def overlay(rows: DataFrame, layer: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``layer`` in place where it has the row and a value."""
    names = [c for c in layer.columns if c not in by]
    fresh = layer.select(*by, *[F.col(c).alias(f"_n_{c}") for c in names])
    joined = rows.join(fresh, by, "left")
    return joined.select(*[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


LAYERS = "array<struct<proto:string,src:string,dst:string,sport:int,dport:int,length:int>>"


def layer_rows(lines: DataFrame) -> DataFrame:
    """The layers of nested decodes, one row each: plain without a tunnel, else outer, inner or middle.

    ``lines`` has source, row_id and value, a JSON array of address layers from the outside in.
    """
    parsed = lines.select("source", "row_id", F.from_json("value", LAYERS).alias("layers"))
    rows = parsed.select("source", "row_id", F.size("layers").alias("depth"), F.posexplode("layers").alias("at", "layer"))
    role = F.when(F.col("depth") == 1, "plain").when(F.col("at") == 0, "outer").when(F.col("at") == F.col("depth") - 1, "inner").otherwise("middle")
    return rows.select("source", "row_id", role.alias("role"), "layer.*")


def choose_layer(rows: DataFrame, layers: DataFrame, role: str) -> DataFrame:
    """``rows`` with the addresses and lengths of one layer; records without that layer keep their own."""
    wanted = layers.filter((F.col("role") == role) | (F.col("role") == "plain")).drop("role")
    return overlay(rows, wanted, ["source", "row_id"])


def protocol_fields(lines: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Scoped columns per protocol from JSON fields: ``names`` has the fields of each; others are null."""
    columns = [F.when(F.col("proto") == proto, F.get_json_object("value", f"$.{name}")).alias(f"{proto}_{name}") for proto, fields in names.items() for name in fields]
    return lines.select("source", "row_id", "proto", *columns)


def merged_fields(rows: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the map column fields extended by ``fresh``'s: its values win, a null removes nothing."""
    extra = fresh.select(*by, F.col("fields").alias("_f"))
    joined = rows.join(extra, by, "left")
    merged = F.when(F.col("_f").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.col("_f"), k)), F.col("_f")))
    return joined.withColumn("fields", merged).drop("_f")
