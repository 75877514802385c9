"""URL rules and a path-template tree, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, pack, unpack

#: Rules that are given as a list become one expression; larger sets belong into a joined table.
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null urls and urls without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null if none.

    ``rules`` has (verdict, host/path-start). A rule fits its host and all subdomains if the path
    starts with its own; the longest wins, of equally long ones the first by code point.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segment_class(segment: Column) -> Column:
    """A variable path segment as its class: {n} numbers, {h} hexadecimal ids, {s} slugs of many words."""
    named = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    bare = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(bare.rlike(r"^[0-9]+([-_.][0-9]+)*$"), F.lit("{n}"))
        .when(bare.rlike(r"^[0-9a-fA-F-]{8,}$") & bare.rlike("[0-9]"), F.lit("{h}"))
        .when(bare.rlike(r"^[^-_]+([-_][^-_]+){2,}$"), F.lit("{s}"))
    )
    return F.when(kind.isNotNull(), F.concat(kind, named)).otherwise(segment)


def _differ(l1: Column, b1: Column, l2: Column, b2: Column, z: float) -> Column:
    """Whether two shares of bad urls differ by more than ``z`` standard errors of their pooled share."""
    pooled = (b1 + b2) / (l1 + l2)
    return F.abs(b1 / l1 - b2 / l2) > z * F.sqrt(pooled * (1 - pooled) * (1 / l1 + 1 / l2))


def _groups(children: DataFrame, z: float) -> DataFrame:
    """(host, up, bin, g): the groups into which the labelled branches of each template merge.

    ``children`` has host, up, bin (the percentage of bad urls), cl and cb. Branches are pooled by percentage, so that a
    template has 101 bins at most; in their order a bin joins the last group if the two shares don't differ, else it
    starts the next.
    """
    bins = children.groupBy("host", "up", "bin").agg(F.sum("cl").alias("l"), F.sum("cb").alias("b"))
    rows = bins.groupBy("host", "up").agg(F.array_sort(F.collect_list(F.struct("bin", "l", "b"))).alias("bins"))
    start = F.expr("named_struct('l', 0L, 'b', 0L, 'g', -1, 'out', cast(array() AS array<struct<bin: bigint, g: int>>))")

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["l"] == 0) | _differ(acc["l"], acc["b"], x["l"], x["b"], z)
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"])
        total = [F.when(fresh, x[c]).otherwise(acc[c] + x[c]).alias(c) for c in ("l", "b")]
        return F.struct(*total, g.alias("g"), F.concat(acc["out"], F.array(F.struct(x["bin"].alias("bin"), g.alias("g")))).alias("out"))

    return rows.select("host", "up", F.explode(F.aggregate("bins", start, step, lambda acc: acc["out"])).alias("x")).select("host", "up", "x.bin", "x.g")


def template_tree(counts: DataFrame, min_rows: int, z: float, smoothing: float) -> DataFrame:
    """(host, classes, n, template, purity) for ``counts`` (host, classes, n, labelled, bad), one row per host and classes.

    Each host starts with one template, the root. Level by level, a template whose labelled urls are of both kinds and
    ``min_rows`` at least branches by the next class of its urls. Branches with ``min_rows`` urls of which some are labelled merge with each other
    where their shares of bad urls don't differ (``_groups``); rare and unlabelled ones are the wildcard ``*``. A group of one
    keeps its segment as its name, larger ones are ``*1``, ``*2``, ... by their share. A group's purity is its share of bad
    urls, shrunk by ``smoothing`` urls of the purity of the template above it, the root's by the overall share; so an unlabelled branch has the
    purity of its siblings together. Templates that branch no more end in ``/**``. Every level is reached that labels of both kinds reach.
    """
    whole = counts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("prior"))
    roots = counts.groupBy("host").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).crossJoin(F.broadcast(whole))  # one row
    roots = roots.select("host", "tl", "tb", ((F.col("tb") + smoothing * F.col("prior")) / (F.col("tl") + smoothing)).alias("purity"))
    rows, done, level = counts.join(roots, "host").withColumn("up", F.lit("")).checkpoint(), [], 0
    columns = ("host", "classes", "n", "template", "purity")
    while True:
        mixed = (F.size("classes") >= level) & (F.col("tl") >= min_rows) & (F.col("tb") > 0) & (F.col("tb") < F.col("tl"))
        ended = F.when(F.size("classes") > level, F.concat("up", F.lit("/**"))).otherwise(F.col("up"))
        done.append(rows.filter(~mixed).withColumn("template", ended).select(*columns))
        rows = rows.filter(mixed).withColumn("seg", F.coalesce(F.get("classes", F.lit(level)), F.lit("")))
        if rows.isEmpty():
            return reduce(DataFrame.union, done)
        child = rows.groupBy("host", "up", "seg").agg(F.sum("n").alias("cn"), F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"), F.first("purity").alias("above"))
        usable = (F.col("cn") >= min_rows) & (F.col("cl") > 0)
        child = child.withColumn("bin", F.when(usable, F.round(F.col("cb") * 100 / F.col("cl")).cast("long"))).checkpoint()
        named = child.join(_groups(child.filter("bin IS NOT NULL"), z), ["host", "up", "bin"], "left")
        group = named.groupBy("host", "up", "g").agg(F.sum("cl").alias("tl"), F.sum("cb").alias("tb"), F.count(F.lit(1)).alias("k"), F.first("above").alias("above"))
        group = group.select("host", "up", "g", "tl", "tb", "k", ((F.col("tb") + smoothing * F.col("above")) / (F.col("tl") + smoothing)).alias("purity"))
        joined = named.select("host", "up", "seg", "g").alias("c").join(group.alias("d"), F.expr("c.host = d.host AND c.up = d.up AND c.g <=> d.g"))
        name = F.when(F.col("c.g").isNull(), F.lit("*")).when(F.col("k") == 1, F.col("seg")).otherwise(F.concat(F.lit("*"), F.col("c.g") + 1))
        steps = joined.select(F.col("c.host").alias("host"), F.col("c.up").alias("up"), "seg", name.alias("name"), "tl", "tb", "purity")
        below = rows.drop("tl", "tb", "purity").join(steps, ["host", "up", "seg"])
        # Each level reads the last one's table several times; without a cut the plan doubles at each.
        rows = below.withColumn("up", F.concat("up", F.lit("/"), "name")).drop("seg", "name").checkpoint()
        level += 1


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    min_rows: int = 5,
    z: float = 3.0,
    smoothing: float = 10.0,
    cutoff: float = 0.8,
    url: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule, template and verdict (allow or block).

    Urls that a rule fits get its verdict and are the labelled ones. The others are judged by their
    template: path segments are generalised to classes, the branches of a host's tree are merged by
    ``template_tree``, and a template is rejected if its smoothed purity reaches ``cutoff``. template is given for the
    urls that this rejects. Without labels nothing is rejected. Null and odd urls have an empty host, a host
    like any other. Repeated rows count each; the caller's columns of the new names are replaced.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "template", "verdict")]
    host, path = host_and_path(F.col(f"row.`{url}`"))
    parts = pack(pages.select(*[F.col(f"`{c}`") for c in columns])).withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    classes = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_class)
    rows = parts.withColumns({"rule": rule, "given": verdict, "classes": classes})
    given = F.col("given")
    counts = rows.groupBy("host", "classes").agg(F.count(F.lit(1)).alias("n"), F.count(given).alias("labelled"), F.count_if(given == "block").alias("bad")).checkpoint()
    tree = template_tree(counts, min_rows, z, smoothing)
    # Only rejected templates go back to the urls: a small table, frequent keys broadcast.
    bad = tree.filter(F.col("purity") >= cutoff).select("host", "classes", "template", "n").checkpoint()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = hot_join(rows, bad, ["host", "classes"], "n", total)
    final = F.coalesce(given, F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return unpack(joined, columns, "host", "path", "rule", F.when(F.col("rule").isNull(), F.col("template")).alias("template"), final.alias("verdict"))
