"""Quality rules whose cutoffs keep a stated risk, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, pack, unpack

#: Statistics of a text, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Each rule is a whole number that is larger for worse texts; a text above the cutoff is rejected.
RULES = {
    "long_words": "least(1000, (10 * word_chars) div n_words)",
    "short_words": "1000 - least(1000, (10 * word_chars) div n_words)",
    "symbols": "least(1000, (100 * n_symbols) div n_words)",
    "dup_lines": "(100 * n_dup_lines) div n_lines",
    "repeat_words": "(100 * n_repeat_words) div n_words",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: Up to so many strata the cutoffs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 50_000


def _repeat_words(hashes: str) -> Column:
    """Words in five-word windows that occur twice or more, from the array of word hashes.

    ``transform(array(x), v -> ...)`` binds x to v, so that it is computed once a text. Equal
    windows are neighbours once sorted by hash; the flagged starts, sorted again, say how many
    words each window adds.
    """
    grams = f"""transform(array({hashes}), a -> CASE WHEN size(a) < 5 THEN array() ELSE
        transform(sequence(0, size(a) - 5), i -> xxhash64(a[i], a[i + 1], a[i + 2], a[i + 3], a[i + 4])) END)[0]"""
    flagged = """transform(array(array_sort(transform(sequence(0, size(g) - 1), i -> struct(g[i] AS h, i AS p)))), s ->
        array_sort(filter(transform(sequence(0, size(s) - 1), i ->
            CASE WHEN get(s, i - 1).h = s[i].h OR get(s, i + 1).h = s[i].h THEN s[i].p END), p -> p IS NOT NULL)))[0]"""
    covered = f"""transform(array({flagged}), f ->
        aggregate(sequence(0, size(f) - 1), 0L, (n, i) -> n + least(5, coalesce(get(f, i + 1) - f[i], 5))))[0]"""
    return F.expr(f"transform(array({grams}), g -> CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {covered} END)[0]")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES, all long.

    Null and empty texts have no words: all measures are 0. Windows are compared by 64-bit hashes of
    word hashes within one text only. Columns of these names that ``docs`` has are replaced.
    """
    columns = docs.drop(*MEASURES).columns
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    rows = pack(docs.select(*[F.col(f"`{c}`") for c in columns]), "text").withColumns({"hashes": words, "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    return unpack(
        rows,
        columns,
        F.size("hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("hashes").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _allowed(n: str, risk: float, log_delta: str) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= delta, -1 if none: the exact bound, in logarithms."""
    odds = math.log(risk / (1 - risk))
    return F.expr(f"""aggregate(
        sequence(0L, cast(floor({n} * {risk}D) AS BIGINT)),
        named_struct('term', {n} * {math.log1p(-risk)!r}D, 'total', cast('-Infinity' AS DOUBLE), 'k', -1L),
        (a, i) -> transform(array(CASE WHEN a.total = cast('-Infinity' AS DOUBLE) THEN a.term
                ELSE greatest(a.total, a.term) + ln(1D + exp(-abs(a.total - a.term))) END), t ->
            named_struct('term', a.term + ln(({n} - i) / (i + 1D)) + {odds!r}D, 'total', t, 'k', CASE WHEN t <= {log_delta} THEN i ELSE a.k END))[0],
        a -> a.k)""")


def learn_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per stratum with a cutoff for each rule (null: the rule rejects nothing there).

    Of texts labelled good that the base rules keep, all rules together falsely reject at most a
    share ``risk`` in every stratum, with probability 1 - ``delta``: each rule may reject
    risk / rules; its cutoffs are tested from the mildest on by the exact binomial (Clopper-Pearson)
    bound, a fixed sequence that needs no correction; rules and strata share delta (Bonferroni).
    A stratum with too few labels gets no cutoff. Null strata are a stratum of their own. Labels
    with a null id or quality are left out; of several labels of one id the lowest quality counts.
    """
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = measured.filter(f"NOT ({BASE_FAILED})").select("doc_id", F.col(stratum).alias("stratum"), *[F.expr(e).alias(r) for r, e in RULES.items()])
    held = held.join(good.select("doc_id"), "doc_id", "left_semi")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("score")) for r in RULES])).alias("x")
    counts = held.select("stratum", pairs).groupBy("stratum", "x.rule", "x.score").agg(F.count(F.lit(1)).alias("n_at"))
    group = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n_at").over(group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = counts.withColumn("above", above).withColumn("n", F.sum("n_at").over(group))
    sizes = seen.groupBy("stratum").agg(F.max("n").alias("n")).withColumn("strata", F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    log_delta = f"ln({delta}D / (strata * {len(RULES)}D))"
    sizes = sizes.select("stratum", _allowed("n", risk / len(RULES), log_delta).alias("allowed"))
    chosen = seen.alias("a").join(sizes.alias("b"), F.expr("a.stratum <=> b.stratum")).filter("above <= allowed")
    return chosen.groupBy(F.col("a.stratum").alias("stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("score"))).alias(f"max_{r}") for r in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept; no row is dropped.

    kept is false if the base rules fail, or any rule's score is above its stratum's cutoff.
    """
    cut = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    columns = [c for c in measured.columns if c not in ("base_failed", "kept")]
    rows = pack(measured.select(*[F.col(f"`{c}`") for c in columns]), *MEASURES).withColumn("base_failed", F.expr(BASE_FAILED))
    joined = rows.join(cut, F.col(f"row.`{stratum}`").eqNullSafe(F.col("stratum")), "left")
    over = F.lit(False)
    for rule, score in RULES.items():
        over = over | F.coalesce(F.expr(f"{score} > max_{rule}"), F.lit(False))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~over)
    return unpack(joined, columns, "base_failed", kept.alias("kept"))
