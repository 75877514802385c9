"""Registered queries: a Spark plan and, where SQL can express it, the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import observations

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: Words that the two dialects spell differently: here, in Spark, in the checking engine.
_SPELLING = (
    ("QUANTILE", "percentile", "quantile_cont"),
    ("LIST", "collect_list", "list"),
    ("JSON_TEXT", "get_json_object", "json_extract_string"),
    ("UNNEST", "explode", "unnest"),
    ("SERIES", "sequence", "generate_series"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    made = {"obs": observations.path_obs, "ev": observations.micro_events}
    return {n: made[n](table(spark, sf_dir, "events")) if n in made else table(spark, sf_dir, n) for n in names}


def checking_sql(text: str) -> str:
    """``text`` over the projections of the events table, in the checking engine's dialect."""
    for word, _, theirs in _SPELLING:
        text = re.sub(rf"\b{word}\b(?=\()", theirs, text)
    text = re.sub(r"\{(\w+)\}", r"\1", text).strip()
    head = f"WITH {observations.CHECKING_EVENTS}, {observations.CHECKING_OBS}"
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"{head.replace('WITH', 'WITH RECURSIVE', 1)}, {text[15:]}"
    return f"{head}, {text[5:]}" if text[:5].upper() == "WITH " else f"{head} {text}"


def portable(name: str, text: str) -> None:
    """A query whose one text both engines run; {obs}, {ev} and tables stand in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mine = text
        for word, ours, _ in _SPELLING:
            mine = re.sub(rf"\b{word}\b(?=\()", ours, mine)
        return spark.sql(mine, **sources(spark, sf_dir, sorted(set(re.findall(r"\{(\w+)\}", text)))))

    QUERIES[name], SQL[name] = run, checking_sql(text)


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of the frames that its parameters name."""

    def register(f: Callable) -> Callable:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(**sources(spark, sf_dir, list(names)))
        if sql:
            SQL[f.__name__] = checking_sql(sql)
        return f

    return register

