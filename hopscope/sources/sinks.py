"""Exports: a JSON report, tables as CSV in one ZIP, and comparison of reports."""

from __future__ import annotations

import csv
import io
import json
import math
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame

VERSION = 11
#: Rows of findings that a report holds; the count is always that of all.
MAX_FINDINGS = 200


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def report(sections: dict[str, DataFrame], limit: int = MAX_FINDINGS) -> dict:
    """One document of small tables: per section the number of rows and the first ``limit`` of them in their order."""
    out: dict = {"schema_version": VERSION}
    for name, frame in sections.items():
        out[name] = {"count": frame.count(), "rows": [_plain(r) for r in frame.limit(limit).collect()]}
    return out


def to_json(document: dict) -> str:
    return json.dumps(document, sort_keys=True, ensure_ascii=False, indent=1)


def csv_zip(tables: dict[str, DataFrame]) -> bytes:
    """Each table as a CSV file of a ZIP archive, row by row; for tables that a person reads."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, frame in tables.items():
            with z.open(f"{name}.csv", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                writer = csv.writer(text)
                writer.writerow(frame.columns)
                for row in frame.toLocalIterator():
                    writer.writerow(["" if v is None else _plain(v) for v in row])
    return out.getvalue()


def flatten(value, path: str = "$") -> Iterator[tuple[str, object]]:
    """(path, value) of all leaves."""
    if isinstance(value, dict):
        for k in sorted(value):
            yield from flatten(value[k], f"{path}.{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from flatten(v, f"{path}[{k}]")
    else:
        yield path, value


def check(value: object, expected: object, rule: dict) -> bool:
    """Whether a measured value meets its reference: one of abs_tol, rel_tol_pct, max, min, equals, window_tol_s."""
    (kind, limit), *more = rule.items()
    if more:
        raise ValueError("one rule a check")
    if kind == "equals":
        return value == limit
    if value is None or isinstance(value, str) and kind != "window_tol_s":
        return False
    if kind == "max":
        return value <= limit
    if kind == "min":
        return value >= limit
    if kind == "abs_tol":
        return abs(value - expected) <= limit
    if kind == "rel_tol_pct":
        return abs(value - expected) <= abs(expected) * limit / 100
    if kind == "window_tol_s":
        return all(abs(a - b) <= limit for a, b in zip(value, expected, strict=True))
    raise ValueError(f"unknown rule {kind}")


def compare_reference(document: dict, items: list[dict]) -> list[dict]:
    """Each item (id, metric, expected, check) with the value at its path and whether it holds; a missing value fails."""
    leaves = dict(flatten(document))
    out = []
    for item in items:
        value = leaves.get(item["metric"])
        if value is None:
            at = [v for p, v in leaves.items() if p.startswith(item["metric"] + "[")]
            value = at or None
        out.append({"id": item["id"], "value": value, "passed": check(value, item.get("expected"), item["check"])})
    return out


def compare_runs(a: dict, b: dict, skip: tuple[str, ...] = ("id", "evidence", "frame"), limit: int = 1000) -> dict:
    """What differs between two reports by path, ids and evidence aside: the first ``limit`` and how many there are."""

    def leaves(d: dict) -> dict[str, object]:
        return {p: v for p, v in flatten(d) if p.rsplit(".", 1)[-1].split("[")[0] not in skip}

    x, y = leaves(a), leaves(b)
    same = lambda p, q: p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9))
    paths = [p for p in sorted(x.keys() | y.keys()) if p not in x or p not in y or not same(x[p], y[p])]
    return {"count": len(paths), "differences": [{"path": p, "a": x.get(p), "b": y.get(p)} for p in paths[:limit]]}
