"""Command line: analyse records, compare reports, list a container's inventory."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .operators.findings import headline
from .plans.analyze import analyse
from .plans.topology import Point, Topology
from .session import build_session, shared_dir
from .sources import containers, sinks


def read_topology(text: str) -> Topology:
    raw = json.loads(text)
    raw["points"] = tuple(Point(**p) for p in raw["points"])
    for name in ("forward", "reverse", "client_cidrs"):
        if name in raw:
            raw[name] = tuple(raw[name])
    return Topology(**raw)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hopscope")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyse", help="records (Parquet) and a topology (JSON) to a report")
    run.add_argument("records")
    run.add_argument("topology")
    run.add_argument("out")
    diff = commands.add_parser("compare", help="what differs between two reports")
    diff.add_argument("a")
    diff.add_argument("b")
    look = commands.add_parser("inventory", help="the framing of a recording")
    look.add_argument("uri")
    args = parser.parse_args(argv)
    if args.command == "inventory":
        print(json.dumps(containers.inventory(args.uri)))
    elif args.command == "compare":
        found = sinks.compare_runs(*(json.loads(Path(p).read_text()) for p in (args.a, args.b)))
        print(json.dumps(found, indent=1))
        return int(found["count"] > 0)
    else:
        spark = build_session()
        shared_dir(spark)
        result = analyse(spark.read.parquet(args.records), read_topology(Path(args.topology).read_text()))
        document = sinks.report(result.sections()) | {"clocks": result.clocks}
        document["headlines"] = [headline(r) for r in document["segments"]["rows"]]
        Path(args.out).write_text(sinks.to_json(document))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
