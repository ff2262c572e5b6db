"""Command line: run, collect, queue, list-elements, reset, wtf, selftest."""

from __future__ import annotations

import argparse
import json
import logging
import platform
import sys
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from parcelkit.session import session

from . import pipeline


def selectors(items: list[str] | None) -> list | None:
    """Elements of the command line: texts, texts with commas for several keys, or files of such lines."""
    if not items:
        return None
    out: list = []
    for item in items:
        lines = Path(item).read_text().splitlines() if Path(item).is_file() else [item]
        for line in filter(None, map(str.strip, lines)):
            parts = [p.strip() for p in line.split(",")]
            out.append(parts if len(parts) > 1 else parts[0])
    return out


def wtf() -> dict:
    """Versions, for reports."""
    found = {"python": platform.python_version(), "system": platform.platform()}
    for name in ("pyspark", "numpy", "pyarrow", "pandas"):
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = None
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parcelkit")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "list-elements", "queue", "reset"):
        c = commands.add_parser(name)
        c.add_argument("config")
        c.add_argument("--element", action="append", help="an element, a list with commas, or a file of such lines")
        c.add_argument("--verbose", default="warning", choices=["debug", "info", "warning", "error"])
        if name == "run":
            c.add_argument("--overwrite", action="store_true", help="replace elements that are stored")
        if name == "list-elements":
            c.add_argument("--output", help="a file for the lines")
        if name == "queue":
            c.add_argument("--conf", action="append", default=[], help="key=value for the cluster")
    c = commands.add_parser("collect")
    c.add_argument("uri")
    c.add_argument("parts", nargs="+")
    c.add_argument("--keys")
    c.add_argument("--files", type=int, help="files of each feature")
    commands.add_parser("wtf")
    commands.add_parser("selftest")
    args = parser.parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("parcelkit").setLevel(getattr(args, "verbose", "warning").upper())
    if args.command == "wtf":
        print(json.dumps(wtf(), indent=2))
        return 0
    if args.command == "queue":
        print(pipeline.queue(args.config, **dict(x.split("=", 1) for x in args.conf)))
        return 0
    spark = session()
    if args.command == "selftest":
        print(spark.range(10).selectExpr("sum(id) AS s").first()["s"] == 45)
    elif args.command == "collect":
        pipeline.collect(spark, args.uri, args.parts, args.keys.split(",") if args.keys else None, args.files)
    else:
        config = pipeline.parse_yaml(args.config)
        if args.command == "run":
            pipeline.run(spark, config, selectors(args.element), args.overwrite)
        elif args.command == "list-elements":
            lines = (row["line"] for row in pipeline.list_elements(spark, config, selectors(args.element)).toLocalIterator())
            if args.output:
                with open(args.output, "w") as out:
                    out.writelines(f"{line}\n" for line in lines)
            else:
                for line in lines:
                    print(line)
        else:
            pipeline.reset(spark, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
