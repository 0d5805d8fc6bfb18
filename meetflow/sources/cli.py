"""Command line: load units and print them, or run an analysis over them."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meetflow")
    p.add_argument("--log-level", default="info", choices=["debug", "info", "warn", "error"])
    p.add_argument("--log-time", action="store_true")
    p.add_argument("--log-source", action="store_true")
    p.add_argument("--log-func", action="store_true")
    p.add_argument("--log-json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="read units and check them")
    analyze = sub.add_parser("analyze", help="blocks and reachable blocks of every function")
    for s in (load, analyze):
        s.add_argument("path")
        s.add_argument("--suffix", default=".pb")
    load.add_argument("--dump-txt", action="store_true")
    return p


def log(args: argparse.Namespace) -> logging.Logger:
    parts = {"level": "%(levelname)s"} | ({"time": "%(asctime)s"} if args.log_time else {}) | ({"source": "%(pathname)s:%(lineno)d"} if args.log_source else {})
    parts |= ({"func": "%(funcName)s"} if args.log_func else {}) | {"message": "%(message)s"}
    form = json.dumps(parts) if args.log_json else " ".join(parts.values())
    logging.basicConfig(stream=sys.stderr, level={"warn": "WARNING"}.get(args.log_level, args.log_level.upper()), format=form, force=True)
    return logging.getLogger("meetflow")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from ..functions.scalars import checked_kind
    from ..operators import graph
    from .text import dump
    from .wire import read_units

    args = parser().parse_args(argv)
    out = log(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        t = read_units(spark, args.path, args.suffix)
        if args.command == "load":
            rows = t["insn"].withColumn("ikind", checked_kind(F.col("ikind")))
            out.info("%d instructions", rows.agg(F.count("ikind")).collect()[0][0])
            if args.dump_txt:
                for r in dump(t).orderBy("tu_id", "part", "key", "seq").select("text").toLocalIterator():
                    print(r["text"])
        else:
            i = t["insn"].select("tu_id", "fid", "seq", "ikind", *[F.col("expr1")["op1"].alias(c) for c in ("label", "target")], F.col("expr2")["op1"].alias("true_label"), F.col("expr2")["op2"].alias("false_label"))
            for r in graph.block_table(graph.blocks(i, ["tu_id", "fid"]), ["tu_id", "fid"]).orderBy("tu_id", "fid", "bb").toLocalIterator():
                print(r["tu_id"], r["fid"], r["bb"], r["first_seq"], r["last_seq"])
    except Exception as e:  # the first error ends the run
        out.error("%s", str(e).splitlines()[0])
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
