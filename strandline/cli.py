"""Command line: ``count``, ``signatures``, ``balance``, ``totals`` and ``distance``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandline.config import CounterConfig, DistanceConfig
from strandline.operators.distance import MEASURES
from strandline.plans.jobs import balance_job, count_job, distance_job, signature_job, totals_job

JOBS = {"count": count_job, "signatures": signature_job, "balance": balance_job, "totals": totals_job, "distance": distance_job}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description="Exact, strand-neutral k-mer analytics.")
    jobs = top.add_subparsers(dest="job", required=True)
    for name in JOBS:
        p = jobs.add_parser(name)
        p.add_argument("k", type=int, help="length of a k-mer")
        p.add_argument("m", type=int, help="length of a signature")
        p.add_argument("x", type=int, help="k-mers that a (k,x)-mer adds at most")
        p.add_argument("max_bins", type=int)
        p.add_argument("use_hash", type=int, choices=(0, 1), help="0: counts sorted in each bin")
        p.add_argument("sequence_type", type=int, choices=(0, 1), help="0: many short reads, 1: few long sequences")
        p.add_argument("input_path")
        p.add_argument("output_path")
        p.add_argument("prefix", nargs="?", default="")
        p.add_argument("write", nargs="?", type=int, choices=(0, 1), default=1)
        p.add_argument("binary", nargs="?", type=int, choices=(0, 1), default=0, help="1: Parquet instead of text")
        p.add_argument("balance", nargs="?", type=int, choices=(0, 1), default=0, help="1: bins placed by their size")
        p.add_argument("tasks", nargs="?", type=int, default=0)
        p.add_argument("--master")
        if name == "distance":
            p.add_argument("--measure", choices=sorted(MEASURES), default="squared_euclidean")
            p.add_argument("--normalize", action="store_true")
    return top


def config_of(args: argparse.Namespace) -> CounterConfig | DistanceConfig:
    common = {"k": args.k, "m": args.m, "x": args.x, "max_bins": args.max_bins, "long_sequences": bool(args.sequence_type), "input_path": args.input_path, "output_path": args.output_path, "write": bool(args.write)}
    if args.job == "distance":
        return DistanceConfig(**common, measure=args.measure, normalize=args.normalize)
    return CounterConfig(**common, use_hash=bool(args.use_hash), prefix=args.prefix, binary=bool(args.binary), balance=bool(args.balance), tasks=args.tasks)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"strandline-{args.job}")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    JOBS[args.job](spark, config_of(args))


if __name__ == "__main__":
    main()
