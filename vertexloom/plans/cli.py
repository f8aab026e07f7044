"""Command line: `submit` runs or describes a job; `suite` inspects, extracts, or runs a described dataset."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..errors import VertexloomError
from ..sources.datasets import extract_archive, largest_text_file, list_files, read_properties, sniff_format
from . import benchmark_suite
from .jobs import CheckpointSpec, FileSource, JobService, JobSpec, dry_run, new_job_id, run_job
from .sinks import print_sorted


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vertexloom")
    kinds = top.add_subparsers(dest="command", required=True)
    s = kinds.add_parser("submit")
    s.add_argument("--algorithm", required=True, choices=["wcc", "pagerank", "sssp"])
    s.add_argument("--vertices", required=True)
    s.add_argument("--edges", required=True)
    s.add_argument("--format", default="csv", choices=["csv", "parquet"])
    s.add_argument("--iterations", type=int, default=10)
    s.add_argument("--alpha", type=float, default=0.85)
    s.add_argument("--source", type=int)
    s.add_argument("--undirected", action="store_true")
    s.add_argument("--parallelism", type=int, default=4)
    s.add_argument("--mode", default="local", choices=["local", "distributed"])
    s.add_argument("--job-id")
    s.add_argument("--checkpoint-enabled", action="store_true")
    s.add_argument("--checkpoint-interval", type=int, default=0)
    s.add_argument("--checkpoint-dir", default="")
    s.add_argument("--dry-run", action="store_true")
    g = kinds.add_parser("suite")
    steps = g.add_subparsers(dest="step", required=True)
    x = steps.add_parser("extract")
    x.add_argument("archive")
    x.add_argument("folder")
    steps.add_parser("inspect").add_argument("folder")
    for name in ("run-wcc", "run-pagerank", "run-all"):
        r = steps.add_parser(name)
        r.add_argument("properties")
        r.add_argument("--out")
        r.add_argument("--wcc-iterations", type=int, default=50)
        r.add_argument("--pr-iterations", type=int, default=10)
        r.add_argument("--alpha", type=float, default=0.85)
        r.add_argument("--workers", type=int, help="partitions that vertices and edges are dealt to")
    h = kinds.add_parser("serve")
    h.add_argument("--host", default="127.0.0.1")
    h.add_argument("--port", type=int, default=8080)
    return top


def spec_of(args: argparse.Namespace) -> JobSpec:
    return JobSpec(
        args.job_id or new_job_id(), args.algorithm, FileSource(args.vertices, args.format), FileSource(args.edges, args.format), args.iterations, args.alpha, args.source, args.undirected,
        args.parallelism, args.mode, args.algorithm, CheckpointSpec(args.checkpoint_enabled, args.checkpoint_interval, args.checkpoint_dir),
    ).validated()


def session() -> SparkSession:
    return SparkSession.builder.appName("vertexloom").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "submit":
            spec = spec_of(args)
            if args.dry_run:
                print(dry_run(spec))
            else:
                print_sorted(run_job(session(), spec).vertices)
        elif args.command == "serve":
            from .http_api import server

            server(JobService(session()), args.host, args.port).serve_forever()
        elif args.step == "extract":
            extract_archive(args.archive, args.folder)
        elif args.step == "inspect":
            best = largest_text_file(args.folder)
            print(json.dumps({"files": list_files(args.folder), "largest": best, "format": asdict(f) if best and (f := sniff_format(best[0])) else None}))
        else:
            names = benchmark_suite.RUNS if args.step == "run-all" else (args.step.removeprefix("run-"),)
            reports = benchmark_suite.run(session(), read_properties(args.properties), names, args.wcc_iterations, args.pr_iterations, args.alpha, args.out, args.workers)
            print(json.dumps(reports, sort_keys=True))
            return 0 if all(r["passed"] for r in reports.values()) else 1
    except VertexloomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
