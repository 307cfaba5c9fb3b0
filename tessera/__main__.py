"""Command line: collect samples, evaluate corpora, report on logs.

    python -m tessera collect SPECS.json OUT          several sites in one job
    python -m tessera evaluate CORPORA OUT --model-type repeat
    python -m tessera report LOGS --metric bpb

SPECS is a list of objects with ``input`` (Parquet), ``text``, ``key`` and the fields of a
``CollectSpec``. A site that fails is reported and does not stop the others.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import CollectSpec, collect, corpus_stats
from tessera.operators.report import METRICS, html_table, leaderboard
from tessera.operators.scoring import EvaluationConfig, evaluate, with_retries
from tessera.plans.ship import ship
from tessera.sources.files import read_corpora, read_run_logs
from tessera.sources.sinks import export_corpora, write_run_logs


def _collect(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, str, int, str]]:
    with open(args.specs) as file:
        specs = json.load(file)
    status = []
    for spec in specs:
        source = {k: spec.pop(k) for k in ("input", "text", "key")}
        site = CollectSpec(**spec)

        def run(source=source, site=site) -> None:
            samples = collect(spark.read.parquet(source["input"]), site, source["text"], source["key"])
            export_corpora(samples, f"{args.out}/{site.dataset}")

        status.append((site.dataset, *with_retries(run, args.attempts, args.pause)))
    return status


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, str, int, str]]:
    corpora = read_corpora(spark, args.corpora)
    corpus_stats(corpora, "text", "dataset").show(truncate=False)
    config = EvaluationConfig(
        args.model, args.corpora, args.model_type, add_bos=args.add_bos, chunk_size=args.chunk_size, batch_size=args.batch_size
    )
    run = lambda: write_run_logs(evaluate(corpora, config), args.out)
    return [(args.model, *with_retries(run, args.attempts, args.pause))]


def _report(spark: SparkSession, args: argparse.Namespace) -> list:
    logs = read_run_logs(spark, args.logs).withColumns(
        {"ingested_at": F.col("run_ts"), "run_id": F.md5(F.to_json(F.struct("model_name_or_path", "data_path", "neg_log_prob_sum")))}
    )
    board = leaderboard(logs, args.metric).orderBy("position")
    print(html_table(board, f"Average {args.metric}, lower is better")) if args.html else board.show(100, truncate=False)
    return []


def main(argv: list[str] | None = None) -> int:
    """Run a command; 1 if anything failed."""
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("collect")
    one.add_argument("specs")
    one.add_argument("out")
    one.set_defaults(run=_collect)
    two = commands.add_parser("evaluate")
    two.add_argument("corpora")
    two.add_argument("out")
    two.add_argument("--model", default="local/model")
    two.add_argument("--model-type", default="uniform")
    two.add_argument("--chunk-size", type=int, default=1024)
    two.add_argument("--batch-size", type=int, default=1)
    two.add_argument("--add-bos", action="store_true")
    two.set_defaults(run=_evaluate)
    three = commands.add_parser("report")
    three.add_argument("logs")
    three.add_argument("--metric", choices=METRICS, default="bpc")
    three.add_argument("--html", action="store_true")
    three.set_defaults(run=_report)
    for command in (one, two):
        command.add_argument("--attempts", type=int, default=3)
        command.add_argument("--pause", type=float, default=10)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    status = args.run(spark, args)
    for name, outcome, attempts, error in status:
        print(f"{name}: {outcome} after {attempts} attempts {error}".rstrip(), file=sys.stderr)
    return int(any(s[1] == "failed" for s in status))


if __name__ == "__main__":
    sys.exit(main())
