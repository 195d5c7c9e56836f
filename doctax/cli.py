"""Command line: extract, eval, battery."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    from .shipping import ship

    spark = SparkSession.builder.appName("doctax").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _evaluated(spark, result: str, truth: list[str], min_recall: float, min_precision: float) -> dict:
    from pyspark.sql import functions as F

    from .operators import evaluate
    from .sources import documents

    expected = documents.ground_truth(spark, truth).select("risk_id")
    found = spark.read.parquet(f"{result}/matches.parquet").select("risk_id")
    sets = evaluate.compared(expected, found, ["risk_id"]).withColumn("scope", F.lit("all"))
    row = evaluate.scored(sets, ["scope"], 3).withColumn("passed", evaluate.passed(F.col("recall"), F.col("precision"), min_recall, min_precision)).first()
    return row.asDict() if row else {"passed": False}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="doctax")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="documents to matches")
    extract.add_argument("files", nargs="+")
    extract.add_argument("-o", "--output", required=True)
    extract.add_argument("--catalogue", required=True, help="Parquet table of the catalogue")
    extract.add_argument("--provider", default="lexical")
    extract.add_argument("--no-judge", action="store_true")
    extract.add_argument("--no-grounding", action="store_true")
    extract.add_argument("--no-cross-encoder", action="store_true")
    extract.add_argument("--chunk-tokens", type=int, default=512)
    extract.add_argument("--format", choices=("json", "yaml", "both"), default="json")
    judge = commands.add_parser("eval", help="matches against ground truth")
    judge.add_argument("run")
    judge.add_argument("-g", "--ground-truth", nargs="+", required=True)
    for p in (judge,):
        p.add_argument("--min-recall", type=float, default=0.8)
        p.add_argument("--min-precision", type=float, default=0.6)
    battery = commands.add_parser("battery", help="a YAML file of runs")
    battery.add_argument("file")
    battery.add_argument("-o", "--output", required=True)
    battery.add_argument("--catalogue", required=True)
    args = parser.parse_args(argv)
    spark = _session()
    if args.command == "eval":
        scores = _evaluated(spark, args.run, args.ground_truth, args.min_recall, args.min_precision)
        Path(args.run, "eval.json").write_text(json.dumps(scores))
        print("PASS" if scores["passed"] else "FAIL", json.dumps(scores))
        return 0 if scores["passed"] else 1
    from pyspark.sql import functions as F

    from .config import RunConfig
    from .plans.pipeline import run_extraction
    from .sources import documents, sinks

    catalogue = spark.read.parquet(args.catalogue)
    if args.command == "battery":
        data = documents.load_yaml(args.file)
        runs = documents.resolve_runs(data.get("runs", []))
        config, provider, formats = RunConfig(max_context=data.get("max_context", 16384)), "lexical", ("parquet", "json")
    else:
        runs = {"": args.files}
        config = RunConfig(chunk_tokens=args.chunk_tokens, use_judge=not args.no_judge, use_grounding=not args.no_grounding, use_cross_encoder=not args.no_cross_encoder)
        provider, formats = args.provider, ("parquet", "json", "yaml") if args.format == "both" else ("parquet", args.format)
    for name, files in runs.items():
        docs = documents.read_documents(spark, files).select(F.col("source").alias("doc_id"), F.col("content").alias("text"))
        result = run_extraction(docs, catalogue, config, provider)
        sinks.write_results(result["merged"], str(Path(args.output, name)), formats)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
