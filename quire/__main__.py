"""Command line: ``doctor``, ``eval`` and ``run`` over tables, with fixed exit codes."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import evaluate, pages, review
from quire.sources import scans, sinks

#: Exit codes, which scripts rely on (2 is the parser's own).
FINE, FAILED, USAGE, ENVIRONMENT = 0, 1, 2, 3
REPORT = "host string, tesseract boolean, languages array<string>, kraken boolean, models int, torch boolean, torch_coherent boolean, pdf boolean"


def environment(spark: SparkSession, models: str) -> DataFrame:
    """What this machine has, as a report of one row. Pages of PDF files are read without a library, so they always are."""
    found = shutil.which("tesseract")
    listed = subprocess.run([found, "--list-langs"], capture_output=True, text=True, timeout=30).stdout.split("\n")[1:] if found else []
    has = lambda name: importlib.util.find_spec(name) is not None
    row = ("driver", found is not None, [x.strip() for x in listed if x.strip()], has("kraken"), len(list(Path(models).glob("*.mlmodel"))), has("torch"), has("torchvision") or not has("torch"), True)
    return spark.createDataFrame([row], REPORT)


def doctor(spark: SparkSession, args) -> int:
    problems = pages.environment_problems(environment(spark, args.models)).first()["problems"]
    print(json.dumps({"problems": problems}, ensure_ascii=False))
    return ENVIRONMENT if problems else FINE


def score(spark: SparkSession, args) -> int:
    """Pairs (script, reference, hypothesis) against a baseline (script, cer, wer); worse scripts fail the command."""
    report = evaluate.evaluate(spark.read.parquet(args.pairs))
    if args.baseline is None:
        print("\n".join(report.toJSON().collect()))  # a row per script
        return FINE
    found = evaluate.regressions(report, spark.read.parquet(args.baseline), args.tolerance)
    print("\n".join(found.toJSON().collect()))
    return FAILED if found.filter("regressed").limit(1).count() else FINE


def run(spark: SparkSession, args) -> int:
    """Scans a folder of files and writes their pages; files without a good page fail the command, the others' pages are there all the same."""
    found = scans.pages(scans.files(spark, args.input))
    sinks.replace_folder(found, args.output)
    written = spark.read.parquet(args.output)
    failures = F.when(F.col("error").isNotNull(), F.array(F.lit("IngestError"))).otherwise(F.array().cast("array<string>"))
    jobs = review.job_outcome(written.select(F.col("path").alias("doc_id"), "page_no", failures.alias("failures")))
    none = spark.createDataFrame([], "problem string")
    return pages.exit_code(none, jobs).first()["exit_code"]


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, work, options in (
        ("doctor", doctor, {"--models": {"default": "models"}}),
        ("eval", score, {"pairs": {}, "--baseline": {"default": None}, "--tolerance": {"type": float, "default": 0.0}}),
        ("run", run, {"input": {}, "output": {}}),
    ):
        command = commands.add_parser(name, help=work.__doc__)
        command.set_defaults(work=work)
        for option, how in options.items():
            command.add_argument(option, **how)
    try:
        args = parser.parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    session = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        return args.work(session, args)
    except Exception as error:  # a command's failure is its exit code
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
