"""What the jobs share: command lines with a config file, sessions, logging, and the facts of a run."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from latticeq.session import make_session


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def settings(path: str | None, defaults: dict, **given: object) -> dict:
    """The defaults, replaced by what a config file and then the arguments say; names that no default has are errors."""
    said = json.loads(Path(path).read_text()) if path else {}
    unknown = sorted(set(said) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}; known: {', '.join(sorted(defaults))}")
    return defaults | said | {name: value for name, value in given.items() if value is not None}


def counts(df: DataFrame, *by: str) -> list[dict]:
    """Rows by the named columns, a few groups, for the log."""
    return [row.asDict() for row in df.groupBy(*by).count().orderBy(*by).collect()]


def main(name: str, description: str, paths: dict[str, str], config: Path, defaults: dict, run: Callable[..., object]) -> None:
    """The command line of a job: one argument for each path, the config file, and a master for local runs. Makes the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=description)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", default=str(config), help="JSON file of settings (default: %(default)s)")
    parser.add_argument("--cpus", default=None, help="threads of a local run; without it, the session of the submitting tool is used")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = make_session(name, args.cpus) if args.cpus else SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{path: getattr(args, path) for path in paths}, config=settings(args.config, defaults))
    finally:
        spark.stop()
