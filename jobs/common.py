"""What the jobs share: their config, their log and their command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file, wherever Spark reads it, says otherwise; a name that means nothing is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"the config has unknown names: {', '.join(sorted(unknown))}")
    return defaults | given


def command_line(name: str, about: str, paths: tuple[str, ...], work: Callable[[SparkSession, argparse.Namespace], object]) -> None:
    """Parses the paths, starts a session, does the work, and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, args)
    finally:
        spark.stop()
