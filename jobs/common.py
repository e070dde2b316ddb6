"""What the jobs share: configs, the files a table stands for, sessions of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")
HERE = Path(__file__).resolve().parent


def read_config(spark: SparkSession, path: str | None, name: str) -> dict:
    """The job's own config file, with the keys that another one (anywhere Spark reads) sets instead; a key that is not known is refused."""
    known = json.loads((HERE / f"{name}.json").read_text("utf-8"))
    if path is None:
        return known
    own = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if unknown := sorted(set(own) - set(known)):
        raise ValueError(f"{path}: unknown keys {unknown}")
    return known | own


def as_files(rows: DataFrame, config: dict) -> DataFrame:
    """path and text of each row: the path is made of the config's columns, joined by slashes without their nulls; a null text is empty."""
    parts: list[Column] = [F.col(c).cast("string") for c in config["path"]]
    return rows.select(F.concat_ws("/", *parts).alias("path"), F.coalesce(config["text"], F.lit("")).alias("text"))


def main(name: str, run: Callable, about: str, *more: str) -> None:
    """The command line: --input, --output and the job's further arguments, all paths, and --config. It alone makes a session and stops it."""
    asked = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for argument in ("input", "output", *more):
        asked.add_argument(f"--{argument}", required=True, help="a path that Spark reads")
    asked.add_argument("--config", help=f"a JSON file; its keys replace those of jobs/{name}.json")
    given = asked.parse_args()
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName(f"jobs.{name}").getOrCreate()
    try:
        run(spark, given.input, given.output, *[getattr(given, a) for a in more], read_config(spark, given.config, name))
    finally:
        spark.stop()
