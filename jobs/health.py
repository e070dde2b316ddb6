"""Health report of a collection of text files: which files need work, area by area.

    python -m jobs.health --input TABLE --output FOLDER [--config FILE]

Reads a Parquet table of texts, each of which is a file at a path made of columns, and
writes two tables, both partitioned by area, the first folder of a path:

- files: an inventory with a row for each file (path, lines, size, sha256, findings);
- report: a row for each finding (a large file, a line with a tag, a hard-coded secret,
  a copy of another file) with its priority, and one of type `summary` for each area.

A run without `areas` in its config replaces both tables. With `areas`, a list, it
replaces the partitions of those areas and leaves the others; copies are still looked
for in all areas of the inventory. Either gives the same tables when it is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import as_files, log, main
from tessera.functions import names, paths
from tessera.operators import quality

FINDING = "struct<type:string,severity:string,kritik:boolean,detail:string,line:int>"
FILES = f"path string, lines int, size long, sha256 string, findings array<{FINDING}>, area string"
REPORT = "path string, type string, severity string, kritik boolean, detail string, line int, priority int, area string"


def _finding(type: str, severity: str, kritik: bool, detail: Column, line: Column) -> Column:
    return F.struct(F.lit(type).alias("type"), F.lit(severity).alias("severity"), F.lit(kritik).alias("kritik"), detail.alias("detail"), line.cast("int").alias("line"))


def inventory(files: DataFrame, config: dict) -> DataFrame:
    """files: path, text. A row for each with its facts and the findings that its own text gives, in one pass."""
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda content, i: F.struct(content.alias("content"), (i + 1).alias("line")))
    tagged = F.filter(numbered, lambda x: x["content"].rlike(f"(?i)({config['tags']})"))
    tags = F.transform(tagged, lambda x: _finding("fix_tag", "dusuk", False, F.concat_ws(": ", names.tag(x["content"], config["tags"]), names.tag_text(x["content"])), x["line"]))
    secret = F.regexp_count("text", F.lit(config["secret"]))
    none = F.lit(None)
    large = F.when(F.col("lines") > config["large"], F.array(_finding("buyuk_dosya", "orta", False, F.format_string("%d lines", "lines"), none))).otherwise(F.array())
    secrets = F.when(secret > 0, F.array(_finding("security_hardcoded_secret", "yuksek", True, F.format_string("%d times", secret), none))).otherwise(F.array())
    known = files.withColumn("lines", paths.line_count("text"))
    return known.select("path", "lines", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.concat(large, secrets, tags).cast(f"array<{FINDING}>").alias("findings"), F.coalesce(F.nullif(paths.subsystem("path"), F.lit("")), F.lit("_root")).alias("area"))


def copies(files: DataFrame) -> DataFrame:
    """A finding for each file whose content a file before it (by path) has too; empty files are no copies. Paths and hashes only are shuffled."""
    filled = files.filter("size > 0").select("path", "area", "sha256")
    first = filled.groupBy("sha256").agg(F.min("path").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return filled.join(first, "sha256").filter("path > first").select("path", "area", _finding("copy", "orta", False, F.concat(F.lit("of "), "first"), F.lit(None)).alias("found"))


def report(files: DataFrame) -> DataFrame:
    """files: an inventory. All findings with their priorities, and a summary of each area."""
    own = files.select("path", "area", F.explode("findings").alias("found"))
    every = own.unionByName(copies(files)).select("path", "found.*", "area")
    ranked = every.withColumn("priority", quality.priority().cast("int"))
    found = ranked.groupBy("area").agg(F.count("*").alias("findings"), F.count_if("kritik").alias("critical"))
    areas = files.groupBy("area").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))
    whole = areas.join(found, "area", "left").na.fill(0, ["findings", "critical"])
    said = F.format_string("%d files, %d lines, %d findings, %d critical", "files", "lines", "findings", "critical")
    none = F.lit(None).cast("string")
    summary = whole.select(none.alias("path"), F.lit("summary").alias("type"), none.alias("severity"), F.lit(False).alias("kritik"), said.alias("detail"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("priority"), "area")
    return ranked.select(summary.columns).unionByName(summary)


def _write(df: DataFrame, place: str, areas: list[str] | None) -> None:
    """Replaces a table, or the partitions of some areas."""
    chosen = df if areas is None else df.filter(F.col("area").isin(areas))
    chosen.write.mode("overwrite").option("partitionOverwriteMode", "static" if areas is None else "dynamic").partitionBy("area").parquet(place)


def run(spark: SparkSession, source: str, output: str, config: dict) -> None:
    """The job: texts below source, tables below output."""
    rows = spark.read.schema(config["schema"]).parquet(source)
    log.info("health: read %d rows of %s", rows.count(), source)
    _write(inventory(as_files(rows, config), config), f"{output}/files", config["areas"])
    files = spark.read.schema(FILES).parquet(f"{output}/files")
    _write(report(files), f"{output}/report", config["areas"])
    log.info("health: wrote %d files and %d rows of report below %s", *[t.count() for t in written(spark, output)], output)


def written(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The inventory and the report that a run wrote."""
    return spark.read.schema(FILES).parquet(f"{output}/files"), spark.read.schema(REPORT).parquet(f"{output}/report")


if __name__ == "__main__":
    main("health", run, "Health report of a collection of text files.")
