"""Reports as rows: pieces of text are put in order, measured and joined where they are, and written as files by Spark.

Only the names and sizes of reports reach the driver. A report over its limit is an
error before anything of it is joined or written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut

MB = 1 << 20
#: Where a run writes before its files get their names, below the folder of the reports.
WRITING = ".writing"


class TooLarge(ValueError):
    pass


def number(c: str | Column) -> Column:
    """A number as a key that sorts as text."""
    return F.format_string("%020d", F.col(c).cast("long") if isinstance(c, str) else c.cast("long"))


def pieces(rows: DataFrame, name: str | Column, part: int, text: Column, *order: str | Column) -> DataFrame:
    """name, part, order, piece: a piece of a report for each row. Pieces stand by part, then order, then text."""
    keys = F.array(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in order]) if order else F.array().cast("array<string>")
    return rows.select((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(part).alias("part"), keys.alias("order"), F.coalesce(text, F.lit("")).alias("piece"))


def made(rows: DataFrame, name: str | Column, part: int, line: Column, *order: str | Column) -> DataFrame:
    """A line for each row."""
    return pieces(rows, name, part, F.concat(F.coalesce(line, F.lit("")), F.lit("\n")), *order)


def fixed(spark: SparkSession, name: str, part: int, *said: str) -> DataFrame:
    """Lines that the driver knows."""
    return pieces(spark.range(0, 1, 1, 1), name, part, F.lit("".join(line + "\n" for line in said)))


def text(spark: SparkSession, name: str, whole: str) -> DataFrame:
    """A report that the driver has made."""
    return pieces(spark.range(0, 1, 1, 1), name, 0, F.lit(whole))


def otherwise(rows: DataFrame, name: str, part: int, *said: str) -> DataFrame:
    """rows, or these lines where there are none."""
    none = rows.agg(F.count("*").alias("n")).filter("n = 0")
    return rows.unionByName(made(none, name, part, F.lit("\n".join(said))))


def section(rows: DataFrame, name: str, part: int, before: str, after: str | None = "") -> DataFrame:
    """rows, with a line before and one after them; nothing where there are none. The rows are of part + 1."""
    held = cut(rows)
    out = held.unionByName(made(held.limit(1), name, part, F.lit(before)))
    return out if after is None else out.unionByName(made(held.limit(1), name, part + 2, F.lit(after)))


def inline(rows: DataFrame, name: str, part: int, key: str, head: str, none: str = "-") -> DataFrame:
    """One line: head, and the distinct values of a column with commas between them."""
    held = cut(rows.select(key).distinct())
    least = held.agg(F.min(key)).first()[0]
    if least is None:
        return fixed(rows.sparkSession, name, part, head + none)
    said = F.when(F.col(key) == least, F.concat(F.lit(head), key)).otherwise(F.concat(F.lit(", "), key))
    return pieces(held, name, part, said, key).unionByName(pieces(rows.sparkSession.range(0, 1, 1, 1), name, part + 1, F.lit("\n")))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def measured(held: DataFrame) -> DataFrame:
    """name, bytes."""
    return held.groupBy("name").agg(F.sum(F.octet_length("piece").cast("long")).alias("bytes"))


def joined(lines: DataFrame, block_mb: float = 5, warn_mb: float = 1) -> tuple[DataFrame, list[str], list[str]]:
    """name, text of each report; their names; warnings on large ones. One over block_mb is an error."""
    held = cut(lines)
    sizes = measured(held).orderBy("name").collect()
    for s in sizes:
        if s.bytes > block_mb * MB:
            raise TooLarge(f"{s.name} has {s.bytes / MB:.2f} MB, over {block_mb} MB")
    in_order = F.array_sort(F.collect_list(F.struct("part", "order", "piece")))
    texts = held.groupBy("name").agg(F.array_join(F.transform(in_order, lambda x: x["piece"]), "").alias("text"))
    return texts, [s.name for s in sizes], [f"{s.name} has {s.bytes / MB:.2f} MB, over {warn_mb} MB" for s in sizes if s.bytes > warn_mb * MB]


def one(lines: DataFrame, block_mb: float = 5) -> str:
    """The text of a single report, for a caller who asks for it; within the limit."""
    return joined(lines, block_mb)[0].first().text


def write(lines: DataFrame, folder: str, block_mb: float = 5, warn_mb: float = 1, purge: bool = False, keep: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Writes reports to a folder of any store; their names, and warnings.

    Each is one row, which a task writes as one file; files are then renamed to their
    names, over those of an earlier run, so a reader finds the old report or the new
    one. With purge, Markdown files that are no report of this run go. Names in keep
    are written only where no such file is. What a run that broke off has left is
    replaced; one run at a time writes to a folder.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    base = fs.makeQualified(path(folder))
    texts, names, warnings = joined(lines, block_mb, warn_mb)
    kept = [n for n in keep if fs.exists(path(base, n))]
    writing = path(base, WRITING)
    try:
        rows = texts.filter(~F.col("name").isin(kept)) if kept else texts
        body = F.substring("text", F.lit(1), F.greatest(F.char_length("text") - F.endswith("text", F.lit("\n")).cast("int"), F.lit(0)))  # the writer ends each row with a line feed
        rows.select(body.alias("text"), F.md5(F.col("name").cast("binary")).alias("id")).write.mode("overwrite").option("compression", "none").partitionBy("id").text(writing.toString())
        if purge:
            _purge(fs, base, set(names))
        over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        for n in names:
            if n not in kept:
                [file] = fs.globStatus(path(writing, f"id={hashlib.md5(n.encode()).hexdigest()}/part-*"))
                fs.mkdirs(path(base, n).getParent())
                files.rename(file.getPath(), path(base, n), over)
    finally:
        fs.delete(writing, True)
    return names, warnings


def _purge(fs, base, names: set[str]) -> None:
    """Deletes Markdown files that are no report; their names are all that is listed."""
    found, head = fs.listFiles(base, True), base.toUri().getPath().rstrip("/") + "/"
    while found.hasNext():
        file = found.next().getPath()
        name = file.toUri().getPath().removeprefix(head)
        if name.endswith(".md") and not name.startswith(WRITING) and name not in names:
            fs.delete(file, False)
