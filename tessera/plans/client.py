"""What a client of the caller's says of files: it is asked by tasks, batch by batch, and its faults stay in the rows of the batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from .tables import cut

#: What a client is asked about, if the caller does not say; fixed values.
TYPES = ("architecture_map", "project_purpose", "tech_infrastructure", "dev_status", "errors_missing", "dead_code")
#: Lines that a file has to be sent, and words that its name has not.
LINES, LEFT_OUT = (30, 5000), ("test", "spec")
ANSWER = "batch int, path string, what string, text string, error string"


def row_maps(files: DataFrame) -> DataFrame:
    """The row that a client gets of each file: names only, no line ranges."""
    named = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["name"])
    return files.select(F.col("path").alias("rel_path"), "lines", "doc", named("classes").alias("classes"), named("functions").alias("functions"), "imports", "parse_error")


def chosen(rows: DataFrame, most: int) -> DataFrame:
    """The files that are sent: those that parse, of fitting length, no tests, the first `most` by path."""
    name = F.lower(paths.basename("rel_path"))
    fit = ~F.col("parse_error") & F.col("lines").between(*LINES)
    for word in LEFT_OUT:
        fit = fit & ~F.contains(name, F.lit(word))
    return rows.filter(fit).orderBy("rel_path").limit(most)


def _asked(client, rows: list[dict], types: list[str], retries: int, pause: float) -> dict:
    """The client's answer to a batch; after so many retries its last fault is raised. Without the method it is not tried again."""
    if not hasattr(client, "analyze_files"):
        raise NotImplementedError("the client has no analyze_files(files, types)")
    for left in range(retries, -1, -1):
        try:
            return client.analyze_files(rows, types)
        except NotImplementedError:
            raise
        except Exception:
            if not left:
                raise
            time.sleep(pause)
    raise AssertionError


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def answers(rows: DataFrame, client, types: list[str] | None = None, batch: int = 8, retries: int = 2, pause: float = 0.2) -> DataFrame:
    """batch, path, what, text, error: a row for each key of each answer, which is a path of the batch, or else what was asked about.

    A batch whose client fails gives a row for each of its files, with the fault and no text.
    The client is sent to the tasks, one of which asks for one batch after another; it is
    asked once for each batch, and again only where a task is lost, as the answers are written.
    """
    wanted = list(types or TYPES)
    numbered = rows.withColumn("__batch", F.floor((F.row_number().over(W.orderBy("rel_path")) - 1) / batch).cast("int"))  # in one task: a caller asks for `most` rows
    dealt = numbered.repartitionByRange("__batch").sortWithinPartitions("__batch", "rel_path")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for number, files in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["__batch"]):
            sent = [{k: v for k, v in r.items() if k != "__batch"} for r in files]
            here = {r["rel_path"] for r in sent}
            try:
                said = _asked(client, sent, wanted, retries, pause) or {}
                out += [{"batch": number, "path": k if k in here else None, "what": None if k in here else str(k), "text": _text(v), "error": None} for k, v in said.items()]
            except Exception as e:
                out += [{"batch": number, "path": p, "what": None, "text": None, "error": f"{type(e).__name__}: {e}"} for p in sorted(here)]
        kind = pa.schema([("batch", pa.int32()), *((c, pa.string()) for c in ("path", "what", "text", "error"))])
        yield pa.RecordBatch.from_pylist(out, kind)

    return cut(dealt.mapInArrow(ask, ANSWER))


def of_project(said: DataFrame) -> DataFrame:
    """what, text: what batches answered on the project as a whole, in their order; faults of batches as `error`."""
    every = said.filter("what is not null").select("what", "batch", "text").unionByName(said.filter("error is not null").select(F.lit("error").alias("what"), "batch", F.col("error").alias("text")).distinct())
    return every.groupBy("what").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "text"))), lambda x: x["text"]), "\n").alias("text"))


def while_tagged(sc, tag: str | None, work: Callable[[], DataFrame]) -> DataFrame:
    """Runs work with its jobs tagged, so that another thread can cancel them."""
    if tag is None:
        return work()
    sc.addJobTag(tag)
    try:
        return work()
    finally:
        sc.removeJobTag(tag)
