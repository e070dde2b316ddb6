"""Operator 2: token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so they are kept
as a log of committed deltas, one per batch of changes. A change is an insert
(+n), a delete (-n) or a revision (-old, +new). A batch is summed with map-side
combination, written to a folder of its own, and counts once Spark's committer
has left its marker there. A batch whose id is committed is not applied again; if
it comes with other sums than before, that is an error. A write that broke off
has no marker, and the next attempt replaces it.

A fold sums the batches so far into one small table, with their ids and a mark of
what each had, and takes their folders away, so that neither totals nor commits
read more than the last fold and the batches since. Of one id, one writer at a
time is expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import file_system, new_path, take, word_count, written

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
IDS = "batch string, n long, mark decimal(38,0)"
FOLDS = "folds"
#: Hadoop's setting that leaves a marker in a folder whose write is whole.
MARKS = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
CHANGE = ("op", *KEYS, "n_tokens", "old_tokenizer", "old_tokens")


class BatchConflict(ValueError):
    pass


class NoMarker(RuntimeError):
    pass


class TokenRollup:
    """A rollup below a path of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, place: str) -> bool:
        fs, at = file_system(self.spark, f"{self.path}/{place}")
        return fs.exists(at)

    def _names(self, place: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{place}".rstrip("/"))
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, place: str, schema: str = DELTA) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{place}")

    def _fold(self) -> int:
        """The number of the last fold that is complete; -1 if there is none."""
        return max((int(n) for n in self._names(FOLDS) if n.isdigit() and self._exists(f"{FOLDS}/{n}/ids/_SUCCESS")), default=-1)

    def _folded(self, batches: list[str]) -> dict:
        """The marks of those of the batches that the last fold has."""
        n = self._fold()
        if n < 0 or not batches:
            return {}
        return {r.batch: (r.n, r.mark) for r in self._read(f"{FOLDS}/{n}/ids", IDS).filter(F.col("batch").isin(batches)).collect()}

    @staticmethod
    def _mark(delta: DataFrame) -> tuple:
        return tuple(delta.agg(F.count("*"), F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in delta.columns]).cast("decimal(38,0)"))).first())

    @staticmethod
    def delta(changes: DataFrame) -> DataFrame:
        """changes: op (insert, delete or revise), the KEYS, n_tokens, and for revisions the tokenizer and tokens before.

        Null keys are a group of their own; null counts are zero; other ops are an error.
        """
        rows = take(changes, *CHANGE)
        new = F.struct("tokenizer", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        gone = F.struct("tokenizer", F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))
        old = F.struct(F.col("old_tokenizer").alias("tokenizer"), F.lit(-1).alias("docs"), (-F.col("old_tokens")).alias("tokens"))
        wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))
        signed = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new)).otherwise(wrong)
        parts = rows.select("source", "lang", F.explode(signed).alias("s"))
        summed = parts.groupBy("source", "lang", F.col("s.tokenizer").alias("tokenizer")).agg(F.sum("s.docs").cast("long").alias("docs"), F.coalesce(F.sum("s.tokens"), F.lit(0)).cast("long").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch; False if it was applied before. Batch ids are letters, digits, - and _.

        A session that has turned the committer's marker off is refused before anything is
        written, and a committer that has left none after: its batches would never count.
        """
        if not self.spark._jsparkSession.sessionState().newHadoopConf().getBoolean(MARKS, True):
            raise NoMarker(f"{MARKS} is off: no batch would count")
        if not batch.replace("-", "").replace("_", "").isalnum() or batch == FOLDS:
            raise ValueError(f"batch id {batch!r}")
        delta = self.delta(changes)
        before = self._folded([batch]).get(batch)
        if not before and self._exists(f"{batch}/_SUCCESS"):
            before = self._mark(self._read(batch))
        if before:
            if self._mark(delta) != before:
                raise BatchConflict(f"batch {batch} was committed with other sums")
            return False
        delta.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        if not self._exists(f"{batch}/_SUCCESS"):
            raise NoMarker(f"no marker was left in {self.path}/{batch}: the batch does not count")
        return True

    def batches(self) -> list[str]:
        """The committed batches that no fold has."""
        there = [b for b in self._names("") if b != FOLDS and self._exists(f"{b}/_SUCCESS")]
        gone = self._folded(there)
        return [b for b in there if b not in gone]

    def totals(self) -> DataFrame:
        """docs and tokens by source, language and tokenizer version, over all committed batches; groups that came to nothing are left out."""
        n, done = self._fold(), self.batches()
        parts = [f"{FOLDS}/{n}/totals"] * (n >= 0) + done
        log = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{b}" for b in parts]) if parts else self.spark.createDataFrame([], DELTA)
        return log.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def fold(self) -> int:
        """Folds the batches since the last fold; how many. Each step can be done again: the new fold counts once its ids are written."""
        n, done = self._fold(), self.batches()
        if done:
            marks = self.spark.createDataFrame([(b, *self._mark(self._read(b))) for b in done], IDS)
            ids = marks if n < 0 else marks.union(self._read(f"{FOLDS}/{n}/ids", IDS))
            self.totals().write.mode("overwrite").parquet(f"{self.path}/{FOLDS}/{n + 1}/totals")
            ids.write.mode("overwrite").parquet(f"{self.path}/{FOLDS}/{n + 1}/ids")
        kept = f"{FOLDS}/{self._fold()}"
        for old in [b for b in self._names("") if b in self._folded([b])] + [f"{FOLDS}/{x}" for x in self._names(FOLDS) if f"{FOLDS}/{x}" != kept and int(x) <= n]:
            fs, at = file_system(self.spark, f"{self.path}/{old}")
            fs.delete(at, True)
        return len(done)


def history(docs: DataFrame, labels: DataFrame) -> list[tuple[str, DataFrame]]:
    """A history of documents in three batches of changes, from one scan of the texts.

    All are inserted with their words counted (words-1); those that are labelled
    toxic are deleted; the others are counted anew as runs of letters, runs of
    digits, and other signs (marks-2). Null and empty texts count no tokens; null
    sources and languages are groups of their own; a null id has no label; repeated
    documents count each, repeated labels once; empty tables give batches of nothing.
    """
    own = take(docs, "doc_id", "source", "lang", "text")
    text = F.coalesce("text", F.lit(""))
    rows = written(own.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long").alias("marks")), "rollup-counts")
    toxic = take(labels, "doc_id", "toxic").filter("toxic = 1").select("doc_id").distinct()
    none = F.lit(None).cast("string").alias("old_tokenizer"), F.lit(None).cast("long").alias("old_tokens")
    insert = rows.select(F.lit("insert").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens"), *none)
    delete = rows.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens"), *none)
    revise = rows.join(toxic, "doc_id", "left_anti").select(F.lit("revise").alias("op"), "source", "lang", F.lit("marks-2").alias("tokenizer"), F.col("marks").alias("n_tokens"), F.lit("words-1").alias("old_tokenizer"), F.col("words").alias("old_tokens"))
    return [("insert-all", insert), ("take-down", delete), ("recount", revise)]


def totals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The totals of history(): the batches are committed, the first two folded, and the first one is sent again, which changes nothing.

    Nulls, repeats and empty tables are as in history(); groups that came to nothing are left out.
    """
    rollup = TokenRollup(docs.sparkSession, new_path(docs.sparkSession, "rollup"))
    batches = history(docs, labels)
    for name, changes in batches[:2]:
        rollup.commit(name, changes)
    rollup.fold()
    for name, changes in [*batches[2:], batches[0]]:
        rollup.commit(name, changes)
    return rollup.totals()
