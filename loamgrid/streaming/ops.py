"""Streaming forms (T1-T9): file streams in, keyed state or event-time windows, tables out."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators.answers import QUOTES_LINE, SENTINEL
from loamgrid.operators.documents import chunk_documents
from loamgrid.plans.session import Scratch
from loamgrid.sources.sinks import ReplacedTable

HOLD_BACK = 24
_QUOTES = re.compile(QUOTES_LINE)


def stream_table(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    return source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if one else source.parquet(path)


def run_to_table(stream: DataFrame, s: Scratch, mode: str = "append", write: Callable | None = None) -> DataFrame:
    """Runs a stream over what is there now into a table, restartable from its checkpoint."""
    at, mark = s.path("stream"), s.path("marks")
    if write is None:
        # Each batch has a folder of its own, so that a batch that is run again replaces itself.
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/batch={0 if mode == 'complete' else n}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.schema(stream.schema).parquet(at).select(stream.columns)


def incremental_ingest(docs: DataFrame, s: Scratch) -> DataFrame:
    """Chunks of arriving documents; a document that arrives again replaces its chunks.

    Each batch chunks what has come and replaces those documents in the table (of rows that repeat an id
    within a batch one counts). A batch that runs again after a failure writes the same again.
    """
    table, mark = ReplacedTable(s.spark, s.path("chunks"), "doc_id"), s.path("marks")

    def write(batch: DataFrame, n: int) -> None:
        one = batch.select("doc_id", "text").dropDuplicates(["doc_id"])
        table.replace(n, one.select("doc_id"), chunk_documents(one))

    docs.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return table.read()


class DeltaAssembly:
    """T2 of one query: what may be shown so far of an answer that arrives in pieces, wherever they are cut.

    It begins in phase ``head``, while the text may still turn out to be the sentinel. Then shown text runs
    behind by as much as the line that begins the quotes may take (``text`` where what is held begins a
    line, ``mid`` where it goes on with one). Such a line counts once its end is there; from it on all
    goes to ``section`` and nothing is shown.
    """

    def __init__(self, phase: str = "head", held: str = "", section: str = ""):
        self.phase, self.held, self.section = phase, held, section

    @property
    def refused(self) -> bool:
        return self.phase == "refused"

    def feed(self, text: str, last: bool) -> str:
        if self.phase == "quotes":
            self.section += text
        if self.phase in ("quotes", "refused"):
            return ""
        self.held += text
        if self.phase == "head":
            begin = self.held.lstrip()
            if begin.startswith(SENTINEL):
                self.phase, self.held = "refused", ""
                return ""
            if SENTINEL.startswith(begin) and not last:
                return ""
            self.phase = "text"
        before = "x" if self.phase == "mid" else ""
        line = _QUOTES.search(before + self.held)
        start, end = (x - len(before) for x in line.span()) if line else (len(self.held), len(self.held))
        if line and (last or end < len(self.held)):
            out, self.section = self.held[:start].rstrip(), self.held[end:]
            self.phase, self.held = "quotes", ""
            return out
        n = len(self.held) if last else max(0, min(start, len(self.held) - HOLD_BACK))
        out, self.held = self.held[:n], self.held[n:]
        if out:
            self.phase = "text" if out.endswith("\n") else "mid"
        return out


def bucket_step(tokens: float, at: float, now: float, per_minute: float) -> tuple[float, float, bool, int]:
    """(tokens, time, admitted, seconds to wait) of one request."""
    tokens = min(per_minute, tokens + max(0.0, now - at) * per_minute / 60)
    if tokens >= 1:
        return tokens - 1, now, True, 0
    return tokens, now, False, int(-(-(1 - tokens) * 60 // per_minute))


def token_bucket_batch(requests: DataFrame, per_minute: float) -> DataFrame:
    """T3 over a table; equal to the stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, at, rows = per_minute, 0.0, []
        for x in pdf.sort_values(["at", "id"]).itertuples():
            tokens, at, ok, wait = bucket_step(tokens, at, x.at, per_minute)
            rows.append((x.id, ok, wait))
        return pd.DataFrame(rows, columns=["id", "admitted", "retry_after"])

    return requests.groupBy("key").applyInPandas(run, "id long, admitted boolean, retry_after long")


def first_requests(requests: DataFrame, within: str = "24 hours") -> DataFrame:
    """The first request of each key within a day, in a stream."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def running_usage(log: DataFrame) -> DataFrame:
    """Queries and tokens of each UTC day, kept up to date."""
    return log.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum("value"), 3).alias("value")).select(F.to_date("w.start").alias("day"), "queries", "value")


def windowed_usage(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """T9 in append mode: a day is given out once, when the watermark has passed it."""
    return running_usage(log.withWatermark("ts", late))


def attempt_limit(log: DataFrame, seconds: int = 900, limit: int = 1) -> DataFrame:
    """Attempts of each user and fixed window, blocked above a limit."""
    return log.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("attempts")).select("user_id", F.floor(F.unix_timestamp("w.start") / seconds).cast("long").alias("period"), "attempts", (F.col("attempts") > limit).alias("blocked"))
