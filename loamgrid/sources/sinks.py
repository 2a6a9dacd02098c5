"""Sinks. A table whose rows are replaced key by key, and exports of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamgrid.plans.session import Scratch, delete_path


class ReplacedTable:
    """Rows of keys that arrive in numbered versions; of each key only its latest version is read.

    A version is two folders, the keys it replaces and their new rows, so a key whose new rows are none
    is replaced as well. A version that is written again overwrites itself; nothing older is rewritten.
    Keys are written last: until then readers see what was before.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root, key

    def replace(self, version: int, keys: DataFrame, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/version={version}")
        keys.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.root}/keys/version={version}")

    def read(self) -> DataFrame:
        latest = self.spark.read.parquet(f"{self.root}/keys").groupBy(self.key).agg(F.max("version").alias("version"))
        return self.spark.read.parquet(f"{self.root}/rows").join(latest, [self.key, "version"]).drop("version")


def export_csv(wide: DataFrame, path: str) -> None:
    """A wide table as CSV parts with a header each; arrays as their items joined by "; ", values quoted where needed."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<") else F.col(c) for c, t in wide.dtypes]
    wide.select(*flat).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def export_json(wide: DataFrame, path: str) -> None:
    """A row per line, fields without a value included."""
    wide.write.option("ignoreNullFields", False).mode("overwrite").json(path)


class BucketedTable:
    """Rows of keys in a table of buckets, a folder each: replacing keys rewrites the buckets that hold them and no other.

    Readers see plain Parquet and prune buckets by ``bucket``. What is replaced is written elsewhere
    first, then put in place by a dynamic partition overwrite, so a run that fails between can simply
    be run again: it takes the keys out once more and gives the same rows. One writer at a time.
    """

    def __init__(self, s: Scratch, root: str, key: str, buckets: int = 64, schema: StructType | None = None):
        self.s, self.root, self.key, self.buckets, self.schema = s, root, key, buckets, schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> None:
        """Begins the table anew."""
        rows = rows.withColumn("bucket", self._bucket())
        self.schema = rows.schema
        self._put(rows, "static")

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.root)

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """``rows`` take the place of all rows of ``keys``; a key without new rows goes."""
        gone = self.s.keep(keys.select(self.key).distinct().withColumn("bucket", self._bucket()), "keys")
        touched = [x.bucket for x in gone.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not touched:
            return
        rest = self.read(touched).join(gone.select(self.key), self.key, "left_anti")
        new = rows.join(gone.select(self.key), self.key, "left_semi").withColumn("bucket", self._bucket())
        after = self.s.keep(rest.unionByName(new), "replaced")
        self._put(after, "dynamic")
        left = {x.bucket for x in after.select("bucket").distinct().collect()}
        for b in set(touched) - left:  # nothing is left of it, so nothing overwrote it
            delete_path(self.s.spark, f"{self.root}/bucket={b}")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        reader = self.s.spark.read if self.schema is None else self.s.spark.read.schema(self.schema)
        out = reader.parquet(self.root)
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))


def append_log(rows: DataFrame, path: str, day: str = "created_at") -> None:
    """A log is appended to by UTC day, so that a question about days reads these days only."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def markdown_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, the lines of a small table of metrics as a Markdown table in the order of its columns; null is empty."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    lines = F.sort_array(F.collect_list(F.struct(*columns, line.alias("line"))))
    return rows.groupBy().agg(F.concat_ws("\n", F.lit(head), F.transform(lines, lambda x: x["line"])).alias("report"))
