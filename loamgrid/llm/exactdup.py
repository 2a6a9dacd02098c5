"""Exact duplicates by a tree of merged digest runs, with DataFrame operations only.

Each document becomes a digest row (SHA-256 of the normalised text, with its byte length and an
independent 64-bit hash as verification). Rows are dealt to ``fan_in ** levels`` leaf runs, and equal
digests of one run become one row before any shuffle of rows, so a text that a third of all rows
share shrinks to one row a run. Then ``levels`` rounds follow. In each, ``fan_in`` neighbouring runs
exchange their rows by digest range, every range is sorted by digest, neighbours are compared (digest,
length and second hash), and of equal ones the first stays with the winning identifier and the sum
of the counts. A run holds a digest once, so equal neighbours are ``fan_in`` at most and each round
is one sorted pass that looks ``fan_in - 1`` rows ahead. Ranges are those of the first two bytes of
the digest: no task holds a whole run, and the last round is spread as the first.

Defined results: null text counts as empty; repeated rows count as often as they occur; among rows
with one id the digest decides; null ids are kept rows that no group counts as its winner unless all
of its ids are null; an empty table gives an empty result; extra columns are ignored, and passed
through by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check")
    )


def merge_runs(rows: DataFrame, s: Scratch, fan_in: int = 4, levels: int = 3, keep: str = "smallest") -> DataFrame:
    """(digest, n_bytes, check, keep_id, group_size) by ``levels`` rounds of ``fan_in``-way merging of sorted runs."""
    best = F.min if keep == "smallest" else F.max
    run = F.pmod(F.xxhash64("doc_id"), F.lit(fan_in**levels)).cast("int")
    runs = rows.groupBy(run.alias("run"), *_KEY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    for level in range(levels):
        runs = _merged(runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), fan_in, keep)
        if level + 1 < levels:
            runs = s.keep(runs, f"runs-{level}")
    return runs.drop("run")


def _merged(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """One row of each digest and run, of ``fan_in`` rows at most that have both."""
    first = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    by = Window.partitionBy("run", F.substring("digest", 1, 2)).orderBy(*_KEY, first)

    def same(shift) -> Column:
        out = shift("digest") == F.col("digest")
        for k in _KEY[1:]:
            out = out & (shift(k) == F.col(k))
        return F.coalesce(out, F.lit(False))

    size = F.col("group_size")
    for i in range(1, fan_in):
        ahead = lambda c, i=i: F.lead(c, i).over(by)
        size = size + F.when(same(ahead), ahead("group_size")).otherwise(F.lit(0))
    follows = same(lambda c: F.lag(c, 1).over(by))
    out = runs.select("run", *_KEY, "keep_id", size.alias("group_size"), follows.alias("follows"))
    return out.filter("not follows").drop("follows")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", fan_in: int = 4, levels: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    s = Scratch(docs.sparkSession, "exactdup")
    rows = s.keep(digest_rows(docs), "digests")
    groups = s.keep(merge_runs(rows, s, fan_in, levels, keep), "groups")
    out = rows.join(groups, _KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return s.finish(out)


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of each text: of the winning id, and of its repeated rows the one with the smallest hash of the row.

    A row without an id stays only where no row of its text has one.
    """
    s = Scratch(docs.sparkSession, "exactdup")
    groups = s.finish(merge_runs(s.keep(digest_rows(docs), "digests"), s, keep=keep), "groups")
    # An id and whether there is one, both never null: the join and the ranking after it then share one shuffle of the rows.
    ids = lambda c: (F.coalesce(c, F.lit(0)).alias("doc_id"), c.isNull().alias("no_id"))
    groups = groups.select(*ids(F.col("keep_id")), *_KEY).hint("merge")
    # The whole row travels as one column, so no name of the caller's can clash.
    rows = docs.select(F.struct("*").alias("row"))
    t = normalised(F.col("row")["text"])
    rows = rows.select("row", *ids(F.col("row")["doc_id"].cast("long")), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("check"))
    # Only rows with one id and one text are left to choose from.
    own = ["doc_id", "no_id", *_KEY]
    first = Window.partitionBy(*own).orderBy(F.xxhash64("row"))
    return rows.join(groups, own, "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")


def op7_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE = {
    "op7_tree_merge_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
}
