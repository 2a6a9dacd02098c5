"""Evaluation of retrieval, gates and answers (E1-E14, R18) over golden and judged tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_hit(expected: Column, found: Column) -> Column:
    """All expected documents are found; null where none is expected."""
    return F.when(F.size(expected) == 0, F.lit(None).cast("boolean")).otherwise(F.size(F.array_except(expected, found)) == 0)


def recall_by_category(judged: DataFrame) -> DataFrame:
    """Recall and mean gate score by category, and overall (category null)."""
    return judged.rollup("category").agg(F.round(F.avg("quality"), 9).alias("recall"), F.round(F.avg("gate"), 9).alias("mean_gate"), F.count(F.lit(1)).alias("n"))


def threshold_sweep(judged: DataFrame, positive: Column, gate: Column, lo: int = 10, hi: int = 70, step: int = 2) -> DataFrame:
    """Refusal of what has no answer and pass of what has one, for each threshold (31 of them)."""
    grid = judged.sparkSession.range(lo, hi + 1, step).select((F.col("id") / 100).alias("threshold"))
    x = judged.select(positive.alias("p"), gate.alias("g")).groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"))
    at = x.crossJoin(F.broadcast(grid))
    share = lambda cond, of: F.sum(F.when(cond & of, F.col("n")).otherwise(0)) / F.sum(F.when(of, F.col("n")).otherwise(0))
    out = at.groupBy("threshold").agg(share(F.col("g") < F.col("threshold"), ~F.col("p")).alias("a"), share(F.col("g") >= F.col("threshold"), F.col("p")).alias("b"))
    return out.select("threshold", F.round("a", 9).alias("refusal_rate"), F.round("b", 9).alias("pass_rate"), F.round((F.col("a") + F.col("b")) / 2, 9).alias("balanced"))


def recommend_threshold(sweep: DataFrame, floor: float = 0.95) -> DataFrame:
    """The highest threshold that passes ``floor``, else the best balanced one."""
    ok = F.max(F.when(F.col("pass_rate") >= floor, F.col("threshold")))
    return sweep.agg(F.coalesce(ok, F.max_by("threshold", F.struct("balanced", "threshold"))).alias("threshold"))


def answer_metrics(judged: DataFrame) -> DataFrame:
    """E5: refusals, false refusals and precision of shown sources by category."""
    return judged.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused"), F.count_if(F.col("refused") & (F.col("quality") == 1)).alias("false_refusals"), F.count_if(~F.col("refused") & (F.col("quality") == 1)).alias("right_sources")
    )


def verdict(raw: Column) -> Column:
    """Pass or fail from a judge's text; a missing verdict is a fail."""
    return F.coalesce(F.lower(F.regexp_extract(raw, r"(?i)verdict\s*[:=]\s*(pass|fail)", 1)) == "pass", F.lit(False))


def leak_test(hits: DataFrame, role_labels: DataFrame) -> DataFrame:
    """Shown chunks whose label the role lacks, by role; none is the aim."""
    may = role_labels.select("role", F.col("label").alias("access_label"), F.lit(1).alias("ok"))
    return hits.join(F.broadcast(may), ["role", "access_label"], "left").groupBy("role").agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("ok").isNull()).alias("leaks"))


def miss_list(judged: DataFrame, most: int = 5) -> DataFrame:
    """The first misses of each category."""
    n = F.row_number().over(Window.partitionBy("category").orderBy("doc_id"))
    return judged.filter("quality = 0").withColumn("n", n).filter(F.col("n") <= most).select("category", "doc_id", "n")


def route_collection(expected: Column) -> Column:
    """The German collection if an expected document ends in -DE."""
    return F.when(F.exists(expected, lambda x: x.endswith("-DE")), F.lit("de")).otherwise(F.lit("default"))


def edit_distance(a: list, b: list) -> int:
    """Edit distance by columns of bits (Myers, Hyyrö): one step for each of ``b``, over all of ``a`` at once. A null is equal to nothing."""
    if not len(a):
        return len(b)
    at: dict = {}
    for i, w in enumerate(a):
        if w is not None:
            at[w] = at.get(w, 0) | 1 << i
    mask, last, n = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for w in b:
        eq = at.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq
        more, less = down | (mask & ~(x | up)), up & x
        n += 1 if more & last else -1 if less & last else 0
        more, less = more << 1 | 1, less << 1
        x = eq | down
        up, down = (less | ~(x | more)) & mask, more & x & mask
    return n


def word_errors(truth: Column, read: Column) -> Column:
    """Word edit distance of two normalised word lists."""

    @F.pandas_udf("int")
    def distances(truth: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(truth, read)], dtype="Int32")

    return distances(truth, read)


def word_error_rate(truth: Column, read: Column) -> Column:
    """Errors over the length of the truth; 0 for two empty lists, 1 for an empty truth."""
    return F.when(F.size(truth) == 0, F.when(F.size(read) == 0, 0.0).otherwise(1.0)).otherwise(word_errors(truth, read) / F.size(truth))


def heading_recall(headings: Column, found: Column) -> Column:
    """Share of headings found after normalisation."""
    norm = lambda a: F.array_distinct(F.transform(a, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))))
    return F.size(F.array_intersect(norm(headings), norm(found))) / F.nullif(F.size(norm(headings)), F.lit(0))


def variant_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and exact median of a measure by variant."""
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))


def rank_bands(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of queries whose target ranks 1-20, later, or not at all."""
    best = targets.join(ranked, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    band = F.when(F.col("r") <= 20, "1-20").when(F.col("r") <= 150, "21-150").otherwise("absent")
    counts = best.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(best.agg(F.count(F.lit(1)).alias("t")))).select("band", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


def coverage_sweep(ranked: DataFrame, targets: DataFrame, caps: list[int]) -> DataFrame:
    """Queries whose target is within each cap."""
    best = targets.join(ranked, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return best.select("r", F.explode(F.array(*map(F.lit, caps))).alias("cap")).groupBy("cap").agg(F.count_if(F.col("r") <= F.col("cap")).alias("covered"), F.count(F.lit(1)).alias("queries"))
