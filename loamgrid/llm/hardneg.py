"""Hard negatives: for anchors and their nearest rows of the same label, the nearest rows of other labels.

Vectors are quantised to integers, and all scores are exact integer inner products. Anchors and rows
are packed into blocks, and each block of anchors meets each block of rows in one group of bounded
size: a tile. A tile's scores are one matrix product, made by Strassen's recursion on int64 with zero
padding (``strassen``); additions and products are those of the integers modulo 2 ** 64, in which the
recursion is exact, and the results are far smaller. Two passes follow each other. The first keeps for
each anchor a heap of its best rows of its own label, the second for each anchor and positive a heap
of the best rows of other labels whose score lies in the positive's window. A heap holds k rows at most
and is the best k of what its tiles hold, so heaps of parts merge into the heap of the whole: in Spark,
by a window whose ranks are cut before and after its shuffle. Nothing else leaves a tile.

Defined results: a row without vec_id, label or vector, or with a null or non-finite component, takes
no part; of rows that share a vec_id the one with the smallest label, then the smallest vector, takes
part; a shorter vector counts as padded with zeros, so an empty one scores zero with all; ties go by
vec_id; an anchor without positives or a positive without negatives gives no row; an empty table gives
no rows; extra columns are ignored. Scores are 64-bit integers: vectors so large that a hundredfold score
might not fit raise, as an overflow does elsewhere in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch

LEAF = 32  # rows, columns or depth of a tile that is multiplied as it is


@dataclass(frozen=True)
class MiningParams:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    #: A negative's score in hundredths of its positive's: from, to.
    low: int = 80
    high: int = 100
    anchors_per_tile: int = 256
    rows_per_tile: int = 16384
    tiles: int = 64  # wanted at least, so that small tables are dealt out too


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64: seven products of halves where the three sizes exceed ``leaf``, odd sizes padded with zeros."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``a`` with all rows of ``b``, tile by tile of about equal sides."""
    side = max(2 * LEAF, len(a), 256)
    out = np.empty((len(a), len(b)), np.int64)
    for at in range(0, len(b), side):
        out[:, at : at + side] = strassen(a, np.ascontiguousarray(b[at : at + side].T))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def matrix(vectors: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Quantised vectors; shorter ones end in zeros."""
    v = vectors.combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    flat = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("a component does not fit 64 bits")
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), size.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat.astype(np.int64)
    return out


def _sides(t: pa.Table, u: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = matrix(t.column("vector"), scale), matrix(u.column("vector"), scale)
    largest = np.abs(a).max(initial=0).astype(float) * np.abs(b).astype(float).sum(1).max(initial=0)
    if 100 * largest >= 2.0**62:
        raise OverflowError("a score may not fit 64 bits")
    wide = max(a.shape[1], b.shape[1], 1)
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


_HEAP = "anchor_id bigint, positive_id bigint, positive_score bigint"
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _positives(p: MiningParams):
    """The heaps of own-label rows of a tile; rows and anchors of one label at a time."""

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        a, b = _sides(t, u, p.scale)
        mine, ids, own, labels = _column(t, "id"), _column(u, "id"), _column(t, "label"), _column(u, "label")
        out = []
        for label in np.intersect1d(own, labels):
            i, j = np.flatnonzero(own == label), np.flatnonzero(labels == label)
            scores = product(a[i], b[j])
            for x, row in zip(i, scores):
                other = np.flatnonzero(ids[j] != mine[x])
                top = other[best(row[other], ids[j[other]], p.positives)]
                out.append((np.full(len(top), mine[x]), ids[j[top]], row[top]))
        return _table(out, _HEAP)

    return run


def _negatives(p: MiningParams):
    """The window heaps of other-label rows of a tile, for each anchor and positive."""

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        a, b = _sides(t, u, p.scale)
        mine, ids, own, labels = _column(t, "id"), _column(u, "id"), _column(t, "label"), _column(u, "label")
        heaps, out = t.column("positives").to_pylist(), []
        scores = product(a, b)
        for x, heap in enumerate(heaps):
            points = np.array([q["positive_score"] for q in heap], np.int64)
            row = 100 * scores[x]
            near = np.flatnonzero((labels != own[x]) & (row >= p.low * points.min()) & (row <= p.high * points.max()))
            near = near[np.lexsort((ids[near], -row[near]))]
            s = scores[x, near]
            for q, point in zip(heap, points.tolist()):
                # The rows are in order, so a window is a run of them.
                first = np.searchsorted(-100 * s, -p.high * point, side="left")
                top = slice(first, first + p.negatives)
                fits = np.flatnonzero(100 * s[top] >= p.low * point) + first
                out.append((np.full(len(fits), mine[x]), np.full(len(fits), q["positive_id"]), np.full(len(fits), point), ids[near[fits]], s[fits]))
        return _table(out, _FOUND)

    return run


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    names = [x.split()[0] for x in ddl.split(", ")]
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0)] * len(names)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _ready(rows: DataFrame) -> DataFrame:
    """One row (id, label, vector) for each vec_id that takes part."""
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("vector"))
    whole = whole.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd))
    return whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")


class Tiles:
    """Blocks of rows, each met by every block of anchors."""

    def __init__(self, rows: DataFrame, p: MiningParams):
        self.p, self.n = p, rows.count()
        self.columns = max(1, min(-(-self.n // p.rows_per_tile) if self.n > p.tiles * p.rows_per_tile else p.tiles, self.n))
        self.rows = rows.withColumn("column", F.pmod(F.xxhash64("id"), F.lit(self.columns)))

    def meet(self, anchors: DataFrame, count: int, tile, schema: str) -> DataFrame:
        """``tile`` on each block of anchors with each block of rows; both sides go to as many blocks as their numbers ask for."""
        lines = max(1, -(-count // self.p.anchors_per_tile))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = anchors.withColumn("line", F.pmod(F.xxhash64("id", F.lit("line")), F.lit(lines))).withColumn("column", every(self.columns))
        right = self.rows.withColumn("line", every(lines))
        left = left.select([F.col(c).alias(c) for c in left.columns])  # both sides come from one table
        return left.groupBy("line", "column").cogroup(right.groupBy("line", "column")).applyInArrow(_if_both(tile, schema), schema)


def _if_both(tile, ddl: str):
    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        return tile(t, u) if t.num_rows and u.num_rows else _table([], ddl)

    return run


def heaps(found: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """Heaps of parts merged: the k best rows for each key, with their rank from 1."""
    by = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, p: MiningParams = MiningParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for ``rows(vec_id, embedding, label)``; ``is_anchor`` is on ``id``."""
    s = Scratch(rows.sparkSession, "hardneg")
    ready = s.keep(_ready(rows), "vectors")
    tiles, anchors = Tiles(ready, p), ready.filter(is_anchor)
    count = anchors.count()
    first = heaps(tiles.meet(anchors, count, _positives(p), _HEAP), ["anchor_id"], "positive_score", "positive_id", p.positives)
    lists = s.keep(first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    second = tiles.meet(anchors.join(lists, "id"), count, _negatives(p), _FOUND)
    out = heaps(second, ["anchor_id", "positive_id"], "negative_score", "negative_id", p.negatives)
    return s.finish(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE = {
    "op12_strassen_hard_negatives": """
WITH r AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, r.id AS b, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS s FROM r a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p, ps, b, s, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS k FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 5"""
}
