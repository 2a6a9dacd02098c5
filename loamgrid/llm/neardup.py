"""Near-duplicate documents by SetSketch registers: band, estimate, verify, connect.

A document is the set of its distinct word shingles. Each set gets ``m`` registers
``K_i = floor(1 - log_b(min over shingles of an exponential value))``, cut off at 0 and ``q + 1``;
registers of two sets agree with about the probability of their Jaccard similarity, and the sketch
of a union is the larger register at each place. The exponential values of one shingle come from a
Poisson process whose points fall on registers at random, so that a shingle is followed only while
its points can still lower a register.

* Equal sets form one class first (one representative goes on), whatever their number. Sets are
  equal if the SHA-256 values of all their sorted shingles are.
* Classes that share a band of registers are candidates. Every class is first compared with the
  most central members of its band buckets, those whose buckets are largest together: of many
  edited copies of one text these are the copies with the fewest edits, so they reach what can be
  reached at all. What is thereby connected is one component. After that only pairs of *different*
  components are compared, and of these only those that share one of their rarest shingles and can
  still reach the threshold with what follows it (exact prefix and position bounds), so neither many
  copies nor many documents around one common passage cost a square.
* A candidate's similarity is estimated from the three counts of larger, smaller and equal
  registers by maximum likelihood; unlikely pairs go. The rest are confirmed on the full sets.

Defined results: null or blank text has the empty set and no links; every row is a document of its
own, also where an id repeats (with the same text or another), and the smallest id reachable from
any of its rows is the component; a null id is its own, unlinked, kept row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.llm.components import connected_components
from loamgrid.plans.session import Scratch

_U = np.uint64


@dataclass(frozen=True)
class SketchParams:
    """``bands`` bands of ``rows`` registers: at similarity 0.8 a pair shares none with 3e-6."""

    width: int = 4
    threshold: int = 80  # per cent of the union
    m: int = 256
    a: float = 20.0
    b: float = 1.001
    q: int = 65534
    rows: int = 6
    bands: int = 42
    slack: float = 0.15  # six standard errors of the estimate at 0.8


def registers(sets: list[np.ndarray], p: SketchParams) -> np.ndarray:
    """SetSketch registers, one row a set; all zero for an empty set."""
    n, m = len(sets), p.m
    low = np.full(n * m, np.inf)
    state = np.concatenate(sets) if n else np.zeros(0, _U)
    at = np.repeat(np.arange(n) * m, [len(s) for s in sets])
    x = np.zeros(len(state))
    turn, prune = 0, 1
    scale = 1.0 / (p.a * m)
    while len(state):
        turn += 1
        with np.errstate(over="ignore"):
            r = tokens.mix(state + _U(turn) * _U(0xD1B54A32D192ED03))
        x -= np.log(((r >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) * scale
        np.minimum.at(low, at + ((r & _U(0x7FF)) * _U(m) >> _U(11)).astype(np.int64), x)
        if turn >= prune:
            prune = turn + max(1, turn // 4)
            worst = low.reshape(n, m).max(axis=1)
            on = np.flatnonzero(x < worst[at // m])
            state, at, x = state[on], at[on], x[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low) / np.log(p.b))
    return np.clip(np.where(np.isinf(low), 0, k), 0, p.q + 1).astype(np.uint16).reshape(n, m)


def merge_registers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(x, y)


def band_keys(k: np.ndarray, p: SketchParams) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    v = k[:, : p.rows * p.bands].reshape(len(k), p.bands, p.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), v.shape[:2]).copy()
        for i in range(p.rows):
            out = tokens.mix(out * _U(0x100000001B3) + v[:, :, i])
    return out


def estimate_jaccard(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray, p: SketchParams) -> np.ndarray:
    """Maximum-likelihood similarity from joint register counts and the known set sizes."""
    more, less = (ku > kv).sum(1).astype(float), (ku < kv).sum(1).astype(float)
    same = p.m - more - less
    u, v = nu / (nu + nv), nv / (nu + nv)
    log_b, c = np.log(p.b), (p.b - 1.0) / p.b

    def loglik(j: np.ndarray) -> np.ndarray:
        pu = -np.log1p(-np.maximum(u - v * j, 0.0) * c) / log_b
        pv = -np.log1p(-np.maximum(v - u * j, 0.0) * c) / log_b
        eps = 1e-300
        return more * np.log(pu + eps) + less * np.log(pv + eps) + same * np.log(np.maximum(1 - pu - pv, eps))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5.0) - 1) / 2
    for _ in range(40):  # golden section: the likelihood is concave in the similarity
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        up = loglik(x) < loglik(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _sketches(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            sets = tokens.shingle_sets(texts, p.width)
            k = registers(sets, p)
            size, digest = [len(x) for x in sets], [hashlib.sha256(x.tobytes()).digest() for x in sets]
            cols = [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in k], pa.binary())]
            yield pa.record_batch([part.column(0), part.column(1), *cols], names=["doc_id", "text_key", "n_shingles", "digest", "sketch"])

    return run


def _bands(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                k = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, p.m)
                keys = band_keys(k, p)
                ids, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), p.bands) for c in (0, 1))
                yield pa.record_batch([tokens.signed(keys.ravel()), pa.array(ids), pa.array(n)], names=["bucket", "id", "n"])

    return run


def _likely(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ku, kv = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, p.m) for c in ("su", "sv"))
                nu, nv = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("nu", "nv"))
                banded = (ku == kv)[:, : p.rows * p.bands].reshape(-1, p.bands, p.rows).all(2).any(1)
                keep.append(banded & (estimate_jaccard(ku, kv, nu, nv, p) >= p.threshold / 100 - p.slack))
            if batch.num_rows:
                yield batch.select(["u", "v"]).filter(pa.array(np.concatenate(keep)))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            sets = tokens.shingle_sets(texts, width)
            yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
            size = [len(x) for x in sets]
            cols = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), size) for c in ("id", "component")]
            yield pa.record_batch([*map(pa.array, cols), pa.array(np.repeat(size, size)), tokens.signed(np.concatenate(sets))], names=["id", "component", "n", "shingle"])


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xu"), batch.column("xv")):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, params: SketchParams = SketchParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (which of the texts with this id), n_shingles, component_id, kept."""
    p, spark = params, docs.sparkSession
    s = Scratch(spark, "neardup")
    text = F.col(text_col).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    base = s.keep(source.mapInArrow(_sketches(p), "doc_id long, text_key long, n_shingles long, digest binary, sketch binary"), "sketches")

    # One class for each distinct set. Its vertex is its smallest id; where that id repeats with other sets, a hash.
    filled = base.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy("digest"))
    vertex = F.when(nth == 1, F.col("class_id")).otherwise(F.xxhash64("digest"))
    classes = s.keep(classes.withColumn("vertex", vertex), "classes")
    rows = filled.join(classes.drop("n_shingles"), "digest").filter("doc_id = class_id").dropDuplicates(["vertex"])
    reps = s.keep(rows.select(F.col("vertex").alias("id"), "doc_id", "text_key", F.col("n_shingles").alias("n"), "sketch"), "representatives")

    # Buckets that hold two classes or more, and the most central member of each.
    bands = s.keep(reps.select("id", "n", "sketch").mapInArrow(_bands(p), "bucket long, id long, n long"), "bands")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = s.keep(bands.join(sizes, "bucket"), "members")
    s.drop(bands)
    central = members.groupBy("id").agg(F.sum("c").alias("degree"))
    hubs = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id", "n")).alias("h")).select("bucket", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"))

    wanted = reps.join(members.select("id").distinct(), "id").select("id", "doc_id", "text_key").hint("merge")  # whatever its size, so that plans stay alike
    texts = source.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["id"])
    sets = s.keep(texts.select("id", "text").mapInArrow(_sets(p.width), "id long, shingles binary"), "sets", codec="none")

    first = _verified(s, _stars(members.join(hubs, "bucket"), p), reps, sets, p)
    label = connected_components(first, s)
    placed = members.join(label.withColumnRenamed("vertex", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    second = _verified(s, _across(s, placed, sets, p), reps, sets, p)
    label = connected_components(first.unionByName(second), s)

    ids = classes.join(label, "vertex").select("vertex", "component", "class_id")
    smallest = ids.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = s.keep(ids.join(smallest, "component").select("vertex", "component_id"), "components")
    named = classes.join(linked, "vertex", "left").select("digest", F.coalesce("component_id", "class_id").alias("component_id"))
    out = (
        base.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(named, "digest", "left")
        .select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    return s.finish(out)


def _stars(members: DataFrame, p: SketchParams) -> DataFrame:
    """Each class with the three hubs it shares most buckets with.

    These only connect what is easy to connect; what they leave apart is compared by ``_across``.
    """
    near = members.filter((F.col("id") != F.col("hub")) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * p.threshold))
    shared = near.groupBy("id", "hub").agg((-F.count(F.lit(1))).alias("c"))
    best = shared.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "hub"))), 1, 3).alias("b"))  # a list of `bands` at most
    return best.select(F.explode("b.hub").alias("u"), F.col("id").alias("v"))


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows belong to two components or more, with the one that has most of them."""
    each = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(key).agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(key, F.col("top.component").alias("main"))


def _across(s: Scratch, placed: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """Pairs of different components that can still be linked, of the buckets with several.

    A bucket may hold many documents that share a passage and no more; all its pairs would be a
    square. Two sets that reach the threshold share one of the (1 - t) n + 1 first elements of each
    in any fixed order. Rarest first, what many share comes last, and such pairs never meet; and at
    the first element they share, what is left of both bounds their intersection. Rows of the
    component that has most of an element are met by the others only, not by each other. The register
    band is asked for again when the pair is estimated.
    """
    pool = placed.join(_mixed(placed, "bucket").select("bucket"), "bucket").select("id", "component").distinct()
    rows = s.keep(sets.join(pool, "id").select("id", "component", "shingles").mapInArrow(_shingles, "id long, component long, n long, shingle long"), "shingles")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranked = rows.join(shared, "shingle").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("e"))
    # Elements that nobody shares come first and are left out of the list. Below this size no partner reaches the threshold.
    alone = F.col("n") - F.size("e")
    room = F.floor(F.col("n") * (100 - p.threshold) / 100) + 1 - alone
    lead = ranked.filter(room > 0).select("id", "component", "n", F.size("e").alias("m"), F.posexplode(F.slice("e", F.lit(1), room.cast("int"))).alias("at", "e"))
    lead = lead.select("id", "component", "n", (F.col("m") - F.col("at")).alias("m"), F.col("e.shingle").alias("shingle"))
    lead = s.keep(lead, "lead")
    s.drop(rows)
    mixed = s.keep(lead.join(_mixed(lead, "shingle"), "shingle"), "mixed")
    off = mixed.filter("component <> main").select("shingle", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"), F.col("component").alias("cx"))
    both = F.least("m", "mx")  # at their first common element: no more than what is left of either
    return (
        mixed.join(off, "shingle")
        .filter((F.col("component") != F.col("cx")) & (both * 100 >= (F.col("n") + F.col("nx") - both) * p.threshold))
        .select(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v"))
        .distinct()
    )


def _verified(s: Scratch, pairs: DataFrame, reps: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    u = reps.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = reps.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    sized = pairs.join(u, "u").join(v, "v").filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * p.threshold)
    likely = s.keep(sized.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(_likely(p), "u long, v long"), "likely")
    full = likely.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("xu")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("xv")), "v")
    return s.keep(full.mapInArrow(_confirm(p.threshold), "u long, v long"), "links")


def without_near_duplicates(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """The rows of ``docs``, with their columns, that are the smallest id of their group; rows without an id stay."""
    gone = near_duplicates(docs, params).filter("not kept").select("doc_id", "text_key").distinct().hint("merge")
    # The whole row travels as one column, so no name of the caller's can clash.
    rows = docs.select(F.struct("*").alias("row"))
    same = (F.col("row")["doc_id"].cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("row")["text"].cast("binary")) == F.col("text_key"))
    return rows.join(gone, same, "left_anti").select("row.*")


def op3_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
