"""Language identification by error-correcting output codes over hashed n-grams.

Every language gets a codeword; one linear classifier per bit is fitted on counts of hashed byte
n-grams (orders 1 to 4) of the whole text. A text's language is the one whose codeword loses least
against the classifiers' outputs, each bit weighted by how well it did in training; two codewords at
nearly the same loss mark the text as ambiguous.

The classifiers are fitted on a bounded sample: about ``sample`` labelled texts altogether, dealt
evenly to the languages by a hash of id and text. Both bounds follow from ``sample``: the
``sample // 4`` commonest languages are learned (so that each has four texts or more), and no more
than ``4 * sample + 1000`` rows of ``features * 2`` bytes reach the driver, a number that only rows
repeating one id and text could exceed. Only text and label take part. Defined results: null text and text
without a letter are ``und`` with score 0; a null label is not learned from; repeated rows and null
ids are predicted like others (a null id counts as the empty text in the fold); without any labelled
row every text is ``und``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.plans.session import Scratch


@dataclass(frozen=True)
class LangParams:
    features: int = 4096
    orders: int = 4
    sample: int = 3000  # texts for fitting, all languages together
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-4
    margin: float = 0.2  # of score between the two best: less is ambiguous
    seed: int = 7


def features(texts: list[bytes | None], p: LangParams) -> np.ndarray:
    """Square roots of hashed n-gram counts, each row of length one."""
    out = np.zeros((len(texts), p.features), np.float32)
    for i, t in enumerate(texts):
        x = np.frombuffer(b" " + b" ".join(tokens.words_of(t)) + b" ", np.uint8).astype(np.uint32)
        code = np.zeros(len(x), np.uint32)
        for k in range(min(p.orders, len(x))):
            code = code[: len(x) - k] * np.uint32(0x01000193) + x[k:] + np.uint32(1)
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[i] += np.bincount((h >> np.uint32(12)) % np.uint32(p.features), minlength=p.features)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(k: int, p: LangParams) -> np.ndarray:
    """One row of +1 / -1 a language: all splits for few languages, else a spread random code."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 2 ** (k - 1))]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(p.seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, bits))
        apart = ((code[:, None] != code[None]).sum(2) + bits * np.eye(k)).min()
        if apart > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, apart
    return best


@dataclass
class LangModel:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def fit(x: np.ndarray, langs: list[str], p: LangParams) -> LangModel:
    names = sorted(set(langs))
    code = codewords(len(names), p)
    y = code[[names.index(z) for z in langs]].astype(np.float32)
    share = np.array([1 / langs.count(z) for z in langs])
    share = (share / share.sum())[:, None].astype(np.float32)
    # One precision throughout, so that no step copies the features.
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, p.steps + 1):  # logistic loss, Adam
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w * 4 + b), -30, 30)))
        gw = 4 * (x.T @ g) + p.decay * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= p.rate * 10 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9) / 10
        b -= p.rate * g.sum(0)
    right = ((np.sign(x @ w * 4 + b) == y) * share).sum(0)
    err = np.clip(1 - right, 1e-3, 0.499)
    trust = np.log((1 - err) / err)
    return LangModel(names, code, w.astype(np.float32), b, trust / trust.mean())


def predict(x: np.ndarray, model: LangModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, margin) by loss-weighted decoding."""
    f = x @ model.weight * 4 + model.bias
    loss = np.stack([(np.logaddexp(0, -f * c) * model.trust).sum(1) for c in model.code], 1)
    e = np.exp(-(loss - loss.min(1, keepdims=True)))
    prob = e / e.sum(1, keepdims=True)
    top = np.sort(prob, axis=1)
    return prob.argmax(1), top[:, -1], top[:, -1] - (top[:, -2] if prob.shape[1] > 1 else 0)


def _sampled(p: LangParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            x = features(texts, p).astype(np.float16)
            yield pa.record_batch([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    return run


def train(docs: DataFrame, p: LangParams) -> LangModel | None:
    """A model from (text, lang) rows; None without any."""
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(p.sample // 4).collect()}
    if not counts:
        return None
    each = max(4, p.sample // len(counts))
    # A hash threshold per language: about `each` texts of it, wherever they lie.
    spark = docs.sparkSession
    limits = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, part double")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / float(1 << 24)
    taken = rows.join(F.broadcast(limits), "lang").filter(u <= F.col("part")).select("text", "lang")
    got = taken.mapInArrow(_sampled(p), "lang string, x binary").limit(4 * p.sample + 1000).toPandas()
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), -1).astype(np.float32)
    order = np.lexsort((got["x"].to_numpy(), got["lang"].to_numpy()))
    return fit(x[order], got["lang"].iloc[order].tolist(), p)


def _predicted(model: LangModel | None, p: LangParams):
    ddl = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            known = np.array(part.column("has_letter").to_pylist(), bool) & (model is not None)
            lang, score, margin = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            at = np.flatnonzero(known)
            for i in range(0, len(at), 1024):
                on = at[i : i + 1024]
                best, s, m = predict(features([texts[j] for j in on], p), model)
                lang[on], score[on], margin[on] = np.array(model.langs, object)[best], s, m
            yield pa.record_batch([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(known & (margin < p.margin))], schema=ddl)

    return run


def identify(docs: DataFrame, held_out: Column, p: LangParams = LangParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from rows that are not ``held_out``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out)
    model = train(rows.filter("not held_out"), p)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"), letter.alias("has_letter")).mapInArrow(
        _predicted(model, p), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def fold(mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % mod == rest


def op9_output_codes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "langid")
    return s.finish(identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(4, 2)))
