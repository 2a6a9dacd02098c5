"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

Output is factored: P(word | past) = P(class | state) * P(word | class, state). Classes of the most
frequent words are found by k-means on their neighbours in all training documents; every other word,
seen or not, belongs to a class by its form, so the classes cover all words. The ``classed`` most
frequent words have a softmax on the state within their class, and an input of their own. In a form
class the words, which no table of fixed size could hold, are weighted by their counts over all
training documents whatever the state, with one share kept for all words it has not seen together:
each unseen word gets this share, so the model is a full distribution over the words seen and one
unseen word.

A gated recurrent unit gives the state. All training documents are dealt to ``rounds``; in each, every
task runs truncated backpropagation over its documents of that round from the same weights, and the
weights come together as an average by tokens, added up by Spark in blocks. So each training token is
learned from once at every corpus size, and the driver holds tables of fixed size. While scoring, many
documents run side by side and the state of each is carried from window to window to its end, so its
whole length counts.

Texts are read twice: for counts, and for sequences of indices, from which the model then learns and scores.
Counts of the ``head`` most frequent words travel to the tasks (a table of fixed size); all other
words of a document meet their counts in a join.

Tokens: words after lower-casing A-Z, then one end. Defined results: null and empty texts are just
an end; repeated rows are scored alike; a null id falls in the fold of the empty text; without any
training document all counts are 0 and class probabilities even; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.llm.langid import fold
from loamgrid.plans.session import Scratch

FORMS = 8
END = np.uint64(0xE0D0_0000_0000_0001)


@dataclass(frozen=True)
class LmParams:
    head: int = 131_072  # words whose counts travel to the tasks
    classed: int = 1024  # words with a class of their own kind, 65,000 at most
    clusters: int = 32
    fill: float = 1.5  # most words of a class, as a multiple of the mean
    hidden: int = 20
    rounds: int = 4  # averages of the weights; each takes its share of the training documents
    lanes: int = 512
    window: int = 16  # steps of truncated backpropagation
    chunk: int = 1_000_000  # tokens a task holds while it learns
    rate: float = 0.004
    seed: int = 5

    @property
    def classes(self) -> int:
        return self.clusters + FORMS + 1  # the end is the last


def forms_of(words: pa.Array) -> np.ndarray:
    """What each word looks like, from 0 to 7: final punctuation, other alphabets, digits or signs."""
    w = words.cast(pa.string())
    core = pc.utf8_rtrim(w, ".,!?;:")
    marks = [pc.less(pc.binary_length(core), pc.binary_length(w)), pc.invert(pc.string_is_ascii(w)), pc.invert(pc.utf8_is_alpha(core))]
    return sum(m.to_numpy(zero_copy_only=False).astype(np.int64) << i for i, m in enumerate(marks))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, form, n) summed over much of a task before it is dealt out."""
    held: list[tuple] = []
    docs = size = 0

    def flush() -> pa.RecordBatch:
        h, f, n = (np.concatenate(x) for x in zip(*held))
        word, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return pa.record_batch([tokens.signed(word), pa.array(f[first]), pa.array(np.bincount(inverse, weights=n).astype(np.int64))], names=["word", "form", "n"])

    for part, _ in tokens.chunks(batches):
        words, seq, lens = tokens.indexed(part.column("text"))
        docs += len(lens)
        held.append((tokens.hashes(words.to_numpy(zero_copy_only=False)), forms_of(words).astype(np.int32), np.bincount(seq, minlength=len(words))))
        size += len(words)
        if size > 1_000_000:
            yield flush()
            held, size = [], 0
    if docs:
        held.append((np.array([END]), np.array([-1], np.int32), np.array([docs], np.int64)))
    if held:
        yield flush()


class Head:
    """Counts of the most frequent words, sorted by hash; their class index where they have one."""

    def __init__(self, word: np.ndarray, n: np.ndarray, classed: int):
        order = np.argsort(word)
        by_count = np.lexsort((word, -n))
        own = np.full(len(word), -1, np.int32)
        own[by_count[:classed]] = np.arange(min(classed, len(word)))
        self.word, self.n, self.own = word[order], n[order], own[order]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, own index or -1) of each word."""
        if not len(self.word) or not len(h):
            return np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int32)
        i = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        hit = self.word[i] == h
        return np.where(hit, self.n[i], -1), np.where(hit, self.own[i], -1).astype(np.int32)


SEQ = np.dtype("<u2")


_SEQUENCES = "row long, doc_id long, held_out boolean, turn int, n_tokens long, n_known long, logc double, part double, rare array<long>, times array<int>, seq binary"


def _sequences(head: Head, log_z: np.ndarray, p: LmParams):
    """Texts as indices: own ones first, then forms, then the end; those of training are dealt to the rounds, others have turn -1.

    With them what counts alone say of a text, so that no text is read again: ``logc`` for the base, ``part`` for the words
    within form classes, and the words whose counts are not here.
    """
    end_count = max(0, int(head.look(np.array([END]))[0][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = 0, TaskContext.get().partitionId() << 33
        for part, _ in tokens.chunks(batches):
            words, seq, lens = tokens.indexed(part.column("text"))
            h, form = tokens.hashes(words.to_numpy(zero_copy_only=False)), forms_of(words)
            n, own = head.look(h)
            index = np.where(own >= 0, own, p.classed + form).astype(SEQ)
            known = n >= 0
            logc = np.where(known, np.log10(np.where(known, n, 0) + (1.0)), 0.0)
            # Own words have their softmax; words of a form class weigh their count plus one.
            inner = np.where(own >= 0, 0.0, logc - log_z[form])
            docs, doc = len(lens), np.repeat(np.arange(len(lens)), lens)
            each = lambda x: np.bincount(doc, weights=x[seq], minlength=docs)  # noqa: E731, B023
            far, width = ~known[seq], len(words) + 1
            rare, times = np.unique(doc[far] * width + seq[far], return_counts=True)
            cut = pa.array(np.searchsorted(rare, np.arange(docs + 1) * width).astype(np.int32))
            learns = ~part.column("held_out").to_numpy(zero_copy_only=False)
            turn = np.where(learns, (at + np.cumsum(learns) - 1) % p.rounds, -1)
            sums = [lens + 1, lens - np.bincount(doc[far], minlength=docs) + (end_count > 0), each(logc) + np.log10(end_count + 1), each(inner)]
            lists = [pa.ListArray.from_arrays(cut, x) for x in (tokens.signed(h[rare % width]), pa.array(times.astype(np.int32)))]
            seqs = [np.append(x, SEQ.type(p.classed + FORMS)).tobytes() for x in np.split(index[seq], np.cumsum(lens)[:-1])]
            cols = [pa.array(np.arange(row, row + docs)), part.column("doc_id"), part.column("held_out"), pa.array(turn.astype(np.int32)), *map(pa.array, sums), *lists, pa.array(seqs, pa.binary())]
            yield pa.record_batch(cols, names=[c.split()[0] for c in _SEQUENCES.split(", ")])
            at, row = at + int(learns.sum()), row + docs

    return run


BLOCK = 32_768
_PARTS = "block int, part int, n long, cells binary"


def _blocks(cells: np.ndarray, n: int) -> pa.RecordBatch:
    """One task's table in blocks, to be added up with weight ``n``."""
    cut = [cells[i : i + BLOCK].astype("<f4").tobytes() for i in range(0, len(cells), BLOCK)]
    part = TaskContext.get().partitionId()
    cols = [pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([n] * len(cut), pa.int64()), pa.array(cut, pa.binary())]
    return pa.record_batch(cols, names=["block", "part", "n", "cells"])


def _added(parts: DataFrame) -> tuple[np.ndarray | None, int]:
    """Sum of ``n`` times the cells over all tasks, and of ``n``; each block is added up in one task."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("part", "n", "cells"))))
        total = np.zeros(len(rows[0][2]) // 4)
        for _, n, cells in rows:
            total += n * np.frombuffer(cells, "<f4").astype(np.float64)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "n": pa.array([sum(r[1] for r in rows)], pa.int64()), "cells": pa.array([total.tobytes()], pa.binary())})

    got = sorted(parts.groupBy("block").applyInArrow(add, "block int, n long, cells binary").collect(), key=lambda r: r["block"])
    return (np.concatenate([np.frombuffer(r["cells"]) for r in got]), got[0]["n"]) if got else (None, 0)


def _contexts(p: LmParams) -> tuple[np.ndarray, int]:
    """Kind of each index as a neighbour, and how many kinds there are."""
    top = 128
    context = np.minimum(np.arange(p.classed + FORMS + 1), top)
    context[p.classed :] = top + 1 + np.arange(FORMS + 1)
    return context, top + FORMS + 2


def _neighbours(p: LmParams):
    """How often each index has each kind of left and of right neighbour."""
    context, width = _contexts(p)
    size = len(context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * 2 * width, np.int64)
        for batch in batches:
            for s in (np.frombuffer(x, SEQ).astype(np.int64) for x in batch.column(0).to_pylist()):
                left, right = s[1:] * (2 * width) + context[s[:-1]], s[:-1] * (2 * width) + width + context[s[1:]]
                np.add.at(table, np.concatenate([left, right]), 1)
        cell = np.flatnonzero(table)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(table[cell])], names=["cell", "n"])

    return run


def _neighbour_table(seqs: DataFrame, p: LmParams) -> np.ndarray:
    """The table of all tasks: Spark adds up the cells that occur, which are of a fixed number at most."""
    cells = seqs.select("seq").mapInArrow(_neighbours(p), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((p.classed + FORMS + 1) * 2 * _contexts(p)[1])
    table[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    return table


def _dealt(near: np.ndarray, room: float) -> np.ndarray:
    """Class of each word: the nearest one that has room, the surest words first; so no softmax within a class is long."""
    room = int(np.ceil(room))
    out = np.full(len(near), -1, np.int64)
    full = np.zeros(near.shape[1], bool)
    while (left := np.flatnonzero(out < 0)).size:
        some = np.where(full, -np.inf, near[left])
        want, sure = some.argmax(1), some.max(1)
        for c in np.unique(want):
            mine = left[want == c][np.argsort(-sure[want == c], kind="stable")]
            mine = mine[: room - int((out == c).sum())]
            out[mine] = c
            full[c] = (out == c).sum() >= room
    return out


def cluster_words(table: np.ndarray, p: LmParams, present: int) -> np.ndarray:
    """Class of each index: k-means of the frequent words on their left and right neighbours."""
    size, width = p.classed + FORMS + 1, _contexts(p)[1]
    table = table.reshape(size, 2 * width)
    x = np.sqrt(table[:present]).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    out = np.zeros(size, np.int64)
    k = min(p.clusters, present)
    if k:
        mid = x[:k].copy()  # the most frequent words
        for _ in range(12):
            near = (x @ mid.T).argmax(1)
            for c in range(k):
                if (near == c).any():
                    mid[c] = x[near == c].mean(0)
            mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-9)
        out[:present] = _dealt(x @ mid.T, -(-p.fill * present // k))
    out[p.classed :] = p.clusters + np.arange(FORMS + 1)
    return out


def _exponents(s: np.ndarray, k: np.ndarray, v: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores ``s`` (place by token) the one at ``k``, and the sum of exponents, which ``s`` holds afterwards.

    States are between -1 and 1, so weights ``v`` and ``b`` bound the scores: only where exponents could run over are they taken from the largest.
    """
    said = s[k, np.arange(len(k))]
    if (np.abs(v).sum(0) + np.abs(b)).max(initial=0) > 80:
        top = s.max(0)
        s -= top
        said -= top
    np.exp(s, out=s)
    return said, s.sum(0)


def _sums(rows: np.ndarray, key: np.ndarray, out: np.ndarray) -> None:
    """Sums of the rows of each key into ``out``, tables side by side; the last row of all, which has no key, is zero.

    Rows of a key are added up eight at a time, so that few are left for a sum over runs of rows.
    """
    order, n = np.append(np.argsort(key.astype(SEQ), kind="stable"), len(key)), np.bincount(key, minlength=len(out))
    runs, end = -(-n // 8), np.cumsum(n)
    mine, last = np.repeat(np.arange(len(out)), runs), np.cumsum(runs)
    at = (end - n)[mine] + 8 * (np.arange(last[-1]) - (last - runs)[mine])
    at = order[np.where(at + np.arange(8)[:, None] < end[mine], at + np.arange(8)[:, None], len(key))]
    total = rows.take(at[0], axis=1)
    for some in at[1:]:
        total += rows.take(some, axis=1)
    out[n > 0] = np.add.reduceat(np.concatenate(total, axis=1), (last - runs)[n > 0])


class Gru:
    """A gated recurrent unit over words and their classes: input tables, recurrent weights, softmax over classes and within them."""

    def __init__(self, p: LmParams):
        rng, h, c = np.random.default_rng(p.seed), p.hidden, p.classes
        r = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        # Index `c` of the input table begins a document.
        # A word's own row is added to that of its class; the one after the last index begins a document.
        self.w = {"x": r(c + 1, 3 * h), "e": np.zeros((p.classed + FORMS + 2, 3 * h), np.float32), "u": r(h, 3 * h), "o": r(h, c), "b": np.zeros(c, np.float32), "v": np.zeros((p.classed, h), np.float32), "c": np.zeros(p.classed, np.float32)}
        self.h = h

    def set_words(self, class_of: np.ndarray, n: np.ndarray, p: LmParams) -> None:
        """The own words of each class; within it they begin at their counts ``n``."""
        self.class_of, present = class_of, len(n)
        self.group = np.full(len(class_of), -1, np.int16)
        self.group[:present] = class_of[:present]
        self.members = [np.flatnonzero(self.group == c) for c in range(p.clusters)]
        self.place = np.zeros(len(class_of), np.int64)
        # Members side by side, as many for each class; where a class has fewer, the row after the last word.
        self.side = np.full((p.clusters, max([1, *map(len, self.members)])), p.classed)
        for c, m in enumerate(self.members):
            self.place[m] = np.arange(len(m))
            self.side[c, : len(m)] = m
        self.w["c"][:present] = np.log(np.maximum(n, 1))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, cells: np.ndarray) -> None:
        cut = np.split(cells, np.cumsum([v.size for v in self.w.values()])[:-1])
        self.w = {k: q.reshape(v.shape).astype(np.float32) for (k, v), q in zip(self.w.items(), cut)}

    def inside(self, hs: np.ndarray, index: np.ndarray, grad: dict | None = None, dhs: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each own word within its class, 0 for others; adds gradients of the mean loss."""
        group, w, n = self.group[index], self.w, self.h
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(len(self.members) + 1))
        at, cut = order[cut[0] :], cut - cut[0]
        out = np.zeros(len(index), np.float32)
        # One product for each class; all else is done for the words of all classes at once, as one row for each place in a class.
        table = np.vstack([np.column_stack([w["v"], w["c"]]), np.append(np.zeros(n), -1e30)]).astype(np.float32)[self.side]
        h = np.ones((len(at), n + 1), np.float32)
        h[:, :n] = hs[at]
        s = np.empty((self.side.shape[1], len(at)), np.float32)
        runs = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        for c, run in runs:
            np.matmul(table[c], h[run].T, out=s[:, run])
        k, cols = self.place[index[at]], np.arange(len(at))
        said, z = _exponents(s, k, w["v"].T, w["c"])
        out[at] = said - np.log(z)
        if grad is not None:
            s /= z * np.float32(len(index))
            s[k, cols] -= np.float32(1 / len(index))
            back, dh = np.zeros_like(table), np.empty((len(at), n), np.float32)
            for c, run in runs:
                back[c] = s[:, run] @ h[run]
                np.matmul(s[:, run].T, table[c][:, :n], out=dh[run])
            dhs[at] += dh
            real = self.side < len(w["v"])
            grad["v"][self.side[real]] += back[real][:, :n]
            grad["c"][self.side[real]] += back[real][:, n]
        return out

    def inputs(self, words: bool = True) -> np.ndarray:
        """What each index, or class, gives to both gates and to the candidate, one table for each; the last row begins a document."""
        a = self.w["x"][np.append(self.class_of, len(self.w["x"]) - 1)] + self.w["e"] if words else self.w["x"]
        return self.gates(a)

    def gates(self, a: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(a.reshape(len(a), 3, self.h).transpose(1, 0, 2))

    def step(self, x: np.ndarray, h: np.ndarray, word: np.ndarray | None = None) -> tuple:
        """For classes ``x``, and words where they are given, after states ``h``: as ``advance``."""
        a = self.w["x"][x] + (0 if word is None else self.w["e"][word])
        return self.advance(self.gates(a), h, self.gates(self.w["u"]))

    def advance(self, x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From inputs ``x`` and states ``h``: new states and the recurrent part of the candidates; ``x`` then holds both gates and the candidates."""
        a, zr, c = h @ u, x[:2], x[2]
        zr += a[:2]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c += zr[1] * a[2]
        np.tanh(c, out=c)
        new = h - c
        new *= zr[0]
        new += c
        return new, a[2]

    def log_probs(self, hs: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(y), np.float32)
        for i in range(0, len(y), 4096):  # as much as stays in the processor's cache
            s = self.w["o"].T @ hs[i : i + 4096].T
            s += self.w["b"][:, None]
            said, z = _exponents(s, y[i : i + 4096], self.w["o"], self.w["b"])
            out[i : i + 4096] = said - np.log(z)
        return out

    def learn(self, streams: np.ndarray, starts: np.ndarray, p: LmParams, rate: float) -> None:
        """Truncated backpropagation along ``streams`` (time by lane) of indices; ``starts`` marks new documents."""
        w, n = self.w, self.h
        weights = self.flat()
        if not hasattr(self, "moments"):
            self.moments, self.turn = np.zeros((2, len(weights)), np.float32), 0
        # Weights and gradients as views of one row each, so that they are changed all at once.
        grads, spare, (m, v2) = np.zeros_like(weights), np.empty_like(weights), self.moments
        views = lambda row: {k: x.reshape(w[k].shape) for k, x in zip(w, np.split(row, np.cumsum([x.size for x in w.values()])[:-1]))}
        g, self.w = views(grads), views(weights)
        w = self.w
        classes = self.class_of[streams]
        in_class = (np.arange(len(w["x"]))[:, None] == np.append(self.class_of, p.classes)).astype(np.float32)
        width = streams.shape[1]
        h = np.zeros((width, n), np.float32)
        for t0 in range(0, len(streams), p.window):
            y, new = classes[t0 : t0 + p.window], starts[t0 : t0 + p.window]
            own = streams[t0 : t0 + p.window].astype(np.int64)
            before = streams[t0 - 1] if t0 else np.full(width, p.classed + FORMS + 1)
            word = np.where(new, p.classed + FORMS + 1, np.vstack([before[None], own[:-1]]))
            steps = len(y)
            prev, hs, gn = (np.empty((steps, width, n), np.float32) for _ in range(3))
            x, u = self.inputs().take(word, axis=1), self.gates(w["u"])
            for t in range(steps):
                prev[t] = h
                prev[t][new[t]] = 0
                hs[t], gn[t] = self.advance(x[:, t], prev[t], u)
                h = hs[t]
            flat = hs.reshape(-1, n)
            s = w["o"].T @ flat.T
            s += w["b"][:, None]
            s /= _exponents(s, y.ravel(), w["o"], w["b"])[1] * np.float32(len(flat))
            s[y.ravel(), np.arange(len(flat))] -= np.float32(1 / len(flat))
            grads[:] = 0
            g["o"][:], g["b"][:] = flat.T @ s.T, s.sum(1)
            dhs = s.T @ w["o"].T
            self.inside(flat, streams[t0 : t0 + p.window].ravel(), g, dhs)
            dhs = dhs.reshape(steps, width, n)
            # Derivatives of the state by what goes into each gate, for all steps; then backwards in time.
            z, r, c = x
            to_c = (1 - z) * (1 - c * c)
            to_z = (prev - c) * z * (1 - z)
            to_r = gn * r * (1 - r)
            rows = np.zeros((3, steps * width + 1, n), np.float32)  # the last row is for ``_sums``
            dg, dc = rows[:, :-1].reshape(3, steps, width, n), np.empty((steps, width, n), np.float32)
            dh, back = np.zeros((width, n), np.float32), np.ascontiguousarray(u.transpose(0, 2, 1))
            for t in range(steps - 1, -1, -1):
                dh += dhs[t]
                np.multiply(dh, to_c[t], out=dc[t])
                np.multiply(dh, to_z[t], out=dg[0, t])
                np.multiply(dc[t], to_r[t], out=dg[1, t])
                np.multiply(dc[t], r[t], out=dg[2, t])
                dh *= z[t]
                for part in dg[:, t] @ back:
                    dh += part
                dh[new[t]] = 0
            for k in range(3):
                g["u"][:, k * n : (k + 1) * n] = prev.reshape(-1, n).T @ dg[k].reshape(-1, n)
            dg[2] = dc
            _sums(rows, word.ravel(), g["e"])
            g["x"][:] = in_class @ g["e"]  # a class has what its words have
            h = h.copy()
            self.turn += 1
            grads *= np.float32(min(1.0, 1.0 / max(float(np.sqrt(grads @ grads)), 1e-9)))
            m *= np.float32(0.9)
            m += np.multiply(grads, np.float32(0.1), out=spare)
            v2 *= np.float32(0.999)
            np.multiply(grads, grads, out=spare)
            spare *= np.float32(0.001)
            v2 += spare
            np.sqrt(v2, out=spare)
            spare *= np.float32(1 / np.sqrt(1 - 0.999**self.turn))
            spare += np.float32(1e-8)
            np.divide(m, spare, out=spare)
            spare *= np.float32(rate / (1 - 0.9**self.turn))
            weights -= spare

    def score(self, seqs: list[np.ndarray], window: int = 16, index: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of each whole class sequence, and of the own words of ``index`` in it; many run side by side."""
        lens = np.array([len(s) for s in seqs])
        out = np.zeros(len(seqs))
        if not len(seqs):
            return out
        lanes = int(np.clip(lens.sum() // max(lens.max(), 1), 1, 512))
        line: list[list[int]] = [[] for _ in range(lanes)]
        load = np.zeros(lanes, np.int64)
        for i in np.argsort(-lens, kind="stable"):
            k = int(load.argmin())
            line[k].append(i)
            load[k] += lens[i]
        total = int(load.max())
        y, word = np.zeros((total, lanes), np.uint8), np.zeros((total, lanes) if index else (0, 0), SEQ)
        owner = np.full((total, lanes), -1, np.int32)
        new = np.zeros((total, lanes), bool)
        for k, own in enumerate(line):
            at = 0
            for i in own:
                y[at : at + lens[i], k], owner[at : at + lens[i], k], new[at, k] = seqs[i], i, True
                if index:
                    word[at : at + lens[i], k] = index[i]
                at += lens[i]
        h, u, table = np.zeros((lanes, self.h), np.float32), self.gates(self.w["u"]), self.inputs(bool(index))
        before = np.empty((total, lanes), np.int64)  # what each step has seen last
        before[1:] = (word if index else y)[:-1]
        before[0] = before[new] = table.shape[1] - 1
        x = np.empty((3, lanes, self.h), np.float32)
        for t0 in range(0, total, window):
            hs = np.empty((min(window, total - t0), lanes, self.h), np.float32)
            for t in range(len(hs)):
                h[new[t0 + t]] = 0
                table.take(before[t0 + t], axis=1, out=x, mode="clip")
                h = self.advance(x, h, u)[0]
                hs[t] = h
            who = owner[t0 : t0 + len(hs)].ravel()
            lp = self.log_probs(hs.reshape(-1, self.h), y[t0 : t0 + len(hs)].ravel())
            real = who >= 0
            if index:
                lp[real] += self.inside(hs.reshape(-1, self.h)[real], word[t0 : t0 + len(hs)].ravel()[real])
            out += np.bincount(who[real], weights=lp[real], minlength=len(seqs))
        return out


def _streams(seqs: list[np.ndarray], lanes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    order = rng.permutation(len(seqs))
    flat = np.concatenate([seqs[i] for i in order])
    new = np.zeros(len(flat), bool)
    new[np.cumsum([0, *[len(seqs[i]) for i in order[:-1]]])] = True
    lanes = max(1, min(lanes, len(flat) // 8))
    n = -(-len(flat) // lanes)
    # The last lane is filled up from the beginning, so that no token is left out.
    return np.resize(flat, (lanes, n)).T.copy(), np.resize(new, (lanes, n)).T.copy()


def _learned(gru: Gru, p: LmParams, rate: float):
    """A task's weights after its documents, and how many tokens these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([p.seed, TaskContext.get().partitionId()])
        held, size, total = [], 0, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, SEQ))
                size += len(held[-1])
                if size > p.chunk:
                    gru.learn(*_streams(held, p.lanes, rng), p, rate)
                    held, size, total = [], 0, total + size
        if held:
            gru.learn(*_streams(held, p.lanes, rng), p, rate)
        if total + size:
            yield _blocks(gru.flat(), total + size)

    return run


@dataclass
class LanguageModel:
    gru: Gru
    class_of: np.ndarray  # of own indices, forms and the end
    learned_tokens: int  # that the recurrent weights were fitted on
    train_tokens: int
    vocabulary: int


def _scored(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seqs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            lp = model.gru.score([model.class_of[x].astype(np.uint8) for x in seqs], index=seqs) / np.log(10)
            return pa.record_batch([pa.chunked_array(held).combine_chunks(), pa.array(lp)], names=["row", "lp"])

        for batch in batches:
            at = 0
            for i, x in enumerate(batch.column(1)):
                seqs.append(np.frombuffer(x.as_buffer(), SEQ))
                size += len(seqs[-1])
                if size > 6_000_000 or i + 1 == batch.num_rows:
                    held.append(batch.column(0).slice(at, i + 1 - at))
                    at = i + 1
                if size > 6_000_000:
                    yield flush()
                    held, seqs, size = [], [], 0
        if held:
            yield flush()

    return run


def train(docs: DataFrame, s: Scratch, p: LmParams) -> tuple[LanguageModel, DataFrame]:
    """The model, and the table (word, n) of all counts. ``docs(doc_id, text)`` are the training rows."""
    model, counts, seqs = _fitted(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), s, p)
    s.drop(seqs)
    return model, counts


def _fitted(rows: DataFrame, s: Scratch, p: LmParams) -> tuple[LanguageModel, DataFrame, DataFrame]:
    """As ``train``, from the rows that are not ``held_out``; and the sequences of all rows."""
    counted = rows.filter("not held_out").select("text").mapInArrow(_counts, "word long, form int, n long")
    counts = s.keep(counted.groupBy("word").agg(F.max("form").alias("form"), F.sum("n").alias("n")), "counts")
    # The count that `head` words at most reach, from a histogram of a few hundred steps of counts.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r["step"], r["v"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    room = np.cumsum([v for _, v in steps]) <= p.head
    least = steps[int(room.sum()) - 1][0] if room.any() else 1 << 30
    end = int(np.array([END]).view(np.int64)[0])
    top = counts.filter((step >= least) | (F.col("word") == F.lit(end))).select("word", "n").toPandas()
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    plain = word != END
    head = Head(word[plain], n[plain], p.classed)
    sums = {r["form"]: r for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, vocabulary = (sum(r[k] for r in sums.values()) for k in ("n", "v"))
    # Weight of each form class: counts plus one each, one more for the unseen.
    z = np.ones(FORMS)
    own_words = s.spark.createDataFrame([(int(x),) for x in head.word[head.own >= 0].view(np.int64)], "word long")  # `classed` rows at most
    rest = counts.join(F.broadcast(own_words), "word", "left_anti").filter("form >= 0").groupBy("form").agg((F.sum("n") + F.count(F.lit(1))).alias("z"))
    for r in rest.collect():
        z[r["form"]] += r["z"]
    head_all = Head(word, n, 0)
    head_all.own[np.searchsorted(head_all.word, head.word)] = head.own
    seqs = s.keep(rows.mapInArrow(_sequences(head_all, np.log10(z), p), _SEQUENCES), "sequences")
    present = min(p.classed, len(head.word))
    class_of = cluster_words(_neighbour_table(seqs.filter("turn >= 0"), p), p, present)
    gru, learned = Gru(p), 0
    own_n = np.zeros(present, np.int64)
    own_n[head.own[head.own >= 0]] = head.n[head.own >= 0]
    gru.set_words(class_of, own_n, p)
    # Each task sends its weights once: no more tasks than the tokens of a round fill.
    tasks = max(1, int(total or 0) // (p.rounds * p.chunk // 2))
    for k in range(p.rounds):
        parts = seqs.filter(F.col("turn") == k).select("seq").coalesce(tasks).mapInArrow(_learned(gru, p, p.rate * 0.7**k), _PARTS)
        cells, n_tokens = _added(parts)
        if n_tokens:
            gru.load(cells / n_tokens)
            learned += n_tokens
    return LanguageModel(gru, class_of, learned, int(total or 0), int(vocabulary or 0)), counts.select("word", "n"), seqs


def score_documents(docs: DataFrame, held_out: Column, p: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    s = Scratch(docs.sparkSession, "lmscore")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    model, counts, seqs = _fitted(rows, s, p)
    scored = s.keep(seqs.select("row", "seq").mapInArrow(_scored(model), "row long, lp double"), "scored")
    rare = seqs.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    known = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logc_more"))
    base = float(np.log10(model.train_tokens + model.vocabulary + 1))
    more = F.coalesce("logc_more", F.lit(0.0))
    out = seqs.drop("rare", "times", "seq").join(scored, "row").join(known, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logc") + more - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("part") + F.col("lp") + more).alias("score"),
    )
    return s.finish(out)


def op4_recurrent_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(7, 2))
