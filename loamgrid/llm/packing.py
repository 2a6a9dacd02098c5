"""Packing token sequences: patterns of lengths fitted to the length histogram.

Every document is tokenised and cut into pieces of ``size`` tokens at most. Only the histogram of
piece lengths (at most ``size`` numbers, whatever the corpus) reaches the driver. There:

1. lengths are grouped into ``grid`` classes and all patterns of two to ``depth`` classes that fill a
   sequence are enumerated;
2. repeat counts for the patterns are fitted to the histogram by non-negative least squares
   (active set), then rounded down to what the histogram holds;
3. the patterns are given real lengths, the longest of a class first and, last, the longest that
   fits what they leave; the residual lengths go,
   longest first, into the fullest sequence that has room, counts of equal sequences at a time.

The plan is a table of ranges: of the pieces of one length, ranks r1 to r2 go to sequences q, q + 1,
... at one offset. Its size is bounded by the number of lengths and classes and not by the corpus,
and it is what every task reads to place its own pieces. Ranks come from counts per task and length
and a running sum over tasks, so no task ever sees all pieces of one length.

Defined results: null and empty texts are one piece of the end id; repeated rows are packed as often
as they occur; null ids are packed as well; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.plans.session import Scratch


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    size: int = 4096
    end_id: int = 1
    grid: int = 64
    depth: int = 3
    filler: int = 256  # shorter pieces are left to fill the room that patterns leave


# Fixed value: the parts that a tokenizer of words cuts a text into; what is between them is dropped.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, changes white space at most besides, and cuts texts into ``WORD_PARTS``."""
    steps = lambda part, key: part.get(key, [part]) if (part := spec.get(part)) else []
    normal, cuts = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    plain = [n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normal]
    lower = any(n["type"] == "Lowercase" for n in normal)
    first = cuts[0] if cuts else {}
    parts = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PARTS} and first.get("behavior") == "Removed" and first.get("invert") is True
    return lower and all(plain) and parts and not any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in spec.get("added_tokens", []))


class WordEncoder:
    """Token ids of whole texts, each distinct word encoded once.

    For tokenizers that drop white space, never join across it, lower-case, and never join a letter with
    following punctuation; the file says whether it is one, and texts are encoded whole if not. Words
    that may hold a special token are left as they are. Where the model marks the last token of a word,
    words of letters are encoded many at a time.
    """

    def __init__(self, path: str, room: int = 1_000_000, group: int = 256):
        from tokenizers import Tokenizer

        self.tok, self.room, self.group = Tokenizer.from_file(path), room, group
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_words(json.load(f))
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Encodes words of letters in groups; returns those of groups that do not have one last token a word."""
        odd = []
        for i in range(0, len(words), self.group):
            some = words[i : i + self.group]
            ids = np.array(self.tok.encode(b" ".join(some).decode(), add_special_tokens=False).ids, np.uint32)
            cut = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(cut) != len(some):
                odd += some
                continue
            flat, start = ids.tobytes(), 0
            for w, end in zip(some, cut.tolist()):
                self.known[w] = flat[start:end]
                start = end
        return odd

    def _learn(self, words: set[bytes]) -> None:
        parts = {}
        for w in words:
            core = w.rstrip(b".,!?;:")
            plain = len(core) < len(w) and core[-1:].isalpha() and b"<|" not in w
            parts[w] = (core, w[len(core) :]) if plain else (w,)
        new = {x for p in parts.values() for x in p if x not in self.known}
        if self.last.any():
            letters = [w for w in new if w.decode("utf-8", "replace").isalpha()]
            new = [*new.difference(letters), *self._learn_letters(letters)]
        new = list(new)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for w, e in zip(some, self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, np.uint32).tobytes()
        for w, p in parts.items():
            if len(p) == 2:
                self.known[w] = self.known[p[0]] + self.known[p[1]]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        words = [(t.split() if b"<|" in t else t.lower().split()) if t else [] for t in texts]
        found = [list(map(self.known.get, ws)) for ws in words]
        new = {w for ws, ids in zip(words, found) if None in ids for w, x in zip(ws, ids) if x is None}
        if new:
            if len(self.known) + 2 * len(new) > self.room:
                self.known.clear()
            self._learn(new)
            for ws, ids in zip(words, found):
                if None in ids:
                    ids[:] = [self.known[w] if x is None else x for w, x in zip(ws, ids)]
        return [np.frombuffer(b"".join(ids), np.uint32) for ids in found]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(p: PackParams):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(p.tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(p.size + 1, np.int64)
        for part, texts in tokens.chunks(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                ids = np.append(ids, np.uint32(p.end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), p.size)):
                    one = ids[start : start + p.size]
                    out.append((doc_id, k, start, len(one), zlib.crc32(one.tobytes()), task, seen[len(one)]))
                    seen[len(one)] += 1
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def enumerate_patterns(bins: int, depth: int) -> np.ndarray:
    """Rows of counts over classes 1..bins: two to ``depth`` classes that add up to ``bins``."""
    out = []

    def grow(left: int, least: int, parts: list[int]) -> None:
        if left == 0:
            row = np.zeros(bins + 1)
            np.add.at(row, parts, 1)
            out.append(row)
        elif len(parts) < depth:
            for c in range(least, left + 1):
                grow(left - c, c, [*parts, c])

    grow(bins, 1, [])
    return np.array(out)[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (b - a @ x)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        if on.all() or w[~on].max(initial=0) <= tol:
            break
        on[int(np.argmax(np.where(on, -np.inf, w)))] = True
        while True:
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z[on].min(initial=1) > 0:
                x = z
                break
            bad = on & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
        w = a.T @ (b - a @ x)
    return x


class _Plan:
    """Groups of equal sequences: (room left, how many, [(length, offset)])."""

    def __init__(self, size: int):
        self.size, self.by_room = size, defaultdict(list)
        self.rooms: list[int] = []  # sorted, those with groups

    def add(self, count: int, items: tuple) -> None:
        room = self.size - (items[-1][0] + items[-1][1] if items else 0)
        if count:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((count, items))

    def take(self, length: int, most: int) -> tuple[int, tuple] | None:
        """The fullest group that has room for ``length``; of it at most ``most`` sequences."""
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        count, items = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.rooms[i]
        if count > most:
            self.add(count - most, items)
        return min(count, most), items

    def put(self, length: int, count: int) -> None:
        while count:
            got = self.take(length, count)
            n, items = got or (max(1, count // max(1, self.size // length)), ())
            if not got:  # new sequences, as many of this length in each as go
                each = min(self.size // length, count // n)
                self.add(n, tuple((length, k * length) for k in range(each)))
                count -= n * each
                continue
            at = items[-1][0] + items[-1][1] if items else 0
            self.add(n, (*items, (length, at)))
            count -= n


def plan_sequences(histogram: np.ndarray, p: PackParams) -> list[tuple[int, tuple]]:
    """(how many sequences, their (length, offset) items) for ``histogram[length]`` pieces."""
    left = histogram.astype(np.int64).copy()
    plan = _Plan(p.size)
    if left[p.size]:
        plan.add(int(left[p.size]), ((p.size, 0),))
        left[p.size] = 0
    step = p.size // p.grid
    cls = -(-np.arange(p.size + 1) // step)  # class c holds lengths up to c * step
    large = np.arange(p.size + 1) > p.filler
    hist = np.bincount(cls, weights=np.where(large, left, 0), minlength=p.grid + 1)[1:]
    patterns = enumerate_patterns(p.grid, p.depth)
    patterns = patterns[patterns[:, : p.filler // step].sum(1) == 0]
    if hist.sum() and len(patterns):
        x = nnls(patterns.T, hist)
        queue = {c: [n for n in range(min(c * step, p.size), (c - 1) * step, -1) if large[n] and left[n]] for c in range(1, p.grid + 1)}
        for row, times in sorted(zip(patterns, np.floor(x + 1e-9).astype(int)), key=lambda t: -t[1]):
            classes = [c + 1 for c in np.flatnonzero(row)[::-1] for _ in range(int(row[c]))]
            while times > 0:
                used, lengths = defaultdict(int), []
                for c in classes[:-1]:  # the longest length of the class that is left
                    while queue[c] and not left[queue[c][0]]:
                        queue[c].pop(0)
                    n = next((n for n in queue[c] if left[n] > used.get(n, 0)), None)
                    if n is None:
                        break
                    used[n] += 1
                    lengths.append(n)
                # The last one fills what the others leave: the longest length that fits.
                room = p.size - sum(lengths)
                n = next((n for n in range(room, (classes[-1] - 1) * step, -1) if left[n] > used.get(n, 0)), None)
                if len(lengths) + 1 < len(classes) or n is None:
                    break
                used[n] += 1
                lengths.append(n)
                k = int(min(times, min(left[n] // u for n, u in used.items())))
                at = np.cumsum([0, *lengths[:-1]])
                plan.add(k, tuple(zip(lengths, at.tolist())))
                for n, u in used.items():
                    left[n] -= k * u
                times -= k
    for n in range(p.size, 0, -1):
        plan.put(n, int(left[n]))
    return [g for groups in plan.by_room.values() for g in groups]


def _ranges(groups: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), in order of rank."""
    out: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    seq = 0
    for count, items in groups:
        for n, at in items:
            out[n].append((rank[n], seq, at))
            rank[n] += count
        seq += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place(ranges: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order], prepend=-1))
            for on in np.split(order, cut[1:]) if len(order) else []:
                rows = ranges[int(length[on[0]])]
                i = np.searchsorted(rows[:, 0], rank[on], side="right") - 1
                seq[on], off[on] = rows[i, 1] + rank[on] - rows[i, 0], rows[i, 2]
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.record_batch([*keep.columns, pa.array(seq), pa.array(off)], names=[*keep.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    p, spark = params, docs.sparkSession
    s = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = s.keep(source.mapInArrow(_pieces(p), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "task", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    histogram = np.zeros(p.size + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `size` rows
        histogram[row["length"]] = row["n"]
    ranges = _ranges(plan_sequences(histogram, p))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(ranges), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return s.finish(placed)


def token_sequences(docs: DataFrame, layout: DataFrame, params: PackParams) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from a layout of ``pack_documents``.

    Needs unique ids; a sequence gathers ``size`` ids at most.
    """
    p = params

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.tokenizer)
        for part, texts in tokens.chunks(batches):
            ids, k, piece = [], [], []
            for doc_id, x in zip(part.column(0).to_pylist(), enc.encode(texts)):
                x = np.append(x, np.uint32(p.end_id))
                for n, start in enumerate(range(0, len(x), p.size)):
                    ids.append(doc_id), k.append(n), piece.append(x[start : start + p.size].astype(np.int32))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(k, pa.int32()), pa.array(piece, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = source.mapInArrow(cut, "doc_id long, piece int, ids array<int>").join(layout, ["doc_id", "piece"])
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten("rows.ids").alias("ids"))


def default_params() -> PackParams:
    import public_tokenizers

    return PackParams(public_tokenizers.path("word_bpe_49k.json"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_params())
