"""Repeated passages by a sparse suffix array.

Suffixes are kept only at minimiser positions: of every ``window`` neighbouring ``seed``-word
hashes the smallest is kept, so equal word sequences keep suffixes at equal places. Every repeated
passage of ``min_words`` words has such a suffix in its first ``window`` places, followed by at
least ``core`` more words of the passage.

1. Sort and compare. Suffixes are sorted by their words (codes of the first eight, then a hash of all
   ``core`` words, then doc_id and place, so that the suffixes of one very common passage spread over
   many tasks), and each is compared with its neighbours; the outermost rows of each task are compared
   across tasks. Those without an equal neighbour go. The first of equal ones is their head.
2. Extend. Every other suffix is laid beside its head, and the two texts are compared word by word to
   the left and to the right. What comes to ``min_words`` words or more is a match.
3. A passage may be shared by two documents and not by the head of its suffixes. Of its windows of
   ``min_words`` words each chose a suffix in its first ``window`` places. Those that chose a repeated
   one and are in no match with its head, and only those, are compared with each other, and equal ones are laid side by side and extended as in 2.

The first occurrence (smallest doc_id, then place) is kept; later ones are repeats. So the result
equals that of comparing all windows of ``min_words`` words with each other.

Words are compared after lower-casing A-Z. Defined results: null and short texts have no spans; a
document is a distinct pair of id and text, so rows that repeat both are one document, and rows that
share an id only are two; a passage that one document alone repeats is left; null ids are left alone;
an empty table gives an empty result; extra columns are ignored or passed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.plans.session import Scratch

_KEY = ["first4", "next4", "core"]
_AT = ["doc_id", "part", "place"]
_CHOSE = ["since", "until"]
_SUFFIX = "first4 long, next4 long, core long, doc_id long, part int, place int, since int, until int"  # the windows from `since` on before `until` chose it


@dataclass(frozen=True)
class SuffixParams:
    min_words: int = 50
    window: int = 16
    seed: int = 6

    @property
    def core(self) -> int:
        return self.min_words - self.window + 1  # eight or more


def chosen(win: tokens.Windows, p: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``window`` seeds from them on in their text, and where the smallest of these (leftmost of equals) is.

    It depends on these words only, so equal passages choose equal places, whatever stands before them.
    """
    at = win.starts(p.seed + p.window - 1)  # windows of seeds that end inside their text
    if not len(at):
        return at, at
    h = win.at(win.starts(p.seed), p.seed)
    full = np.full(win.n, np.iinfo(np.uint64).max, np.uint64)
    full[win.starts(p.seed)] = h
    low, size = full.copy(), 1
    place = np.arange(win.n)
    while size < p.window:
        step = min(size, p.window - size)
        other, where = np.roll(low, -step), np.roll(place, -step)
        less = other < low
        low, place = np.where(less, other, low), np.where(less, where, place)
        size += step
    return at, place[at]


def _columns(part: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    """doc_id and part of each row that document ``doc`` of the batch gives."""
    return [part.column(n).take(pa.array(doc)) for n in ("doc_id", "part")]


def _anchors(p: SuffixParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            x, ends = tokens.word_hashes(texts)
            win = tokens.Windows(x, ends)
            starts, choice = chosen(win, p)
            at, first, n = np.unique(choice, return_index=True, return_counts=True)
            whole = at + p.core <= win.stop[at] if len(at) else np.zeros(0, bool)
            at, since, n = at[whole], starts[first[whole]], n[whole]
            doc, code = win.doc[at], x >> np.uint64(48)
            lead = []
            for k in (0, 4):
                four = np.zeros(len(at), np.uint64)
                for i in range(k, k + 4):
                    four = (four << np.uint64(16)) | code[at + i]
                lead.append(tokens.signed(four))
            yield pa.record_batch([*lead, tokens.signed(win.at(at, p.core)), *_columns(part, doc), *(pa.array((v - ends[doc]).astype(np.int32)) for v in (at, since, since + n))], names=[*_KEY, *_AT, *_CHOSE])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted suffixes: those equal to a neighbour (``hit``), and its first and last (``edge``)."""
    names = [*_KEY, *_AT, *_CHOSE]

    def show(cols: list[np.ndarray], hit: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        on = hit | edge
        return pa.record_batch([pa.array(c[on]) for c in [*cols, hit, edge]], names=[*names, "hit", "edge"])

    last, last_hit, last_edge = None, False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last, cols)]
        same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[: len(_KEY)]])
        hit = np.concatenate([[last_hit], same]) | np.concatenate([same, [False]])
        edge = np.zeros(len(hit), bool)
        edge[0] = last_edge  # true until a second row has come
        yield show([c[:-1] for c in cols], hit[:-1], edge[:-1])
        last, last_hit, last_edge = [c[-1:] for c in cols], bool(hit[-1]), bool(edge[-1])
    if last is not None:
        yield show(last, np.array([last_hit]), np.array([True]))


def _run_length(same: np.ndarray) -> int:
    """How many of the first are true."""
    return len(same) if same.all() else int(same.argmin())


_MATCH = "doc_id long, part int, kind int, lo int, hi int"
FIRST, REPEAT, DECIDED = 0, 1, 2
_HEAD = ["head_id", "head_part", "head_place"]


def _words(batch: pa.RecordBatch, ids: list[list[tuple]]) -> tuple[np.ndarray, dict[tuple, tuple[int, int]]]:
    """Words of the texts of a batch, each document's once, as places among the distinct ones; and where each document's begin and end."""
    first: dict[tuple, int] = {}
    for k, keys in enumerate(ids):
        for row, key in enumerate(keys):
            first.setdefault(key, 2 * row + k)
    row, side = np.divmod(np.fromiter(first.values(), np.int64, len(first)), 2)
    texts = [batch.column(n).take(pa.array(row[side == k])) for k, n in enumerate(("text", "head_text"))]
    _, word, lens = tokens.indexed(pa.concat_arrays(texts))
    cut = np.cumsum([0, *lens.tolist()]).tolist()
    keys = [key for k in (0, 1) for key, x in zip(first, side) if x == k]
    return word, dict(zip(keys, zip(cut[:-1], cut[1:])))


def _extended(p: SuffixParams):
    """From pairs of documents with the places at which they agree: the matches, of both sides.

    Words are compared by their place among the distinct words of all texts at hand, so equal places are equal words.
    Within one document nothing is extended, as more of it may be in no other. Of suffixes that follow each other in a
    match the decided windows are one interval where they leave no gap.
    """

    def reach(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int]:
        """Words before and from places ``i`` and ``j`` that agree."""
        n = min(i, j)
        left = _run_length(x[i - n : i][::-1] == y[j - n : j][::-1])
        n = min(len(x) - i, len(y) - j)
        return left, _run_length(x[i : i + n] == y[j : j + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
        for batch, _ in tokens.chunks(batches):
            rows = []
            ids = [list(zip(*(batch.column(n).to_pylist() for n in names))) for names in (("doc_id", "part"), _HEAD[:2])]
            word, at = _words(batch, ids)
            seeds = batch.column("seeds")
            cut, flat = seeds.offsets.to_numpy(), seeds.values
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            for a, (me, head) in enumerate(zip(*ids)):
                x, y = word[slice(*at[me])], word[slice(*at[head])]
                place, other, since, until = (f[cut[a] : cut[a + 1]] for f in fields)
                order, end, last, decided = np.lexsort((place, place - other)), -1, None, []
                for i, j, k0, k1 in zip(*(f[order].tolist() for f in (place, other, since, until))):
                    if i >= end or i - j != last:
                        if me != head:
                            left, right = reach(x, y, i, j)
                        elif (x[i : i + p.min_words] == y[j : j + p.min_words]).all():
                            left, right = 0, p.min_words
                        else:
                            continue  # equal hashes of different words
                        lo, hi, last, end = i - left, i + right, i - j, i + (right if me != head else 0)
                        if hi - lo >= p.min_words:
                            rows += [(*me, REPEAT, lo, hi), (*head, FIRST, lo - i + j, hi - i + j)]
                    # The windows that chose this suffix and lie in the match.
                    k0, k1 = max(lo, k0), min(k1 - 1 + p.min_words, hi)
                    if k1 - k0 >= p.min_words and me != head:
                        if decided and decided[-1][0] == i - j and decided[-1][1] <= k0 <= decided[-1][2] - p.min_words + 1:
                            decided[-1][2] = max(decided[-1][2], k1)
                        else:
                            decided.append([i - j, k0, k1])
                for shift, k0, k1 in decided:
                    rows += [(*me, DECIDED, k0, k1), (*head, DECIDED, k0 - shift, k1 - shift)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return run


def _matches(seeds: DataFrame, held: DataFrame, s: Scratch, p: SuffixParams) -> DataFrame:
    """(doc_id, part, kind, lo, hi) of ``seeds``: places of documents and the earlier places that they agree with.

    ``kind`` tells first occurrences, repeats and, of both, the windows decided by the head of the suffix
    that they chose: what holds for one holder of such a window then holds for all. Of the intervals that begin at one word the longest stays, so a document has three for each of its
    words at most, however many others share them.
    """
    pairs = seeds.groupBy("doc_id", "part", *_HEAD[:2]).agg(F.collect_list(F.struct("place", "head_place", *_CHOSE)).alias("seeds"))
    mine = held.select("doc_id", "part", "text").hint("merge")
    heads = held.select(F.col("doc_id").alias("head_id"), F.col("part").alias("head_part"), F.col("text").alias("head_text")).hint("merge")
    both = pairs.join(mine, ["doc_id", "part"]).join(heads, _HEAD[:2])
    found = both.select("doc_id", "part", *_HEAD[:2], "seeds", "text", "head_text").mapInArrow(_extended(p), _MATCH)
    return s.keep(found.groupBy("doc_id", "part", "kind", "lo").agg(F.max("hi").alias("hi")), "matches")


def _flat(column: pa.ListArray, ends: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """What the lists of a column hold, in a row, and the number of the list (or where its text starts in ``ends``) for each."""
    n = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(n)) if ends is None else ends[:-1], n), column.flatten()


def _starts(n: int, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` places begin a window of ``width`` words inside an interval."""
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(hi - width + 1, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _rest(p: SuffixParams):
    """From (doc_id, part, text, places, own, found): the windows that chose a repeated suffix whose head does not hold them.

    Of suffixes that this document itself repeats (``own``) all windows, with a mark whether a match holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tokens.chunks(batches):
            x, ends = tokens.word_hashes(texts)
            win = tokens.Windows(x, ends)
            begin, found = _flat(part.column("found"), ends)
            kind, lo, hi = (found.field(k).to_numpy() for k in range(3))
            within = lambda some: _starts(win.n, (begin + lo)[some], (begin + hi)[some], p.min_words)  # noqa: E731, B023
            mark, decided = within(kind != DECIDED), within(kind == DECIDED)
            repeated, own = np.zeros(win.n, bool), np.zeros(win.n, bool)
            for marks, column in ((repeated, "places"), (own, "own")):
                begin, places = _flat(part.column(column), ends)
                marks[begin + places.to_numpy()] = True
            at, choice = chosen(win, p)
            at = at[(repeated[choice] & ~decided[at]) | own[choice]] if len(at) else at
            at = at[at + p.min_words <= win.stop[at]] if len(at) else at
            doc = win.doc[at]
            yield pa.record_batch([tokens.signed(win.at(at, p.min_words)), *_columns(part, doc), pa.array((at - ends[doc]).astype(np.int32)), pa.array(mark[at])], names=["gram", *_AT, "held"])

    return run


_SPAN = "doc_id long, text_key long, start_word int, end_word int, start_char int, end_char int, is_repeat boolean"


def _spans(p: SuffixParams):
    """From (doc_id, text_key, text, found): merged spans in words and in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _SPAN.split(", "))])
        for part, texts in tokens.chunks(batches):
            rows = []
            begin, found = _flat(part.column("found"))
            kind, low, high = (found.field(k).to_numpy() for k in range(3))
            cut = np.searchsorted(begin, np.arange(part.num_rows + 1))
            for a, (doc_id, key, text) in enumerate(zip(*(part.column(n).to_pylist() for n in ("doc_id", "text_key")), texts)):
                bounds = tokens.word_bounds(text)
                # bytes -> characters: count the bytes that begin one
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                of, lows, highs = (v[cut[a] : cut[a + 1]] for v in (kind, low, high))
                on = {r: _starts(len(bounds), lows[of == r], highs[of == r], p.min_words) for r in (FIRST, REPEAT)}
                on[FIRST] &= ~on[REPEAT]  # a first occurrence is in no earlier document
                for repeat, starts in ((r == REPEAT, x) for r, x in on.items()):
                    at = np.flatnonzero(starts)
                    if not len(at):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + p.min_words]))
                    for lo, hi in zip(at[new], at[np.append(new[1:] - 1, len(at) - 1)] + p.min_words):
                        rows.append((doc_id, key, int(lo), int(hi), int(chars[bounds[lo, 0]]), int(chars[bounds[hi - 1, 1]]), repeat))
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, params: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of ``min_words`` words or more that two documents or more hold, at each place.

    doc_id, text_key (which of the texts with this id), start_word, end_word, start_char, end_char,
    is_repeat (false at the first occurrence).
    """
    p = params
    s = Scratch(docs.sparkSession, "suffixdup")
    text = F.col(text_col).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("part"), F.xxhash64(text).alias("text_key"), text.alias("text")).filter("doc_id is not null")

    # 1. Sort and compare.
    suffixes = s.keep(source.select("doc_id", "part", "text").mapInArrow(_anchors(p), _SUFFIX), "suffixes")
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order, kept = [*_KEY, *_AT], [*_KEY, *_AT, *_CHOSE]
    ranked = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    near = s.keep(ranked.mapInArrow(_neighbours, _SUFFIX + ", hit boolean, edge boolean"), "neighbours")
    s.drop(suffixes)
    across = near.filter("edge").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*_KEY)
    across = s.keep(near.filter("edge and not hit").join(across, _KEY).select(*kept), "across")  # two rows a task at most
    equal = near.filter("hit").select(*kept).union(across)
    heads = equal.groupBy(*_KEY).agg(F.min(F.struct(*_AT)).alias("h"), F.max(F.struct(*_AT[:2])).alias("top"))
    heads = heads.filter((F.col("h.doc_id") != F.col("top.doc_id")) | (F.col("h.part") != F.col("top.part")))
    # Written first: both sides of the join are then plain shuffles, and Spark splits the task of a very common suffix.
    heads = s.keep(heads.select(*_KEY, F.col("h.doc_id").alias("head_id"), F.col("h.part").alias("head_part"), F.col("h.place").alias("head_place")), "heads").hint("merge")
    seeds = s.keep(equal.join(heads, _KEY).select(*_AT, *_CHOSE, *_HEAD), "seeds")
    s.drop(near)
    alike = (F.col("doc_id") == F.col("head_id")) & (F.col("part") == F.col("head_part"))
    again = alike & (F.col("place") != F.col("head_place"))
    places = seeds.groupBy("doc_id", "part").agg(
        F.collect_set("place").alias("places"), F.array_union(F.collect_set(F.when(again, F.col("place"))), F.collect_set(F.when(again, F.col("head_place")))).alias("own")
    )
    held = s.keep(source.join(places.hint("merge"), ["doc_id", "part"]).dropDuplicates(["doc_id", "part"]), "texts")

    # 2. Extend.
    found = _matches(seeds.filter(~alike), held, s, p)
    s.drop(seeds)

    # 3. What is around repeated suffixes and in no match.
    grouped = lambda m, of=("kind", "lo", "hi"): m.groupBy("doc_id", "part").agg(F.collect_list(F.struct(*of)).alias("found"))
    left = held.join(grouped(found).hint("merge"), ["doc_id", "part"], "left")
    grams = s.keep(left.select("doc_id", "part", "text", "places", "own", "found").mapInArrow(_rest(p), "gram long, doc_id long, part int, place int, held boolean"), "windows")
    first = grams.groupBy("gram").agg(F.min(F.struct(*_AT)).alias("h"), F.max(F.struct(*_AT[:2])).alias("top"), F.max("held").alias("held"))
    first = first.filter(F.col("held") | (F.col("h.doc_id") != F.col("top.doc_id")) | (F.col("h.part") != F.col("top.part")))
    first = s.keep(first.select("gram", F.col("h.doc_id").alias("head_id"), F.col("h.part").alias("head_part"), F.col("h.place").alias("head_place")), "first").hint("merge")
    later = grams.join(first, "gram").select(*_AT, F.col("place").alias("since"), (F.col("place") + 1).alias("until"), *_HEAD).filter(~alike | (F.col("place") != F.col("head_place")))
    found = found.unionByName(_matches(later, held, s, p)).filter(F.col("kind") != DECIDED)

    spans = held.select("doc_id", "part", "text_key", "text").join(grouped(found).hint("merge"), ["doc_id", "part"])
    return s.finish(spans.select("doc_id", "text_key", "text", "found").mapInArrow(_spans(p), _SPAN))


def without_repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """The documents with every repeat cut out of their text; all rows and columns stay."""
    spans = repeated_spans(docs, params).filter("is_repeat")
    cuts = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("cuts")).hint("merge")
    # The whole row travels as one column, so no name of the caller's can clash.
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row")["text"]
    same = (F.col("row")["doc_id"].cast("long") == F.col("doc_id")) & (F.xxhash64(text.cast("binary")) == F.col("text_key"))
    out = rows.join(cuts, same, "left")
    # The pieces between cuts: from each end to the next start.
    ends = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end_char"]))
    starts = F.concat(F.transform("cuts", lambda c: c["start_char"]), F.array(F.char_length(text)))
    parts = F.zip_with(ends, starts, lambda a, b: text.substr(a + 1, F.greatest(b - a, F.lit(0))))
    return out.withColumn("row", F.col("row").withField("text", F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(parts, "")))).select("row.*")


def op10_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
