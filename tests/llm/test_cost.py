"""Steps that decide what an operator costs: the same results as plain loops, without one Python step for each word."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.llm import lmscore, suffixdup, tokens

ODD = [None, b"", b" ", b"a", b"\x00A\x1c \x85b".replace(b"\x85", "\x85".encode()), "Ä ö x\tY\r\n".encode(), b" x  x\x0b\x0cx ", b"\n"]


def test_words_are_indexed_as_they_are_split():
    """OP4: distinct words and places equal those of splitting each text, also in a slice of a batch."""
    deal = random.Random(7)
    texts = ODD + ["".join(deal.choices("aBä \t\n\x0e", k=deal.randrange(40))).encode() for _ in range(200)]
    for some, part in ((texts, pa.array(texts, pa.binary())), (texts[3:90], pa.array(texts, pa.binary())[3:90]), ([None], pa.array([None], pa.binary()))):
        words, seq, lens = tokens.indexed(part)
        names, cut = words.to_pylist(), np.cumsum([0, *lens])
        assert len(set(names)) == len(names)
        assert [[names[k] for k in seq[a:b]] for a, b in zip(cut[:-1], cut[1:])] == [tokens.words_of(t) for t in some]


def test_lm_reads_words_without_a_step_for_each(monkeypatch):
    """OP4: counts and sequences take no Python step a word."""
    from pyspark import TaskContext

    monkeypatch.setattr(tokens, "words_of", lambda text: pytest.fail("a text was split into Python words"))
    monkeypatch.setattr(TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 1})())
    texts = [b"b a b", None, b"c A"]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([False, True, False]), pa.array(texts, pa.binary())], names=["doc_id", "held_out", "text"])
    got = pa.Table.from_batches(lmscore._counts(iter([batch])))
    n = dict(zip(got["word"].to_numpy().view(np.uint64).tolist(), got["n"].to_pylist()))
    h = {w: int(tokens.hashes([w])[0]) for w in (b"a", b"b", b"c")}
    assert n == {h[b"a"]: 2, h[b"b"]: 2, h[b"c"]: 1, int(lmscore.END): 3}
    head = lmscore.Head(np.array([h[b"a"], h[b"b"]], np.uint64), np.array([2, 3]), 1)  # b has an index of its own
    p = lmscore.LmParams(classed=1)
    rows = pa.Table.from_batches(lmscore._sequences(head, np.zeros(lmscore.FORMS), p)(iter([batch]))).to_pylist()
    form = p.classed + int(lmscore.forms_of(pa.array([b"a"]))[0])
    end = p.classed + lmscore.FORMS
    assert [np.frombuffer(r["seq"], lmscore.SEQ).tolist() for r in rows] == [[0, form, 0, end], [end], [form, form, end]]
    assert [r["turn"] for r in rows] == [0, -1, 1] and [r["n_tokens"] for r in rows] == [4, 1, 3] and [r["n_known"] for r in rows] == [3, 0, 1]
    assert [[x % 2**64 for x in r["rare"]] for r in rows] == [[], [], [h[b"c"]]] and [r["times"] for r in rows] == [[], [], [1]]
    assert np.allclose([r["part"] for r in rows], np.log10([3, 1, 3])) and np.allclose([r["logc"] for r in rows], np.log10([4 * 3 * 4, 1, 3]))


def test_sums_of_rows_and_large_scores():
    """OP4: rows are added up by key in runs of eight; scores beyond the range of exponents are still probabilities."""
    r = np.random.default_rng(1)
    key = np.concatenate([np.full(100, 3), r.integers(0, 9, 50), [11]])
    rows = np.zeros((3, len(key) + 1, 4), np.float32)
    rows[:, :-1] = r.normal(size=(3, len(key), 4))
    out, want = np.zeros((12, 12), np.float32), np.zeros((12, 12))
    lmscore._sums(rows, key, out)
    np.add.at(want, key, np.concatenate(rows[:, :-1], axis=1))
    assert np.allclose(out, want, atol=1e-4)
    p = lmscore.LmParams(hidden=4, clusters=4)
    g = lmscore.Gru(p)
    g.w["b"][:2] = 200, 199
    lp = g.log_probs(np.zeros((2, 4), np.float32), np.array([0, 1]))
    assert np.allclose(lp, [-np.log1p(np.exp(-1)), -1 - np.log1p(np.exp(-1))], atol=1e-5)


def test_decided_windows_of_a_match_are_one_interval():
    """OP10: suffixes that follow each other in a match give one decided interval; where one is missing, two; found ends stay."""
    p, words = suffixdup.SuffixParams(), [b"w%d" % i for i in range(300)]
    whole, places = b" ".join(words), range(0, 240, 8)
    for seeds, want in ((list(places), [(0, 289)]), ([k for k in places if k != 80], [(0, 129), (88, 289)])):
        rows = [{"place": k + 2, "head_place": k, "since": k + 2, "until": k + 10} for k in seeds]
        cols = {"doc_id": [7], "part": [1], "head_id": [3], "head_part": [2], "text": [b"x Y " + whole.upper()], "head_text": [whole + b" z"]}
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("place", "head_place", "since", "until")]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        batch = pa.record_batch([*(pa.array(v, t) for v, t in zip(cols.values(), types)), pa.array([rows], kind)], names=[*cols, "seeds"])
        got = [tuple(r.values()) for r in pa.Table.from_batches(suffixdup._extended(p)(iter([batch]))).to_pylist()]
        assert sorted(r[3:] for r in got if r[:3] == (3, 2, suffixdup.DECIDED)) == want
        assert sorted(r[3:] for r in got if r[:3] == (7, 1, suffixdup.DECIDED)) == [(a + 2, b + 2) for a, b in want]
        assert {r for r in got if r[2] != suffixdup.DECIDED} == {(7, 1, suffixdup.REPEAT, 2, 302), (3, 2, suffixdup.FIRST, 0, 300)}


def test_hashes_of_indexed_words():
    """OP3, OP10: hashes of all words in a row are those of the words split one text at a time."""
    x, ends = tokens.word_hashes(ODD)
    assert x.tolist() == [int(h) for t in ODD for h in tokens.hashes(tokens.words_of(t))]
    assert ends.tolist() == np.cumsum([0, *(len(tokens.words_of(t)) for t in ODD)]).tolist()
