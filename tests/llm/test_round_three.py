"""Line deduplication, hard negatives and the Merkle manifest against brute force, with odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import hardneg, linedup, lmscore, merkle, tokens
from loamgrid.plans.session import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, line string, row string, drop string"
SPACE = " \t\x0b\x0c\r"
A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
lower = lambda t: t.translate(str.maketrans(A, Z))
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefghijklmno ÄéX") for _ in range(n)).strip() + "q"
    shared, out = [line(60) for _ in range(6)] + ["x" * 40, "x" * 39, "Ä" * 41], []
    for i in range(40):
        lines = [line(r.randint(0, 80)) for _ in range(r.randint(0, 6))]
        for s in shared:
            if r.random() < 0.3:
                lines += [r.choice(["", " ", "\t\x0b"]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", "  ", "\r"])] * r.choice([1, 1, 3])
        r.shuffle(lines)
        out.append((i, "\n".join(lines)))
    out += [(100 + i, shared[0]) for i in range(4)] + [(200, None), (201, ""), (202, "\n"), (203, "\n\n" + shared[0] + "\n")]
    out += [(300, shared[0] + "\nfirst"), (300, shared[1] + "\nsecond"), (300, shared[1] + "\nsecond"), (None, shared[0] + "\nno id"), (None, shared[0] + "\u0085  \nno id")]
    out += [(400, "\n".join(f"{k} {shared[k % 6]}" if k % 3 else shared[k % 6] for k in range(3000)))]
    langs = ["en"] * 30 + ["de", "fr", None, "é", "z"]
    return [(i, t, r.choice(langs), r.choice(["s", None]), r.choice([None, 7]), 1, "mine", "mine", "mine") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _lines(rows, min_chars, min_docs):
    """(doc_id, text, lines, dropped, what stays) by plain loops."""
    key = lambda x: lower(x.strip(SPACE))
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(order(r[0]))
    bad = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if bad.get(key(x), order(r[0])) == order(r[0])]
        out.append((r[0], r[1], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("min_chars,min_docs", [(40, 5), (1, 2), (0, 1)])
def test_shared_lines_stay_in_one_document(docs, rows, min_chars, min_docs):
    want = _lines(rows, min_chars, min_docs)
    got = linedup.deduplicate_lines(docs, min_chars, min_docs).collect()
    assert Counter((g.row.doc_id, g.row.text, g.n_lines, g.n_dropped, g.text) for g in got) == Counter(want)
    assert sum(w[3] for w in want) > 100 or min_docs == 1
    out = linedup.without_shared_lines(docs, min_chars, min_docs)
    assert out.columns == docs.columns and out.filter("line <> 'mine' or row <> 'mine' or drop <> 'mine'").count() == 0
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter((w[0], w[4] if w[3] else w[1]) for w in want)


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linedup.deduplicate_lines(empty).count() == 0 and linedup.without_shared_lines(empty).columns == empty.columns
    # Copies of one row are one document, whatever their number; all of them lose what it loses.
    long = "a line of more than forty code points, it is"
    same = spark.createDataFrame([(1, long)] * 50 + [(i, long) for i in range(2, 5)], "doc_id long, text string")
    assert linedup.deduplicate_lines(same).filter("n_dropped > 0").count() == 0
    one_more = same.union(spark.createDataFrame([(9, long + "\n" + long)], "doc_id long, text string"))
    got = linedup.deduplicate_lines(one_more).groupBy("row.doc_id").agg(F.sum("n_dropped").alias("n")).collect()
    assert {g.doc_id: g.n for g in got} == {1: 50, 2: 1, 3: 1, 4: 1, 9: 0}


def _mined(rows, p, anchor):
    """All pairs, in plain integers."""
    size = max((len(v) for _, v, _ in rows if v), default=0)
    ready = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in ready or (label, v) < ready[i]:
            ready[i] = (label, v)
    q = {i: [math.floor(p.scale * float(np.float32(x))) for x in v] + [0] * (size - len(v)) for i, (_, v) in ready.items()}
    label = {i: x[0] for i, x in ready.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    out = []
    for a in filter(anchor, q):
        all_ = sorted((-dot(a, b), b) for b in q if b != a)
        for s, x in [y for y in all_ if label[y[1]] == label[a]][: p.positives]:
            fits = [(t, b) for t, b in all_ if label[b] != label[a] and p.low * -s <= 100 * -t <= p.high * -s]
            out += [(a, x, k, b, -s, -t) for k, (t, b) in enumerate(fits[: p.negatives], 1)]
    return sorted(out)


def _vectors(seed, n, dim=12):
    r = random.Random(seed)
    near = [r.uniform(-0.5, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = near if i % 3 == 0 else [r.choice([-0.25, 0.0, 0.125, 0.5, r.uniform(-1, 1)]) for _ in range(dim)]  # ties
        rows.append((i, list(v), r.randrange(4)))
    return rows


@pytest.mark.parametrize("tile", [(3, 7, 5), (256, 16384, 64), (8, 400, 1)])
def test_hard_negatives(spark, tile):
    rows = _vectors(1, 300)
    rows += [(None, [1.0] * 12, 1), (500, None, 1), (510, [1.0] * 12, None), (520, [None] + [1.0] * 11, 1), (530, [float("nan")] * 12, 1), (540, [float("inf")] + [0.0] * 11, 1)]
    rows += [(550, [], 1), (560, [0.5, 0.5], 2), rows[10], rows[10], (20, [9.0] * 12, 3), (570, [0.001] * 12, 9)]
    df = spark.createDataFrame([(*x, "mine", 1) for x in rows], "vec_id long, embedding array<float>, label int, id string, vector int")
    p = hardneg.MiningParams(anchors_per_tile=tile[0], rows_per_tile=tile[1], tiles=tile[2])
    got = hardneg.hard_negatives(df, F.col("id") % 10 == 0, p).collect()
    want = _mined(rows, p, lambda i: i % 10 == 0)
    assert len(want) > 200 and sorted(tuple(g) for g in got) == want
    assert not any(g.anchor_id in (500, 510, 520, 530, 540) for g in got)


def test_hard_negatives_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    every = F.col("id") >= 0
    assert hardneg.hard_negatives(spark.createDataFrame([], ddl), every).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], ddl), every).count() == 0
    few = [(i, [float(i % 2), -1.0], i % 3) for i in range(1, 9)]
    got = hardneg.hard_negatives(spark.createDataFrame(few, ddl), every)
    assert sorted(tuple(g) for g in got.collect()) == _mined(few, hardneg.MiningParams(), lambda i: True)
    with pytest.raises(Exception, match="64 bits"):
        hardneg.hard_negatives(spark.createDataFrame([(1, [3e38], 1), (2, [3e38], 1)], ddl), every).count()


def test_strassen_is_the_product():
    r = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (5, 3, 7), (33, 65, 129), (64, 64, 64), (100, 31, 17), (0, 4, 4), (4, 0, 4)):
        a, b = r.integers(-(1 << 20), 1 << 20, (m, k)), r.integers(-(1 << 20), 1 << 20, (k, n))
        for leaf in (1, 2, 16, 1000):
            assert (hardneg.strassen(a, b, leaf) == a.astype(object) @ b.astype(object)).all() if k else (hardneg.strassen(a, b, leaf) == 0).all()
    a, b = r.integers(-99, 99, (70, 40)), r.integers(-99, 99, (600, 40))
    assert (hardneg.product(a, b) == a @ b.T).all()


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes):
    """Levels from the leaves to the single node on top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _others(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, source, n: _h([field(i), field(source), field(lang), field(n), field(t)])
    trees = defaultdict(list)
    for i, t, lang, source, n, *_ in rows:
        forged = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None
        trees[lang].append(((i is not None, i or 0), leaf(i, t, lang, source, n), leaf(i, lower(t) if forged else t, lang, source, n), i))
    names = sorted(trees, key=lambda x: b"" if x is None else b"+" + x.encode())
    grown = {k: _climb([x[1] for x in sorted(v)]) for k, v in trees.items()}
    table = _climb([grown[k][-1][0] for k in names])
    out = []
    for k in names:
        for at, (_, own, forged, i) in enumerate(sorted(trees[k])):
            sides = _others(grown[k], at) + _others(table, names.index(k))
            folded = forged
            for left, right in sides:
                folded = _h([*left, folded, *right])
            out.append((i, own, grown[k][-1][0], table[-1][0], _h([x for s in sides for part in s for x in part]), folded, folded == table[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, docs, rows, levels):
    """Every column; blocks of one level need several rounds of block roots."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    more = [(1000 + i, f"Text {i}", "en" if i % 50 else f"l{i}", None, i, *rows[0][5:]) for i in range(700)]
    df = docs.union(spark.createDataFrame(more, SCHEMA))
    got = merkle.Manifest(df, Scratch(spark, "t"), levels).checked().select(names).collect()
    want = _manifest([*rows, *more])
    assert Counter(tuple(g) for g in got) == Counter(want)
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_odd_tables(spark):
    ddl = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string"
    assert merkle.Manifest(spark.createDataFrame([], ddl), Scratch(spark, "t")).checked().count() == 0
    for few in ([(None, None, None, None, None)], [(3, "s", "en", 1, "A")], [(3, "s", "en", 1, "A")] * 20):
        df = spark.createDataFrame([(*x, "mine", "mine") for x in few], ddl)
        m = merkle.Manifest(df, Scratch(spark, "t"))
        got = m.checked().collect()
        for x in m.proofs().collect():
            assert merkle.fold(bytes(x.leaf), bytes(x.witness)) == bytes(x.root)
        want = _manifest([(i, t, lang, source, n) for i, source, lang, n, t in few])
        assert Counter(tuple(g) for g in got) == Counter(want)


def test_witnesses_grow_with_appends():
    for n in (*range(1, 20), 63, 64, 65, 512, 513, 700):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        levels = _climb([x.hex() for x in leaves])
        w = merkle.Witnesses()
        for x in leaves:
            w.append(x)
        root = w.finish()
        assert root.hex() == levels[-1][0]
        for i, proof in enumerate(w.proofs()):
            sides = [(x[:p], x[p:]) for p, x in merkle.steps(proof)]
            assert [([y.hex() for y in a], [y.hex() for y in b]) for a, b in sides] == _others(levels, i)
            assert merkle.fold(leaves[i], proof) == root
            if n > 1:
                assert merkle.fold(leaves[i - 1], proof) != root or n == 1


def test_word_bounds_are_those_of_the_pattern():
    """OP10: starts and ends of words in one pass over the bytes, not one match object for each word."""
    deal = random.Random(3)
    texts = [b"", b" ", b"a", b"\x00a\x1c \x85b", "ä\u00a0ö\u2003x\ty\r\n".encode(), *(bytes(deal.choices(b"ab\xc3\xa4 \t\n\x0b\x0c\r\x0e\x08", k=deal.randrange(60))) for _ in range(300))]
    for t in texts:
        assert tokens.word_bounds(t).tolist() == [list(m.span()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]


def test_states_advance_from_tables_of_words():
    """OP4: one table gives what a word and its class give to a step, so scores equal those of single steps over both."""
    p, r = lmscore.LmParams(hidden=6, clusters=4, classed=20), np.random.default_rng(2)
    g = lmscore.Gru(p)
    g.set_words(np.concatenate([np.arange(20) % 4, 4 + np.arange(lmscore.FORMS + 1)]), np.arange(30, 10, -1), p)
    g.w["e"][:] = r.normal(0, 0.3, g.w["e"].shape)
    table = np.hstack(g.inputs())
    assert np.allclose(table[:-1], g.w["x"][g.class_of] + g.w["e"][:-1]) and np.allclose(table[-1], g.w["x"][-1] + g.w["e"][-1])
    seqs = [r.integers(0, 29, n).astype(lmscore.SEQ) for n in (1, 90, 7)]
    for s, got in zip(seqs, g.score([g.class_of[s].astype(np.uint8) for s in seqs], index=seqs)):
        h, x, word, total = np.zeros((1, 6), np.float32), p.classes, len(table) - 1, 0.0
        for k in s:
            h = g.step(np.array([x]), h, np.array([word]))[0]
            total += g.log_probs(h, g.class_of[[k]])[0] + (g.inside(h, np.array([k]))[0] if k < 20 else 0)
            x, word = g.class_of[k], k
        assert abs(total - got) < 1e-3
