"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import exactdup, langid, lmscore, neardup, packing, pieces, quality, sharding, suffixdup, warc
from loamgrid.plans.session import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, line string, keep_id long, component string"


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [[word(r) for _ in range(r.randint(60, 160))] for _ in range(12)]
    passage = " ".join(word(r) for _ in range(70))
    texts = [" ".join(b) for b in base]
    for b in base[:4]:  # near copies
        for _ in range(6):
            c = list(b)
            c[r.randrange(len(c))] = word(r)
            texts.append(" ".join(c))
    texts += [texts[0]] * 8 + [texts[1].upper()]  # exact copies, but for case
    texts += [" ".join(word(r) for _ in range(20)) + "\n" + passage + "\n" + " ".join(word(r) for _ in range(30)) for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "Ünï çode 12 #*$", "a b c d e " * 40, " ".join(word(r) for _ in range(9000)), "ÉCLAIR x", "éclair x"]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(t or ""), 1, "x", 2, "y") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id here " + texts[3], "en", "s0", 1, 1, "x", 2, "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())


def test_exact_duplicates(docs, rows, empty):
    got = exactdup.exact_duplicates(docs, keep="largest").collect()
    lower = lambda t: (t or "").translate(str.maketrans(exactdup._UPPER, exactdup._LOWER))
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    assert len(got) == len(rows)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((r[0], best[lower(r[1])], len(groups[lower(r[1])])) for r in rows)
    assert Counter((g.doc_id, g.keep_id, g.group_size) for g in got) == want
    assert exactdup.exact_duplicates(empty).count() == 0
    kept = exactdup.keep_one(docs).filter("doc_id is not null")
    assert kept.select("doc_id").distinct().count() == len({v for v in best.values() if v is not None}) and kept.columns == docs.columns


def test_keep_one_keeps_one_row(spark, docs, rows):
    lower = lambda t: (t or "").translate(str.maketrans(exactdup._UPPER, exactdup._LOWER))
    assert exactdup.keep_one(docs).count() == len({lower(r[1]) for r in rows})
    few = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (8, "d")]
    got = exactdup.keep_one(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert Counter((g.doc_id, g.text.lower()) for g in got) == Counter([(1, "a"), (None, "b"), (7, "c"), (8, "d")])


def test_near_duplicates(docs, rows, empty):
    for width in (4, 5):
        got = {g.doc_id: g for g in neardup.near_duplicates(docs, neardup.SketchParams(width=width)).collect() if g.doc_id is not None}
        sets = {}
        for r in rows:
            w = words(r[1])
            if r[0] is not None:
                sets[r[0]] = set(zip(*[w[j:] for j in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
        ids = sorted(sets)
        up = {i: i for i in ids}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
        assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in ids} == {i: (len(sets[i]), top(i), top(i) == i) for i in ids}
    assert neardup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    p, r = neardup.SketchParams(), np.random.default_rng(1)
    u = r.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.unique(u[:1000]), np.unique(u[100:])
    k = neardup.registers([a, b, np.union1d(a, b)], p)
    assert (neardup.merge_registers(k[0], k[1]) == k[2]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.estimate_jaccard(k[:1], k[1:2], np.array([float(len(a))]), np.array([float(len(b))]), p)[0] - true) < 0.1


def test_quality(docs, rows, empty):
    got = {(g.doc_id, g.n_words, g.word_chars): g for g in quality.quality_rules(docs).collect()}
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        g = got[(r[0], len(w), sum(map(len, w)))]
        assert (g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert g.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    assert quality.quality_rules(empty).count() == 0


def test_frequent_lines_go(spark):
    r = random.Random(4)
    line = "subscribe to our newsletter today and never miss a single thing"
    rows = [(i, " ".join(word(r) for _ in range(40)) + "\n" + line, "h") for i in range(60)] + [(60 + i, line + "\n" + word(r), "h") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = {x.doc_id: x.kept for x in quality.quality_rules(docs).collect()}
    assert all(v[i] for i in range(60)) and not any(v[i] for i in range(60, 63))
    out = quality.clean_documents(docs).collect()
    assert len(out) == 60 and not any(line in x.text for x in out)
    copies = spark.createDataFrame([(i, rows[0][1], "h") for i in range(50)], docs.schema)  # copies of one text are no boilerplate
    assert quality.clean_documents(copies).count() == 50


def test_lines_of_rejected_documents_count(spark):
    r = random.Random(5)
    line = "all rights reserved"
    rows = [(i, f"{word(r)} {i}x\n{line}", "h") for i in range(30)] + [(30 + i, " ".join(word(r) for _ in range(40)) + "\n" + line, "h") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    assert all(got[i].base_failed and not got[i].kept for i in range(30))
    assert all(got[i].kept and got[i].words_lost == 3 for i in range(30, 35))  # the line is in 35 documents, in 5 that pass
    assert not any(line in x.text for x in quality.clean_documents(docs).collect())


def test_repeated_spans(docs, rows, empty, spark):
    got = suffixdup.repeated_spans(docs).collect()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    at = defaultdict(list)
    for i, t in text.items():
        w = words(t)
        for k in range(len(w) - 49):
            at[tuple(w[k : k + 50])].append((i, k))
    want = defaultdict(set)
    for v in at.values():
        if len({i for i, _ in v}) > 1:
            for i, k in v:
                want[(i, (i, k) != min(v))].update(range(k, k + 50))
    have = defaultdict(set)
    for g in got:
        have[(g.doc_id, g.is_repeat)].update(range(g.start_word, g.end_word))
        assert words(text[g.doc_id][g.start_char : g.end_char]) == words(text[g.doc_id])[g.start_word : g.end_word]
    assert have == want
    out = suffixdup.without_repeats(docs)
    assert out.count() == len(rows) and out.columns == docs.columns
    assert suffixdup.repeated_spans(empty).count() == 0


def test_packing(docs, rows, empty, spark):
    from tokenizers import Tokenizer

    p = packing.default_params()
    layout = packing.pack_documents(docs, p)
    got = layout.toPandas()
    tok = Tokenizer.from_file(p.tokenizer)
    ids = {(r[0], len(e.ids)): [*e.ids, 1] for r, e in zip(rows, tok.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}
    assert got["length"].sum() == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    crcs = Counter((i, s, zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes())) for (i, _), x in ids.items() for s in range(0, len(x), 4096))
    assert set(crcs) == {(None if x.doc_id != x.doc_id else int(x.doc_id), x.start, x.ids_crc32) for x in got.itertuples()}
    q = got.sort_values(["sequence_id", "offset"])
    assert (q["offset"] == q.groupby("sequence_id")["length"].cumsum() - q["length"]).all()
    assert q.groupby("sequence_id")["length"].sum().max() <= 4096 and q["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 4096) + 1
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    seqs = packing.token_sequences(unique, packing.pack_documents(unique, p), p).collect()
    assert all(len(s.ids) <= 4096 for s in seqs)
    assert packing.pack_documents(empty, p).count() == 0


def test_packing_is_near_the_bound():
    r = np.random.default_rng(2)
    hist = np.bincount(np.clip(r.lognormal(6.5, 1.0, 200_000).astype(int) + 1, 1, 4096), minlength=4097)
    p = packing.PackParams("")
    groups = packing.plan_sequences(hist, p)
    used = np.zeros(4097, int)
    for n, items in groups:
        for length, _ in items:
            used[length] += n
    assert (used == hist).all()
    assert sum(n for n, _ in groups) <= 1.002 * (hist * np.arange(4097)).sum() / 4096 + 1


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    path = packing.default_params().tokenizer
    texts = ["It's OK, don't.", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "Ünï, ab1. 3.14!! 中文。 é.", " x y.", "İI ΣΑΣ. 'll's", "", "!!", "...a"]
    enc = packing.WordEncoder(path)
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert list(ids) == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, t


def test_sentencepiece(docs, rows, empty):
    import sentencepiece

    path = pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.encode_documents(docs, path)
    got = enc.collect()
    assert Counter((g.doc_id, tuple(g.ids)) for g in got) == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in rows)
    assert all(g.parity and g.round_trip for g in got)
    back = Counter((g.doc_id, g.text) for g in pieces.decode_documents(enc, path).collect())
    assert back == Counter((r[0], r[1] or "") for r in rows)
    assert pieces.encode_documents(empty, path).count() == 0
    codec = pieces.codec(path)
    for t in ["  two  spaces ", "a b\nc", "😀 x", " ", "tab\t\tq"]:
        assert list(codec.encode([t])[0][0]) == sp.encode(t), t


def test_langid(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(real, langid.fold(4, 2)).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(g.lang_pred == g.lang for g in got) / len(got) > 0.9 and all(0 <= g.score <= 1 for g in got)
    odd = {g.doc_id: g for g in langid.identify(docs, langid.fold(4, 2)).collect()}
    blank = [r.doc_id for r in docs.filter(r"text is null or not text rlike '\\p{L}'").collect()]
    assert blank and all(odd[i].lang_pred == "und" for i in blank)
    assert langid.identify(empty, langid.fold(4, 2)).count() == 0
    assert {g.lang_pred for g in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), langid.fold(4, 2)).collect()} == {"und"}


def test_lm(docs, rows, empty):
    p = lmscore.LmParams(head=200, classed=100, clusters=8)  # most words travel through the join
    got = lmscore.score_documents(docs, langid.fold(7, 2), p).collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r[0]) for w in [*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = [*words(r[1]), None]
        want[(r[0], out(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5))] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got) == want
    assert all(g.score <= 0 for g in got)
    assert lmscore.score_documents(empty, langid.fold(7, 2), p).count() == 0


def test_lm_state_is_carried():
    p = lmscore.LmParams(hidden=8, clusters=4)
    g, r = lmscore.Gru(p), np.random.default_rng(0)
    seqs = [r.integers(0, p.classes, n).astype(np.uint8) for n in (3, 200, 1, 77)]
    for s, x in zip(seqs, g.score(seqs, window=16)):
        h, last, total = np.zeros((1, 8), np.float32), p.classes, 0.0
        for y in s:
            h = g.step(np.array([last]), h)[0]
            total += g.log_probs(h, np.array([y]))[0]
            last = y
        assert abs(total - x) < 1e-3


def test_lm_learns_from_all_rows(spark, docs, empty):
    s, p = Scratch(spark, "t"), lmscore.LmParams(head=200, classed=100, clusters=8, chunk=3000)
    one = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # More rows than any sample of documents held.
    model, _ = lmscore.train(one.union(spark.range(9000).selectExpr("id", "cast('many small rows' as binary)")), s, p)
    assert model.learned_tokens == model.train_tokens > 36_000
    assert lmscore.train(one.limit(0), s, p)[0].learned_tokens == 0


def test_lm_words_of_a_class_follow_the_state():
    p = lmscore.LmParams(classed=6, clusters=2, hidden=4, lanes=4, window=8)
    g, r = lmscore.Gru(p), np.random.default_rng(0)
    g.set_words(np.array([0, 0, 0, 0, 1, 1, *(2 + np.arange(lmscore.FORMS + 1))]), np.array([5, 4, 3, 2, 2, 1]), p)
    # 4 calls for 0 and 6, a form, for 1; both answers are of class 0.
    seq = np.concatenate([[4, 0] if r.random() < 0.5 else [6, 1] for _ in range(3000)]).astype(lmscore.SEQ)
    static = g.score([g.class_of[seq].astype(np.uint8)], index=[seq])[0]
    for _ in range(4):
        g.learn(*lmscore._streams([seq], p.lanes, r), p, 0.02)
    hs = r.normal(0, 1, (3, 4)).astype(np.float32)
    total = sum(np.exp(g.inside(hs, np.full(3, w))) for w in range(4))
    assert np.allclose(total, 1, atol=1e-5) and (g.inside(hs, np.full(3, 9)) == 0).all()
    plain = g.score([g.class_of[seq].astype(np.uint8)])[0]
    both = g.score([g.class_of[seq].astype(np.uint8)], index=[seq])[0]
    assert both > static and (plain - both) / 3000 < 0.2  # counts alone: 0.69 and more a word of class 0


def test_warc(spark):
    big = "<p>" + "x" * 1500
    rows = [(1, "http://a/ b\r\nX: y", big, 1), (2, None, big, 1), (9, "http://c", big, 1), (3, "u", "ü" * 10, 1), (4, "u", "ü" * 10, 1), (5, "u", None, 1), (None, "n", big, 1)]
    s = Scratch(spark, "t")
    root = s.path("archives")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    index = warc.write_archives(pages, s, root)
    got = {r.page_id: r for r in warc.read_records(index, root).collect()}
    assert got[9].record_type == "response" and bytes(got[9].payload).decode() == big
    assert [(got[i].record_type, got[i].refers_to, got[i].payload_bytes, got[i].payload_digest == got[9].payload_digest) for i in (1, 2, None)] == [("revisit", 9, 1503, True)] * 3
    assert [got[i].record_type for i in (3, 4, 5)] == ["response"] * 3 and got[3].payload_bytes == 20 and got[5].payload_bytes == 0
    some = warc.read_records(index.filter("page_id in (3, 5)"), root).collect()
    assert len(some) == 2
    assert warc.read_records(warc.write_archives(pages.limit(0), s, root), root).count() == 0


def test_shards(spark, docs):
    store = sharding.ShardStore(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), target=60_000, base=2_000, fan_in=3)
    for _ in range(3):
        store.append(docs.repartition(9))
    before = store.manifest().count()
    v = store.compact_all()
    m = store.manifest().toPandas()
    assert len(m) < before and m["rows"].sum() == 3 * docs.count() and store.read().columns == docs.columns
    assert store.read().groupBy("doc_id", "text").count().exceptAll(docs.union(docs).union(docs).groupBy("doc_id", "text").count()).count() == 0
    assert store.read(1).count() == docs.count()  # old versions stay readable until vacuum
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), v - 1)
    assert store.vacuum() > 0 and store.read().count() == 3 * docs.count()


def test_many_tiny_shards_lose_no_row(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RUN", 4)
    monkeypatch.setattr(sharding, "MAX_MERGES", 1)
    store = sharding.ShardStore(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), fan_in=3)
    store.append(docs.repartition(9))
    rows, shards = docs.count(), store.manifest().count()
    store.compact()
    assert store.manifest().count() == shards - 3 and store.read().count() == rows
    store.compact_all()
    assert store.read().exceptAll(docs).count() == 0 and store.read().count() == rows


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        out = Scratch(spark, "t").finish(out)
        assert out.join(d, "doc_id", "left_anti").count() == 0 and out.count() <= d.count()
        d = out
    packed = cp.run(spark, sf).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in d.select("doc_id").collect()}


def test_line_keys_and_hosts(spark):
    """Space at the ends of a line does not tell lines apart; a null host is none of the named ones."""
    r = random.Random(8)
    body = lambda: " ".join(word(r) for _ in range(30))
    ends = ["", "\t", "  ", "\r", " \r"]
    rows = [(i, f"{body()}\n{ends[i % 5]}All  rights\treserved{ends[i % 4]}", "h", "c", 1) for i in range(36)]
    rows += [(100 + i, f"{body()}\nonly here", None, "c", 1) for i in range(15)] + [(200 + i, f"{body()}\nonly here", "\x00", "c", 1) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _c string, `lost.line` int")
    got = {x.doc_id: x.words_lost for x in quality.quality_rules(docs).collect()}
    assert all(got[i] == 3 for i in range(36)) and not any(got[i] for i in got if i >= 100)
    out = quality.clean_documents(docs)
    assert out.columns == docs.columns and {x._c for x in out.collect()} == {"c"} and out.count() == len(rows)


def test_quality_verdict_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("one").alias("source"))
    docs = docs.union(docs.filter("doc_id < 90").select(F.col("doc_id") + 10_000, F.concat("text", F.lit("\nsee  page 12 of 40")), "source"))
    docs = docs.union(docs.filter("doc_id < 3"))
    rows = docs.distinct().collect()
    split = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    key = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    held, texts = Counter(), defaultdict(set)
    for x in rows:
        for k in {key(y) for y in split(x.text)}:
            held[k] += 1
            texts[k].add(x.text)
    bad = {k for k, n in held.items() if n > quality.MIN_DOCS and n > len(rows) * quality.MIN_SHARE and len(texts[k]) >= quality.MIN_TEXTS}
    assert "see page 0 of 0" in bad
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    want = {}
    for x in rows:
        lost = sum(count(y) for y in split(x.text) if key(y) in bad)
        want[x.doc_id, count(x.text or "")] = (lost, count(x.text or "") - lost >= count(x.text or "") * quality.MIN_LEFT)
    got = quality.quality_rules(docs).collect()
    assert len(got) == docs.count()
    assert all((g.words_lost, g.kept) == (want[g.doc_id, g.n_words][0], want[g.doc_id, g.n_words][1] and not g.base_failed) for g in got)


def test_merged_runs_hold_a_digest_once(spark):
    """Every round leaves sorted runs without repeats, whatever the fan-in, and the winner of each digest."""
    r = random.Random(9)
    rows = [(i, f"t{min(r.randrange(400), r.randrange(400))}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for fan_in, levels, keep in ((2, 5, "smallest"), (4, 3, "largest"), (7, 1, "smallest")):
        got = exactdup.merge_runs(exactdup.digest_rows(docs), Scratch(spark, "t"), fan_in, levels, keep).collect()
        best = min if keep == "smallest" else max
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        assert Counter((g.keep_id, g.group_size) for g in got) == Counter((best(v), len(v)) for v in groups.values())


def test_keep_one_passes_any_column(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "A", 1, 2, 3), (2, "b", 4, 5, 6)], "doc_id long, text string, _t int, row int, `_own.id` int")
    out = exactdup.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(2, "A", 1, 2, 3), (2, "b", 4, 5, 6)]


def test_shards_of_odd_tables(spark, empty):
    """Clashing names, an empty table, columns that change, and a run that two large shards fill."""
    where = lambda: "file://" + tempfile.mkdtemp(prefix="spark-")
    odd = spark.range(300).selectExpr("id doc_id", "'t' text", "'p' _path", "'p' path", "7 merge", "8 `row`", "9 `a.b`", "'m' _metadata", "1 generation")
    store = sharding.ShardStore(spark, where(), fan_in=2)
    store.append(odd.repartition(5))
    store.compact_all()
    assert store.manifest().count() == 1 and store.read().columns == odd.columns
    assert store.read().exceptAll(odd).count() == 0 and store.read().count() == 300
    with pytest.raises(ValueError):
        store.append(odd.drop("merge"))
    none = sharding.ShardStore(spark, where())
    assert none.append(empty) == 1 and none.compact_all() == 1 and none.vacuum() >= 0
    assert none.read().count() == 0 and none.read().columns == empty.columns
    large = sharding.ShardStore(spark, where(), fan_in=9)
    long = spark.range(40).selectExpr("id doc_id", "repeat(sha2(string(id), 512), 200) text")
    large.append(long.repartition(2))
    large.target = large.manifest().agg(F.sum("bytes")).first()[0] * 11 // 10
    large.compact_all()
    assert large.manifest().count() == 1 and large.read().count() == 40


def test_one_of_two_writers_wins(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    one, two = (sharding.ShardStore(spark, root) for _ in range(2))
    base = one.append(spark.range(5).withColumnRenamed("id", "doc_id"))
    plan = two.manifest(base)  # read before the other writer commits
    one.append(spark.range(5, 9).withColumnRenamed("id", "doc_id"))
    with pytest.raises(RuntimeError):
        two.commit(plan, base)
    assert one.version() == base + 1 and two.read().count() == 9


def test_warc_ranges_and_archives(spark, monkeypatch):
    """Several archives, several ranges in one, gaps, a long payload, and links from revisits to their response."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(warc, "GAP_BYTES", 500)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    r = random.Random(6)
    body = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz <>") for _ in range(n))
    rows = [(i, f"http://h/{i}", body(r.choice([50, 2000, 4000]))) for i in range(120)] + [(500, "http://long", body(3_000_000))]
    rows += [(600 + i, f"http://copy/{i}", rows[1][2] + "y" * 1000) for i in range(3)]
    s = Scratch(spark, "t")
    root = s.path("archives")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), s, root)
    assert index.select("file").distinct().count() > 2
    some = index.filter("page_id % 7 = 0 or page_id >= 500")
    ranges = warc.read_ranges(some).collect()
    assert len(ranges) > index.select("file").distinct().count() and sum(len(x.records) for x in ranges) == some.count()
    for x in ranges:
        ends = [y.offset + y.length for y in x.records]
        assert x.start == x.records[0].offset and x.stop == ends[-1]
        assert all(b.offset - a <= 500 for a, b in zip(ends, x.records[1:]))
    got = {x.page_id: bytes(x.payload).decode() for x in warc.read_records(some, root).collect()}
    html = {i: h for i, _, h in rows}
    assert set(got) == {x.page_id for x in some.collect()} and all(v == html[i] for i, v in got.items() if i not in (600, 601))
    one, two = warc.record_bytes(602, "http://copy/2", html[602].encode(), "d", None, False), warc.record_bytes(600, "u", b"", "d", 602, True, "http://copy/2")
    first, again = warc.parse_record(one)[0], warc.parse_record(two)[0]
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"]


def test_repeats_that_no_head_holds(spark):
    """Passages shared by pairs only, repeats within a document, and ids that repeat, against all windows."""
    r = random.Random(12)
    w = lambda n: [word(r) + word(r) for _ in range(n)]
    core, ctx = w(40), [w(30) for _ in range(6)]
    texts = []
    for _ in range(40):  # one core in many contexts, of which two documents share some words on each side
        a, b = r.choice(ctx), r.choice(ctx)
        texts.append(w(25) + a[r.randrange(30) :] + core + b[: r.randrange(30)] + w(25))
    long = w(300)
    texts += [long[:180] + w(9) + long[100:], long[60:220] + w(40), w(30) + long[90:260] + long[90:200]]
    own = w(70)
    texts += [own + w(20) + own, w(5) + own + own[:60] + w(10), [*own[:55]]]
    alone = w(60)
    texts.append(alone + w(10) + alone)
    rows = [(i % 44, " ".join(t), i) for i, t in enumerate(texts)] + [(3, " ".join(texts[3]), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts int").repartition(4)
    got = suffixdup.repeated_spans(docs).collect()
    key = {x.text: (x.doc_id, x.h) for x in docs.select("text", "doc_id", F.hash(F.col("text").cast("binary")).alias("h")).collect()}
    at = defaultdict(list)
    for t, i in key.items():
        v = t.split()
        for k in range(len(v) - 49):
            at[tuple(v[k : k + 50])].append((*i, k))
    want = defaultdict(set)
    for v in at.values():
        if len({x[:2] for x in v}) > 1:
            for x in v:
                want[x[:2], x != min(v)].update(range(x[2], x[2] + 50))
    name = {(x.doc_id, x.k): (x.doc_id, x.h) for x in docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("k"), F.hash(F.col("text").cast("binary")).alias("h")).collect()}
    have = defaultdict(set)
    for g in got:
        have[name[g.doc_id, g.text_key], g.is_repeat].update(range(g.start_word, g.end_word))
    assert len(want) > 40 and have == want
    out = suffixdup.without_repeats(docs).collect()
    assert len(out) == len(rows)
    for x in out:  # each text without exactly the words of its own repeats
        t = texts[x.cuts]
        gone = want[key[" ".join(t)], True]
        assert x.text.split() == [y for k, y in enumerate(t) if k not in gone]


def test_ids_that_repeat_stay_apart(spark):
    """Two texts with one id are two documents, of which one may leave and the other stay."""
    r = random.Random(10)
    w = lambda n: [word(r) for _ in range(n)]
    a, b, c = w(90), w(90), w(90)
    near = lambda x: " ".join([*x[:45], "changed", *x[46:]])
    rows = [(1, " ".join(a), 0), (5, near(a), 0), (5, " ".join(b), 0), (7, near(b), 0), (7, " ".join(c), 0), (None, " ".join(c), 0), (8, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = Counter((g.doc_id, g.component_id, g.kept) for g in neardup.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (7, 7, True), (None, None, True), (8, 8, True)])
    out = neardup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter((i, t) for i, t, _ in (rows[0], rows[2], rows[4], rows[5], rows[6]))


def test_near_duplicates_cost_no_square(spark):
    """Many edited copies of one text, many documents around one passage, and all pairs of a real table."""
    r = random.Random(11)
    w = lambda n: [word(r) + word(r) for _ in range(n)]
    base, passage, rows = w(150), w(60), []
    for i in range(400):
        c = list(base)
        for _ in range(r.randrange(6)):
            c[r.randrange(150)] = word(r)
        rows.append((i, " ".join(c)))
    rows += [(1000 + i, " ".join([*w(30), *passage, *w(30)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 10000", "text"))
    counts, plain = [], neardup._across

    def counted(*args):
        out = plain(*args)
        counts.append(out.count())
        return out

    neardup._across = counted
    try:
        got = {g.doc_id: (g.n_shingles, g.component_id) for g in neardup.near_duplicates(docs).collect()}
    finally:
        neardup._across = plain
    assert counts[0] < 2000  # of 80,000 pairs of copies and 45,000 around the passage
    texts = {x.doc_id: words(x.text) for x in docs.collect()}
    sets = {i: set(zip(*[v[j:] for j in range(4)])) if len(v) > 3 else ({tuple(v)} if v else set()) for i, v in texts.items()}
    holders = defaultdict(list)
    for i, x in sets.items():
        for y in x:
            holders[y].append(i)
    common = Counter()
    for v in holders.values():
        common.update((a, b) for k, a in enumerate(v) for b in v[k + 1 :])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert got == {i: (len(sets[i]), top(i)) for i in sets}


def test_stages_on_odd_rows(spark, docs, empty):
    """Every stage on nulls, empty and long texts, repeats and clashing columns: rows and columns stay whole."""
    import corpus_pipeline as cp

    odd = docs.withColumns({c: F.lit("mine") for c in ("row", "id", "cuts", "lost", "part", "_id", "text_key")})
    d = odd
    for name, stage in cp.STAGES[:-1]:
        out = Scratch(spark, "t").finish(stage(spark, d, ""))
        assert out.columns == odd.columns and out.count() <= d.count(), name
        assert out.filter("row <> 'mine' or cuts <> 'mine'").count() == 0
        assert stage(spark, empty, "").count() == 0
        d = out
    packed = cp.pack(spark, d, "").select("doc_id").distinct()
    assert packed.count() == d.select("doc_id").distinct().count()


def test_lm_beats_its_base_on_held_out_documents(spark):
    """The score of each document is that of a plain run over its words, one at a time, and better than its base where held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    p = lmscore.LmParams(rounds=2, lanes=64, rate=0.01)
    got = lmscore.score_documents(docs, langid.fold(7, 2), p).collect()
    held = [g for g in got if g.held_out]
    assert len(held) > 100 and sum(g.score for g in held) > 1.02 * sum(g.base_score for g in held)  # both are below zero

    g, r = lmscore.Gru(p), np.random.default_rng(4)
    present = 40
    n = np.sort(r.integers(1, 99, present))[::-1]
    class_of = lmscore.cluster_words(r.random((p.classed + lmscore.FORMS + 1) * 2 * lmscore._contexts(p)[1]), p, present)
    g.set_words(class_of, n, p)
    for k in ("e", "v", "c"):
        g.w[k] += r.normal(0, 0.3, g.w[k].shape).astype(np.float32)
    own = [*range(present), *range(p.classed, p.classed + lmscore.FORMS + 1)]
    seqs = [r.choice(own, m).astype(lmscore.SEQ) for m in (1, 70, 300)]
    for s, x in zip(seqs, g.score([class_of[s].astype(np.uint8) for s in seqs], window=16, index=seqs)):
        h, last, word, total = np.zeros((1, p.hidden), np.float32), p.classes, p.classed + lmscore.FORMS + 1, 0.0
        for i in s.astype(int):
            h = g.step(np.array([last]), h, np.array([word]))[0]
            total += g.log_probs(h, class_of[[i]])[0]
            if i < present:
                same = [k for k in range(present) if class_of[k] == class_of[i]]
                z = h[0] @ g.w["v"][same].T + g.w["c"][same]
                total += h[0] @ g.w["v"][i] + g.w["c"][i] - np.log(np.exp(z).sum())
            last, word = class_of[i], i
        assert abs(total - x) < 1e-2


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that keeps case and joins words is not encoded word by word."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.BPE({"a": 0, "B": 1, " ": 2, "a B": 3, "a ": 4, "B ": 5, "b": 6}, [("a", " "), ("a ", "B")]))
    tok.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    path = str(tmp_path / "t.json")
    tok.save(path)
    enc = packing.WordEncoder(path)
    assert not enc.by_word and packing.WordEncoder(packing.default_params().tokenizer).by_word
    assert [list(x) for x in enc.encode([b"a B", None, b"B b|a"])] == [[3], [], tok.encode("B b|a").ids]


def _piece_model(pieces_, kind, byte_fallback, squeeze):
    """The bytes of a model file, put together by hand."""
    import struct

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    field = lambda n, v: varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v
    rows = [field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces_]
    trainer = field(3, kind) + field(35, int(byte_fallback))
    norm = field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1)
    return b"".join(rows) + field(2, trainer) + field(3, norm)


@pytest.mark.parametrize("byte_fallback,squeeze", [(True, False), (False, True), (True, True)])
def test_unigram_models(tmp_path, byte_fallback, squeeze):
    """Scores, unknown characters, bytes and blanks of a unigram model, against the sentencepiece library."""
    import sentencepiece

    r = random.Random(3)
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    rows += [(f"<0x{i:02X}>", -20.0, pieces.BYTE) for i in range(256)] if byte_fallback else []
    parts = {"▁", *"abcdefghij", *("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 4))) for _ in range(150))}
    parts |= {"▁" + x for x in list(parts) if x != "▁" and r.random() < 0.5}
    rows += [(x, -r.uniform(1, 12), pieces.NORMAL) for x in sorted(parts)]
    path = str(tmp_path / "u.model")
    with open(path, "wb") as f:
        f.write(_piece_model(rows, pieces.UNIGRAM, byte_fallback, squeeze))
    own, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    texts = [" ".join(word(r) for _ in range(r.randint(1, 30))) for _ in range(60)] + ["ab zü cd", "é", "", "a  b ", " j", "xyz q abc", "😀 hi"]
    ids, parity = codec.encode(texts)
    assert [x.tolist() for x in ids] == own.encode(texts) and all(parity)
    codec.known.clear()
    codec.tok = pieces.PieceModel(_piece_model([(p, -1.0 if k == pieces.NORMAL else s, k) for p, s, k in rows], pieces.UNIGRAM, byte_fallback, squeeze)).tokenizer()
    assert not all(codec.encode(texts)[1])  # a backend with other scores is found out


def test_user_pieces_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(_piece_model([("<unk>", 0.0, pieces.UNKNOWN), ("<x>", 0.0, pieces.USER)], pieces.UNIGRAM, False, True))


def test_langid_of_many_languages(spark):
    """More languages than full codes serve: spread codewords, and texts half of one language and half of another are ambiguous."""
    r = random.Random(21)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 7)) for _ in range(11)]
    text = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randint(3, 8))) for _ in range(n))
    rows = [(i, text(alphabets[i % 11], 40), f"l{i % 11}") for i in range(900)]
    mixed = [(10_000 + i, text(alphabets[i % 11], 20) + " " + text(alphabets[(i + 3) % 11], 20), None) for i in range(110)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    p = langid.LangParams()
    codes = langid.codewords(11, p)
    assert min((codes[i] != codes[j]).sum() for i in range(11) for j in range(i)) >= 3  # one wrong bit is corrected
    got = {x.doc_id: x for x in langid.identify(docs, langid.fold(4, 2)).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert len(held) > 150 and sum(got[i].lang_pred == f"l{i % 11}" for i in held) / len(held) > 0.97
    unsure = lambda ids: sum(got[i].ambiguous for i in ids) / len(ids)
    assert unsure([i for i, _, _ in mixed]) > 3 * unsure(held) and unsure(held) < 0.2
