"""Registered queries against their SQL twins, and plan and literal tests of single operators."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import answers, documents, extraction, retrieval
from loamgrid.plans import queries_documents, queries_evidence, queries_records, queries_semantics, queries_sources, queries_state, queries_usage
from loamgrid.plans.views import TABLES, view
from loamgrid.streaming import ops

SF = "/root/testdata/sf0.001"
ORACLES = {**queries_usage.O, **queries_documents.O, **queries_semantics.O, **queries_sources.O, **queries_state.O, **queries_evidence.O, **queries_records.O}
QUERIES = {**queries_usage.Q, **queries_documents.Q, **queries_semantics.Q, **queries_sources.Q, **queries_state.Q, **queries_evidence.Q, **queries_records.Q}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "None"
        if isinstance(x, (bool,)) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return repr(float(x))
        except (TypeError, ValueError):
            return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert cells(QUERIES[name](spark, SF).toPandas()) == cells(con.sql(ORACLES[name]).df())


def test_block_kernel_equals_native_form(spark):
    q, c, r = (view(spark, SF, n) for n in ("questions", "chunks", "role_labels"))
    cols = ["query_id", "chunk_id", "score", "rank"]
    assert cells(retrieval.vector_top_k(q, c, r).select(cols).toPandas()) == cells(retrieval.native_top_k(q, c, r).select(cols).toPandas())


def test_lsh_recall(spark):
    q, c, r = (view(spark, SF, n) for n in ("questions", "chunks", "role_labels"))
    exact, near = retrieval.native_top_k(q, c, r), retrieval.lsh_top_k(q, c, r)
    hit = exact.join(near, ["query_id", "chunk_id"]).count()
    assert hit / exact.count() >= 0.9


def test_lsh_pairs_are_no_rows(spark):
    q, c, r = (view(spark, SF, n) for n in ("questions", "chunks", "role_labels"))
    q = q.filter("query_id % 100 = 0")
    near = retrieval.lsh_top_k(q, c, r, tables=3)
    assert "explode" not in near._jdf.queryExecution().optimizedPlan().toString()  # of buckets
    planes, may, want = np.random.default_rng(3).normal(size=(64, 15)), r.toPandas().groupby("role").label.agg(set), []
    key = lambda e: (np.array(e, float) @ planes > 0).reshape(3, 5)
    at = [(x.chunk_id, x.access_label, np.array(x.embedding, float), key(x.embedding)) for x in c.collect()]
    for x in q.collect():
        e, mine = np.array(x.embedding, float), key(x.embedding)
        fit = sorted((-round(float(e @ v / np.sqrt((e @ e) * (v @ v))), 6), n) for n, label, v, own in at if label in may[x.role] and (own == mine).all(1).any())
        want += [(x.query_id, n, i + 1) for i, (_, n) in enumerate(fit[:10])]
    assert sorted((x.query_id, x.chunk_id, x["rank"]) for x in near.collect()) == sorted(want)


def test_access_filter_is_below_the_ranking(spark):
    q, c, r = (view(spark, SF, n) for n in ("questions", "chunks", "role_labels"))
    plan = retrieval.native_top_k(q, c, r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")


def test_markdown_fences_and_headings(spark):
    text = "# A\n\none\ntwo\n\n```\n# no\n\nx\n```\n\n## B\nlast"
    rows = documents.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block").collect()
    assert [(r.kind, r.level) for r in rows] == [("heading", 1), ("paragraph", None), ("paragraph", None), ("heading", 2), ("paragraph", None)]
    assert rows[2].text == "```\n# no\n\nx\n```"


def test_sections_inherit_labels(spark):
    text = "# Top\n\nAccess: hr\n\na\n\n## Sub\n\nb\n\n# Next\n\nc"
    rows = documents.sections(documents.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("block").collect()
    assert [(r.text, r.section_path, r.access_label) for r in rows] == [("Top", "Top", "hr"), ("a", "Top", "hr"), ("Sub", "Top > Sub", "hr"), ("b", "Top > Sub", "hr"), ("Next", "Next", "all"), ("c", "Next", "all")]


@pytest.mark.parametrize("raw,value", [("1,250.00 EUR", 1250.0), ("€ 1.250,00", 1250.0), ("12,345", 12345.0), ("12,34", 12.34), ("n/a", None), ("-5", -5.0)])
def test_numbers(spark, raw, value):
    assert spark.range(1).select(extraction.parse_number(F.lit(raw)).alias("x")).first().x == value


def test_rules_stop_from_left_to_right(spark):
    row = spark.createDataFrame([(None, 1.0)], "a double, b double")
    cols = {c: F.col(c) for c in "ab"}
    get = lambda r: row.select(extraction.compile_rule(r, cols).alias("x")).first().x
    assert get("a > 0 and b > 5") is None and get("b > 5 and a > 0") is False and get("b < 5 or a > 0") is True
    for bad in ("__import__('os')", "a.b", "[x for x in a]"):
        with pytest.raises(ValueError):
            extraction.compile_rule(bad, cols)


def test_quote_spans():
    assert answers.find_span("Third‑party  risk", "The *third-party* risk is low")[2] == "normalized"
    assert answers.find_span("the risk is lou", "Now the risk is low.")[2] == "fuzzy"
    assert answers.find_span("nothing like it", "12345 67890") is None


def test_deltas_hold_back_the_sentinel():
    a = ops.DeltaAssembly()
    assert a.feed("NO_ANS", False) == "" and a.feed("WER", True) == "" and a.refused
    b = ops.DeltaAssembly()
    out = "".join(b.feed(x, i == 2) for i, x in enumerate(["The answer is long enough to show [1].", "\nQUO", "TES\n[1] \"x\""]))
    assert out.rstrip() == "The answer is long enough to show [1]."


def test_token_bucket_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id as key", "event_id as id", "cast(unix_micros(cast(ts as timestamp)) / 1000000 as double) as at")
    assert cells(queries_documents.Q["t3_token_bucket"](spark, SF).toPandas()) == cells(ops.token_bucket_batch(events, 0.02).toPandas())


def test_fuzzy_quotes_reach_the_end():
    import random
    from difflib import SequenceMatcher

    from loamgrid.operators.answers import find_span

    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for off in range(40, 60):
        content = text(off + 40)
        quote = content[off : off + 10] + "0" + content[off + 11 : off + 28] + "1" + content[off + 29 :]  # two edits
        starts = range(0, max(1, len(content) - 20), 10)
        best = max(starts, key=lambda s: SequenceMatcher(None, content[s : s + 50], quote, autojunk=False).ratio())
        assert SequenceMatcher(None, content[best : best + 50], quote, autojunk=False).ratio() >= 0.75
        start, end, method = find_span(quote, content)
        assert method == "fuzzy" and best <= start <= off + 10 and end == len(content)
    # The edited first and last characters belong to the span.
    content = text(30) + "27 days are left of the notice period X9" + text(30)
    assert find_span("34 days are left of the notice period 55", content) == (30, 70, "fuzzy")


def _chunks_of(blocks, target, overlap, cap):
    """Chunks of (level, text) blocks by the rules, a block at a time, in plain Python."""
    import math
    import re

    n = lambda t: max(1, round(len(t.split()) * 1.3))
    marks = {"Access: HR only": "hr", "Access: Finance only": "finance", "Access: Everyone": "all"}
    secs, doc, stack, fresh = [], "all", [], False
    for level, text in blocks:
        if level:
            stack = [x for x in stack if x[0] < level]
            stack.append([level, text, stack[-1][2] if stack else doc])
            secs.append([" > ".join(x[1] for x in stack), stack[-1][2], [text]])
        else:
            if text in marks and (fresh or not stack):
                if stack:
                    stack[-1][2] = marks[text]
                else:
                    doc = marks[text]
                if secs:
                    secs[-1][1] = marks[text]
            if not secs:
                secs.append([None, doc, []])
            secs[-1][2].append(text)
        fresh = bool(level)
    out, held = [], []

    def flush():
        if held:
            out.append((held[0][0], held[0][1], "\n\n".join(t for h in held for t in h[2])))
            held.clear()

    total = lambda h: sum(n(t) for t in h[2])
    for sec in secs:
        if total(sec) <= target:
            if held and (held[0][1] != sec[1] or sum(map(total, held)) + total(sec) > target):
                flush()
            held.append(sec)
            continue
        flush()
        units = []
        for t in sec[2]:
            for x in re.split(r"(?<=[.!?…])\s+", t) if not t.startswith("|") else [t]:
                if t.startswith("|") and n(x) > cap:
                    rows, part = x.split("\n"), []
                    for row in rows[2:]:
                        if part and n("\n".join(rows[:2] + part + [row])) > cap:
                            units.append("\n".join(rows[:2] + part))
                            part = []
                        part.append(row)
                    units.append("\n".join(rows[:2] + part))
                elif n(x) > cap:
                    w, k = x.split(), int(cap / 1.3)
                    units += [" ".join(w[i * k : (i + 1) * k]) for i in range(math.ceil(len(w) / k))]
                else:
                    units.append(x)
        size, a = [n(u) for u in units], 0
        cuts = []
        for i in range(len(units)):
            if i > a and sum(size[a : i + 1]) > target:
                cuts.append((a, i))
                half = a + (i - a) // 2
                tails = [k for k in range(half, i + 1) if sum(size[k:i]) >= overlap]
                a = max(tails) if tails else half
                if sum(size[a : i + 1]) > cap:
                    a = i
        cuts.append((a, len(units)))
        out += [(sec[0], sec[1], "".join(f"\n\n{u}\n\n" if u.startswith("|") else u + " " for u in units[x:y]).strip()) for x, y in cuts]
    flush()
    return [(i, *x) for i, x in enumerate(out)]


def test_chunks_are_brute_force(spark):
    import random

    r = random.Random(2)
    sentence = lambda k: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(k)) + r.choice([".", "?", "…"])
    docs, rows = {}, []
    for d in range(60):
        blocks = []
        for b in range(r.randint(1, 25)):
            what = r.random()
            if what < 0.3:
                blocks.append((r.randint(1, 4), f"Heading {b}"))
                if r.random() < 0.4:
                    blocks.append((None, r.choice(["Access: HR only", "Access: Finance only", "Access: Everyone"])))
            elif what < 0.4:
                blocks.append((None, "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {sentence(3)} |" for i in range(r.choice([2, 30])))))
            else:
                blocks.append((None, " ".join(sentence(r.choice([2, 5, 9, 60])) for _ in range(r.randint(1, 9)))))
        docs[d] = blocks
        rows += [(d, i, lv, t) for i, (lv, t) in enumerate(blocks)]
    secs = documents.section_rows(spark.createDataFrame(rows, "doc_id long, block int, level int, text string"))
    got = {}
    for x in documents.chunk_sections(secs, 80, 12, 100).collect():
        got.setdefault(x.doc_id, []).append((x.chunk_index, x.section_path, x.access_label, x.content))
    for d, blocks in docs.items():
        assert sorted(got[d]) == _chunks_of(blocks, 80, 12, 100), d


def test_chunk_pages_and_empty_documents(spark):
    rows = [(1, 0, None, "one", 3), (1, 1, None, "two", 4), (2, 0, None, "no page", None)]
    got = documents.chunk_sections(documents.section_rows(spark.createDataFrame(rows, "doc_id long, block int, level int, text string, page int"))).orderBy("doc_id").collect()
    assert [(x.content, x.page_start, x.page_end) for x in got] == [("one\n\ntwo", 3, 4), ("no page", None, None)]
    assert documents.chunk_documents(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("marker", ["QUOTES:", "**QUOTES:**", "Quotes:", "QUOTES", ">## quotes :"])
def test_quotes_line_forms(spark, marker):
    a = ops.DeltaAssembly()
    shown = "".join(a.feed(x, False) for x in ["Answer [1].\n" + marker[:3], marker[3:] + "\n[1] \"x\""]) + a.feed("", True)
    assert shown.rstrip() == "Answer [1]."
    row = spark.range(1).select(answers.split_quotes(F.lit(f'Answer [1].\n{marker}\n[1] "x"')).alias("s")).first().s
    assert row.body == "Answer [1]." and row.quotes == '\n[1] "x"'


def test_fallback_spans(spark):
    text = "Cats sleep. Employees get 27 days of leave per year. It is 27 days for all employees; also part-time.\nNothing."
    get = lambda claim: [(x.start, x.end) for x in spark.range(1).select(answers.fallback_spans(F.lit(claim), F.lit(text)).alias("s")).first().s]
    (span,) = get("Employees have 27 days [3].")  # two neighbours that say the same, joined
    assert text[span[0] : span[1]] == "Employees get 27 days of leave per year. It is 27 days for all employees;"
    assert get("zebra [1]") == [] and get("[1] [2]") == []


def test_web_queries(spark):
    get = lambda t: [(x.grp, x.neg, " ".join(x.words)) for x in spark.range(1).select(retrieval.parse_query(F.lit(t)).alias("q")).first().q]
    assert get('Annual leave') == [(0, False, "annual"), (0, False, "leave")]
    assert get('"Annual leave" or sick -unpaid -"long term"') == [(0, False, "annual leave"), (1, False, "sick"), (1, True, "unpaid"), (1, True, "long term")]
    assert get("e-mail a a !!") == [(0, False, "e mail"), (0, False, "a")] and get("") == []


def test_full_text_sees_no_hidden_chunk(spark):
    q = spark.createDataFrame([(1, "employee", "red apple"), (2, "hr", "red apple"), (3, "hr", "-red"), (4, "hr", "apple -red")], "query_id long, role string, q string")
    posts = documents.postings(spark.createDataFrame([(7, "all", "red green apple"), (8, "hr", "red apple"), (9, "hr", "apple")], "chunk_id long, access_label string, text string"), "chunk_id", "access_label")
    roles = spark.createDataFrame([("employee", "all"), ("hr", "all"), ("hr", "hr")], "role string, label string")
    items = q.select("query_id", "role", retrieval.parse_query(F.col("q")).alias("items"))
    got = sorted((x.query_id, x.chunk_id, x.score) for x in retrieval.fulltext_top_k(items, posts, 10, roles).collect())
    assert got == [(1, 7, 0.5), (2, 7, 0.5), (2, 8, 1.0), (4, 9, 1.0)]


def test_ingest_replaces_documents(spark, tmp_path):
    from loamgrid.plans.session import Scratch
    from loamgrid.sources.sinks import ReplacedTable, export_csv, export_json

    t = ReplacedTable(spark, str(tmp_path / "t"), "doc_id")
    rows = lambda x: spark.createDataFrame(x, "doc_id long, c string")
    t.replace(0, rows([(1, ""), (2, "")]), rows([(1, "a"), (1, "b"), (2, "c")]))
    t.replace(1, rows([(1, ""), (2, "")]), rows([(1, "d")]))
    t.replace(1, rows([(1, ""), (2, "")]), rows([(1, "d")]))  # again, after a failure
    assert [(x.doc_id, x.c) for x in t.read().collect()] == [(1, "d")]
    wide = spark.createDataFrame([(1, 'a "b", c', ["x", "y"]), (2, None, None)], "id long, t string, l array<string>")
    export_csv(wide, str(tmp_path / "csv"))
    export_json(wide, str(tmp_path / "json"))
    back = {x.id: (x.t, x.l) for x in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).withColumn("id", F.col("id").cast("long")).collect()}
    assert back == {1: ('a "b", c', "x; y"), 2: (None, None)}
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    docs = [spark.createDataFrame([(1, "old text"), (2, "stays")], "doc_id long, text string"), spark.createDataFrame([(1, "new text")], "doc_id long, text string")]
    for n, df in enumerate(docs):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part{n}"))
    src = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {x.doc_id: x.content for x in ops.incremental_ingest(src, Scratch(spark, "t")).collect()}
    assert got == {1: "new text", 2: "stays"}


def test_budget_stream_equals_batch(spark):
    from loamgrid.operators.usage import admission_replay

    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id as reservation_id", "to_date(ts) as day", "user_id % 9 as ip_digest", "ts", "cast(value as decimal(18,8)) as amount")
    stream = queries_documents.Q["t5_budget_admission"](spark, SF).toPandas().rename(columns={"id": "reservation_id"})
    assert cells(stream) == cells(admission_replay(e, 200.0).toPandas())
    assert 0 < stream["admitted"].sum() < len(stream)


def test_context_keeps_whole_documents_within_the_large_budget(spark):
    rows = [(1, i, 100, float(i)) for i in range(6)] + [(2, 0, 50, 0.0), (2, 1, 400, 9.0), (2, 2, 120, 5.0), (2, 3, 100, 7.0), (2, 4, 30, 1.0)]
    x = spark.createDataFrame(rows, "document_id long, chunk_index int, token_count int, score double")
    got = {}
    for r in extraction.select_context(x, 300, 600).collect():
        got.setdefault(r.document_id, []).append(r.chunk_index)
    assert got[1] == list(range(6)) and got[2] == [0, 2, 3, 4]  # 700 tokens: the best chunk is too large and passed over


def test_heading_levels(spark):
    get = lambda z: {x.size: x.level for x in spark.range(1).select(documents.heading_levels(F.array(*map(F.lit, z))).alias("x")).first().x}
    assert get([20.0, 19.0, 18.0, 14.0, 10.0, 6.0]) == {20.0: 1, 19.0: 1, 18.0: 2, 14.0: 3, 10.0: 3, 6.0: 3}


def test_scope_meets_circles_once(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("d", "d")], "id string, parent string")
    assert sorted(r.id for r in documents.scope_closure(nodes, spark.createDataFrame([("a",), ("x",)], "id string")).collect()) == ["a", "b", "c", "x", "y"]
