"""Queries on documents that no given table has, against their SQL: one test for each finding."""

import os
import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loamgrid.operators import answers, documents

SF = Path("/root/testdata/sf0.001")


def _lines(n):
    return "\n".join(f"Line {k} of a text, with some words." for k in range(n))


@pytest.fixture
def odd(tmp_path):
    """The given tables with ``texts`` as the documents, and a connection that reads them."""

    def make(*texts):
        for f in SF.glob("*.parquet"):
            if f.name != "documents.parquet" and not (tmp_path / f.name).exists():
                os.symlink(f, tmp_path / f.name)
        con = duckdb.connect()
        con.execute("CREATE TABLE x (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO x VALUES (?, ?, 'en', 'odd', ?)", [(i, t, len(t)) for i, t in enumerate(texts)])
        con.execute(f"COPY x TO '{tmp_path}/documents.parquet'")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        return str(tmp_path), con

    return make


def _rows(rows):
    return sorted(tuple(map(repr, r)) for r in rows)


def _both(spark, at, name):
    """Rows of the query and of its SQL, columns by name."""
    folder, con = at
    got = entry.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute("SELECT {} FROM ({}) z".format(", ".join(f'"{c}"' for c in cols), entry.oracle_sql()[name])).fetchall()
    return _rows(map(tuple, got.select(cols).collect())), _rows(want)


def test_pages_without_a_character(spark, odd):
    """An empty text, and a page that holds only the empty line after the last line end, divided by zero."""
    got, want = _both(spark, odd("", _lines(40) + "\n", _lines(3), "\n\n"), "s11_page_confidence")
    assert got == want and len(got) == 5
    blocks = spark.createDataFrame([(1, 0, "", 90.0), (1, 1, "ab", 50.0)], "doc_id int, page int, text string, conf double")
    assert {(x.page, x.conf, x.needs_ocr) for x in documents.page_confidence(blocks, 2).collect()} == {(0, None, True), (1, 50.0, False)}


@pytest.mark.parametrize("name", ["s1_markdown_blocks", "c4_sections", "c5_merge_groups", "c8_chunks"])
def test_headings_without_text(spark, odd, name):
    """Hashes before an empty line, or one of white space, are a heading, which opens no section."""
    blank = [_lines(8 * k) + f"\n{b}\n" + _lines(m) for k, b, m in ((1, "", 5), (2, " \t", 30), (7, "\x0b", 1))]
    texts = ["", " ", "\t\x0c", *blank, _lines(40), "\u2028", "\x85", "a\n\u2028\nb", "one", _lines(8) + "\n"]
    got, want = _both(spark, odd(*texts), name)
    assert got == want and len(got) >= len(texts) - 3


def test_blank_lines_are_no_paragraphs(spark):
    rows = documents.markdown_blocks(spark.createDataFrame([(1, "# \n\na\n \nb\n##\t \n#\n```\n# \n```\n# #\n####### x")], "doc_id long, text string")).orderBy("block").collect()
    assert [(x.level, x.text) for x in rows] == [(1, ""), (None, "a"), (None, "b"), (2, ""), (None, "#\n```\n# \n```"), (1, "#"), (None, "####### x")]
    assert documents.chunk_documents(spark.createDataFrame([(1, "# "), (2, "## \n\n### \n")], "doc_id long, text string")).count() == 0


def test_equal_spans_are_put_in_no_order(spark):
    """Of many equal spans one is ranked; which of them came first was left to the sort."""
    deal = random.Random(7)
    spans = [(k, a, a + deal.randrange(9), deal.choice(["exact", "normalized", "fuzzy", "fallback"])) for k in range(6) for a in deal.choices(range(0, 400, 5), k=30)] * 20
    deal.shuffle(spans)
    out = answers.merge_spans(spark.createDataFrame(spans, "key int, start int, end int, method string").repartition(7))
    want, order = [], ["exact", "normalized", "fuzzy", "fallback"]
    for k, a, z, m in sorted(spans):
        if want and want[-1][0] == k and a <= want[-1][2] + 1:
            want[-1] = (k, want[-1][1], max(z, want[-1][2]), max(m, want[-1][3], key=order.index))
        else:
            want.append((k, a, z, m))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 60
    # Written from the top down: what is put in order was grouped before.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate")
