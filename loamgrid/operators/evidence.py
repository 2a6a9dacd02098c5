"""Where a field's value stands: a span of a chunk (X10) and the box on the page that carries it (X11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.answers import compare_tasks, exact_span, find_spans
from loamgrid.plans.session import Scratch

#: Confidence of a quote that holds the value, of a quote, of the value alone, and of nothing.
SURE, QUOTED, VALUE, NOTHING = 0.9, 0.75, 0.6, 0.4
LEAST_SHARE = 0.6


def plain(text: Column) -> Column:
    """One blank for each run of white space, none at the ends, case folded."""
    return F.trim(F.replace(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("ß"), F.lit("ss")))


def marks_of(word: Column) -> Column:
    """A number that equal words share, and now and then others."""
    return F.hash(word)


def located(needles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, needle, chunk_index, start, end, method): the first chunk of the document that has the needle.

    ``needles(doc_id, needle)``. A chunk has it verbatim, normalised or nearly (G6-G8). Verbatim places
    are found by expressions; a chunk goes to Python once, with all needles that no chunk before it and
    it itself has verbatim, so its text is normalised once.
    """
    chunks = chunks.select("doc_id", "chunk_index", "content")
    lists = needles.filter(F.length("needle") > 0).distinct().groupBy("doc_id").agg(F.collect_list("needle").alias("needles"))  # a schema's fields
    one = lambda n: F.struct(n.alias("needle"), exact_span(n, F.col("content")).alias("span"))
    both = chunks.join(lists, "doc_id").select("doc_id", "chunk_index", F.explode(F.transform("needles", one)).alias("x")).select("doc_id", "chunk_index", "x.*")
    # Texts stay behind: what is ranked are places.
    first = F.min(F.when(F.col("span").isNotNull(), F.col("chunk_index"))).over(Window.partitionBy("doc_id", "needle"))
    both = Scratch(needles.sparkSession, "located").keep(both.withColumn("first", first), "places")
    sure = both.filter(F.col("chunk_index") == F.col("first")).select("doc_id", "needle", "chunk_index", "span.start", "span.end", F.lit("exact").alias("method"))
    open_ = both.filter(F.col("first").isNull() | (F.col("chunk_index") < F.col("first"))).groupBy("doc_id", "chunk_index").agg(F.collect_list("needle").alias("needles"))
    packed = open_.join(chunks, ["doc_id", "chunk_index"]).repartition(compare_tasks(needles.sparkSession), "doc_id", "chunk_index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = [(x.doc_id, n, x.chunk_index, x.content) for x in f.itertuples() if x.content for n in x.needles]
            rows = [(*a[:3], *s) for a, s in zip(asked, find_spans((a[1], a[3]) for a in asked)) if s]
            yield pd.DataFrame(rows, columns=["doc_id", "needle", "chunk_index", "start", "end", "method"])

    near = packed.mapInPandas(run, "doc_id long, needle string, chunk_index int, start int, end int, method string")
    names = ["doc_id", "needle", "chunk_index", "start", "end", "method"]
    best = sure.unionByName(near).groupBy("doc_id", "needle").agg(F.min_by(F.struct(*names[2:]), "chunk_index").alias("x"))
    return best.select("doc_id", "needle", "x.*")


def box_lookup(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """X11: (key, page, bbox, size, score) of the block that carries a span's text, if one does.

    ``spans(key, doc_id, quote, page_start, page_end)``: without both pages all pages of the document
    count. ``blocks(doc_id, page, block, bbox, size, text)``. A block that holds the text, without regard
    to case and space, scores 1, another one the share of the text's words it has, ``LEAST_SHARE`` at
    least; of equal blocks the first in order of page and block. Texts of both sides are dealt out once,
    by document, and alone: their words are made where they arrive, and pages are a condition of the join.
    Words are compared only with a text that has enough of their hashes; hashes that fall together count
    as found, so no text is left out.
    """
    full = lambda c: F.col(c).rlike(r"(?U)\S")  # noqa: E731  as the plain text is not empty, without making it twice
    words = lambda t: F.array_distinct(F.split(t, " "))
    marks = lambda w: F.array_distinct(F.transform(w, lambda x: marks_of(x)))
    known = F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    s = spans.filter(full("quote")).select("key", "doc_id", plain(F.col("quote")).alias("needle"), F.when(known, F.col("page_start")).alias("low"), F.when(known, F.col("page_end")).alias("high"))
    s = s.repartition("doc_id").withColumn("wanted", words(F.col("needle"))).withColumn("sought", marks(F.col("wanted")))
    place = F.row_number().over(Window.partitionBy("of").orderBy("page", "block"))
    b = blocks.filter(full("text")).select(F.col("doc_id").alias("of"), "page", "block", "bbox", "size", plain(F.col("text")).alias("text")).withColumn("place", place).withColumn("words", words(F.col("text"))).withColumn("held", marks(F.col("words")))
    fits = F.col("low").isNull() | F.col("page").between(F.col("low"), F.col("high"))
    share = F.size(F.array_intersect("wanted", "words")) / F.size("wanted")
    most = F.size(F.array_intersect("sought", "held")) + F.size("wanted") - F.size("sought")
    enough = (F.size("words") >= F.size("wanted") * LEAST_SHARE) & (most >= F.size("wanted") * LEAST_SHARE)
    # Pages come first, as conditions of a join are tried in an order of their own.
    x = s.join(b, F.col("doc_id") == F.col("of")).withColumn("score", F.when(fits, F.when(F.contains("text", "needle"), F.lit(1.0)).when(enough, share))).filter(F.col("score") >= LEAST_SHARE)
    top = F.min_by(F.struct("page", "bbox", "size", F.round("score", 9).alias("score")), F.struct((-F.col("score")).alias("s"), "place"))
    return x.groupBy("key").agg(top.alias("x")).select("key", "x.*")


def find_evidence(fields: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per field: doc_id, field, confidence, chunk_id, chunk_index, start, end, quote, method, page, bbox, page_size.

    ``fields(doc_id, field, value, quote, searchable)``: the quote is looked for first, then the value,
    unless it is a list or a yes or no (``searchable`` is false). ``chunks(doc_id, chunk_id, chunk_index,
    page_start, page_end, content)``, ``blocks`` as for ``box_lookup``. A found place has the page and box
    of its block if there is one, else its chunk's first page.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    tries = F.filter(F.array(F.struct(F.lit(0).alias("turn"), some("quote").alias("needle")), F.struct(F.lit(1).alias("turn"), F.when(F.coalesce("searchable", F.lit(True)), F.col("value")).alias("needle"))), lambda x: x["needle"].isNotNull())
    asked = fields.select("doc_id", "field", "value", F.explode(tries).alias("x")).select("doc_id", "field", "value", "x.turn", "x.needle")
    found = asked.join(located(asked.select("doc_id", "needle"), chunks), ["doc_id", "needle"])
    best = found.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "turn", "needle", "chunk_index", "start", "end", "method"), "turn").alias("x")).select("doc_id", "field", "x.*")
    best = best.join(chunks, ["doc_id", "chunk_index"]).withColumn("quote", F.col("content").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    holds = (plain(F.col("value")) != "") & F.contains(plain(F.col("quote")), plain(F.col("value")))
    sure = F.when(F.col("turn") == 1, VALUE).when(F.col("value").isNull() | F.coalesce(holds, F.lit(False)), SURE).otherwise(QUOTED)
    best = best.withColumn("confidence", sure).withColumn("key", F.struct("doc_id", "field")).drop("content")
    best = Scratch(fields.sparkSession, "evidence").keep(best, "best")  # read twice below
    boxes = box_lookup(best.select("key", "doc_id", F.col("needle").alias("quote"), "page_start", "page_end"), blocks).select("key", F.col("page").alias("p"), "bbox", F.col("size").alias("page_size"))
    out = best.join(boxes, "key", "left").select("doc_id", "field", "confidence", "chunk_id", "chunk_index", "start", "end", "quote", "method", F.coalesce("p", "page_start").alias("page"), "bbox", "page_size")
    return fields.select("doc_id", "field").join(out, ["doc_id", "field"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(NOTHING)))
