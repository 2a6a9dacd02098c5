"""Pages from what lies on them: printed lines (S9), recognised blocks (S12), trees of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.documents import heading_levels, layout_headings, markdown_table, rich_text
from loamgrid.plans.session import Scratch

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _levels_of(headings: DataFrame, size: str, ratio: float) -> DataFrame:
    """(doc_id, size, level) of the rounded sizes of a document's headings."""
    sizes = headings.groupBy("doc_id").agg(F.collect_set(F.round(size, 1)).alias("sizes"))
    return sizes.select("doc_id", F.explode(heading_levels(F.col("sizes"), ratio)).alias("x")).select("doc_id", "x.size", "x.level")


def page_blocks(lines: DataFrame) -> DataFrame:
    """One row per block of a page, in reading order: doc_id, page, block, kind, level, text.

    ``lines(doc_id, page, pos, y, x, block, size, bold, text)``; reading order is by y, then x, each to one
    decimal, then ``pos``. A heading (S7, its level by S8) is a block of its own. Another line begins a
    block where the one before it is a heading or lies in another block; a block's lines are joined by
    blanks. Lines without text are left out.
    """
    x = lines.withColumn("text", F.regexp_replace(F.replace("text", F.lit("\x00"), F.lit("")), r"^\s+|\s+$", "")).filter("text <> ''")
    x = x.join(layout_headings(x), ["doc_id", "page", "pos"])
    levels = _levels_of(x.filter("is_heading"), "size", 0.92)
    by = Window.partitionBy("doc_id", "page").orderBy(F.round("y", 1), F.round("x", 1), "pos")
    before = F.lag(F.struct("is_heading", "block")).over(by)
    start = F.col("is_heading") | before.isNull() | before["is_heading"] | (before["block"] != F.col("block"))
    x = x.withColumn("n", F.row_number().over(by)).withColumn("start", start.cast("int")).withColumn("b", F.sum("start").over(by))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), " ")
    out = x.groupBy("doc_id", "page", "b").agg(F.bool_or("is_heading").alias("h"), F.round(F.max("size"), 1).alias("size"), text.alias("text"))
    out = out.join(levels, ["doc_id", "size"], "left")
    return out.select("doc_id", "page", F.col("b").cast("int").alias("block"), F.when(F.col("h"), "heading").otherwise("paragraph").alias("kind"), F.when(F.col("h"), F.col("level")).alias("level"), "text")


def page_texts(blocks: DataFrame) -> DataFrame:
    """The blocks of each page (S9, S12) as one text, and its headings in order: doc_id, page, text, headings."""
    rows = F.sort_array(F.collect_list(F.struct("block", "kind", "level", "text")))
    out = blocks.groupBy("doc_id", "page").agg(rows.alias("b"))
    heads = F.transform(F.filter("b", lambda r: r["kind"] == "heading"), lambda r: F.struct(r["level"].alias("level"), r["text"].alias("text")))
    return out.select("doc_id", "page", F.array_join(F.transform("b", lambda r: r["text"]), "\n\n").alias("text"), heads.alias("headings"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the median of a list in which each value stands ``weight`` times, of a whole-number weight.

    Weights are added up in order of the values. The list's two middle places lie where the sum first
    reaches them, so no list is ever made.
    """
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).cast("long").alias("w")).filter("w > 0")
    by = Window.partitionBy(*keys).orderBy(value)
    x = sums.withColumn("to", F.sum("w").over(by)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    lower, upper = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    holds = lambda place: (F.col("to") - F.col("w") <= place) & (place < F.col("to"))
    at = lambda place: F.max(F.when(holds(place), F.col(value)))
    return x.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias("median"))


def recognised_blocks(blocks: DataFrame) -> DataFrame:
    """Kind and level of recognised blocks: doc_id, page, block, kind, level, text; blank ones are left out.

    ``blocks(doc_id, page, block, height, lines, text)``. A heading is a quarter higher than the page's
    median, which weighs each block by its characters; it is short, of two lines at most and ends like no
    sentence. Levels are those of S8 with a ratio of 0.9, over the whole document.
    """
    high = F.col("height").isNotNull() & (F.col("height") != 0)
    median = weighted_median(blocks.filter(high).withColumn("w", F.greatest(F.length("text"), F.lit(1))), ["doc_id", "page"], "height", "w")
    x = blocks.join(median, ["doc_id", "page"], "left").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    h = (F.col("median") > 0) & (F.col("height") > F.col("median") * 1.25) & (F.length("text") < 80) & (F.col("lines") <= 2) & ~F.col("text").rlike(r"[.,;:]$")
    x = x.withColumn("h", F.coalesce(h, F.lit(False))).withColumn("size", F.round("height", 1))
    levels = _levels_of(x.filter("h"), "height", 0.9)
    out = x.filter("text <> ''").join(levels, ["doc_id", "size"], "left")
    return out.select("doc_id", "page", "block", F.when(F.col("h"), "heading").otherwise("paragraph").alias("kind"), F.when(F.col("h"), F.col("level")).alias("level"), "text")


def compact_layout(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of each recognised page: doc_id, page, size, blocks (bbox, text) in order; ``pages`` has each one's width and height."""
    rows = blocks.filter("text <> '' and x0 is not null").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("block", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text"))).alias("b"))
    out = pages.join(rows, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", F.array("width", "height").alias("size"), F.transform(F.coalesce("b", F.array().cast(rows.schema["b"].dataType)), lambda r: F.struct(r["bbox"].alias("bbox"), r["text"].alias("text"))).alias("blocks"))


# S15. Types of blocks that are list items, and those below which nothing is shown.
LISTS = ["bulleted_list_item", "numbered_list_item", "to_do"]
CLOSED = [
    "code", "equation", "divider", "table", "child_page", "child_database", "bookmark", "embed", "link_preview", "image", "file", "pdf", "video", "audio",
    "link_to_page", "table_of_contents", "breadcrumb", "unsupported", "template",
]
DEPTH = 8


def _lines(text: Column) -> Column:
    """Lines of a text; a line end at its end begins none."""
    split = F.split(text, _LINE_END, -1)
    return F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def own_text() -> Column:
    """What a block says itself, by its type; null for nothing. A numbered item lacks its number, a table its rows."""
    kind, text = F.col("type"), F.col("text")
    some = F.nullif(text, F.lit(""))
    label = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("name", F.lit("")))
    url = F.nullif("url", F.lit(""))
    marker = F.when(kind == "numbered_list_item", "").when(kind == "to_do", F.when(F.coalesce("checked", F.lit(False)), "- [x]").otherwise("- [ ]")).otherwise("-")
    heading = F.concat(F.repeat(F.lit("#"), F.regexp_extract(kind, r"(\d)$", 1).try_cast("int") + 1), F.lit(" "), some)
    return (
        F.when(kind.isin(LISTS), F.regexp_replace(F.concat_ws(" ", marker, text), r"\s+$", ""))
        .when(kind.isin("heading_1", "heading_2", "heading_3"), heading)
        .when(kind == "quote", F.when(some.isNotNull(), F.array_join(F.transform(_lines(text), lambda x: F.concat(F.lit("> "), x)), "\n")))
        .when(kind == "toggle", F.concat(F.lit("**"), some, F.lit("**")))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "equation", F.concat(F.lit("$$ "), F.nullif("expression", F.lit("")), F.lit(" $$")))
        .when(kind == "divider", F.lit("---"))
        .when(kind == "child_page", F.concat(F.lit("Sub-page: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))))
        .when(kind == "child_database", F.concat(F.lit("Database: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))))
        .when(kind.isin("bookmark", "embed", "link_preview"), F.concat(F.lit("["), F.coalesce(F.nullif("caption", F.lit("")), url), F.lit("]("), url, F.lit(")")))
        .when(kind.isin("image", "file", "pdf", "video", "audio"), F.concat(F.lit("["), kind, F.lit(": "), label, F.lit("]")))
        .when(kind.isin("table", "link_to_page", "table_of_contents", "breadcrumb", "unsupported", "template", "column_list", "column", "synced_block"), None)
        .otherwise(some)
    )


def _tables(blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, table) of table blocks: their children's cells in order, the first row on top if it is a header."""
    heads = blocks.filter("type = 'table'").select("page_id", F.col("block_id").alias("parent_id"), F.coalesce("has_header", F.lit(False)).alias("header"))
    cells = F.transform(F.coalesce("cells", F.array().cast("array<array<string>>")), lambda c: rich_text(c, typed=True)) if "array<struct" in blocks.schema["cells"].dataType.simpleString() else F.coalesce("cells", F.array().cast("array<string>"))
    rows = blocks.select("page_id", "parent_id", "ord", "block_id", cells.alias("cells")).join(heads, ["page_id", "parent_id"])
    rows = rows.groupBy("page_id", "parent_id", "header").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block_id", "cells"))), lambda r: r["cells"]).alias("rows"))
    none = F.array(F.array().cast("array<string>"))
    return rows.select("page_id", F.col("parent_id").alias("block_id"), markdown_table(F.when(F.col("header"), F.col("rows")).otherwise(F.concat(none, F.col("rows")))).alias("table"))


def placed_blocks(blocks: DataFrame, s: Scratch, depth: int = DEPTH) -> DataFrame:
    """Shown blocks of each page: page_id, path, part, indent, own.

    ``path`` is the block's place among its siblings after its parent's path, so paths in order are the
    page from top to bottom. Paths are made level by level: each level is written and joined to its
    children, down to ``depth`` levels below the first, so a circle or a very deep branch ends. A list is
    one part of the page: neighbouring list items, and all that stands below them, indented by two
    blanks for each list item above. Any other block is a part of its own. Levels hold places only; what
    blocks say is written once and met at the end, by a number of the row, as ids may come twice.
    """
    x = blocks.select("page_id", "block_id", "parent_id", "ord", "type", own_text().alias("own"), (F.col("text") != "").alias("said"), F.monotonically_increasing_id().alias("row"))
    texts = s.keep(x, "texts")
    x = texts.drop("own")
    by = Window.partitionBy("page_id", "parent_id").orderBy("ord", "block_id", "row")
    is_list = F.col("type").isin(LISTS)
    x = x.withColumn("i", F.row_number().over(by)).withColumn("is_list", is_list)
    # A list ends at any other block; numbers begin anew there and after a bulleted item.
    x = x.withColumn("list", F.sum(F.when(is_list, 0).otherwise(1)).over(by)).withColumn("count", F.sum(F.when(F.col("type").isin("numbered_list_item", "to_do"), 0).otherwise(1)).over(by))
    of = lambda c: Window.partitionBy("page_id", "parent_id", c)
    x = x.withColumn("first", F.min(F.when(is_list, F.col("i"))).over(of("list")))
    x = x.withColumn("number", F.sum(F.when(F.col("type") == "numbered_list_item", 1).otherwise(0)).over(of("count").orderBy("i")))
    x = x.withColumn("open", ~F.col("type").isin(CLOSED) & ((F.col("type") != "quote") | F.col("said")))
    x = s.keep(x.select("page_id", "block_id", "parent_id", "row", "i", "first", "is_list", "number", "open"), "siblings")
    top = x.filter("parent_id is null")
    level = s.keep(_below(top, F.array().cast("array<int>"), F.lit(None).cast("array<int>"), F.lit(0)), "level")
    out = level
    for _ in range(depth):
        above = level.filter("open").select("page_id", F.col("block_id").alias("parent_id"), F.col("path").alias("p"), F.col("part").alias("q"), (F.col("indent") + F.col("is_list").cast("int")).alias("n"))
        found = x.join(above, ["page_id", "parent_id"])
        inside = F.when(F.col("n") > 0, F.col("q"))
        level = s.keep(_below(found, F.col("p"), inside, F.col("n")), "level")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    out = out.join(_tables(blocks), ["page_id", "block_id"], "left").select("page_id", "row", "path", "part", "indent", "number", "table")
    own = F.when(F.col("type") == "table", F.col("table")).when(F.col("type") == "numbered_list_item", F.concat(F.col("number").cast("string"), F.lit("."), "own")).otherwise(F.col("own"))
    out = out.join(texts.filter("own is not null or type = 'table'").select("page_id", "row", "type", "own"), ["page_id", "row"])
    return out.select("page_id", "path", "part", "indent", own.alias("own"))


def _below(rows: DataFrame, path: Column, part: Column, indent: Column) -> DataFrame:
    """A level's blocks below parents of this path, part (null outside lists) and number of list items."""
    own = lambda i: F.concat(path, F.array(i))
    new = F.when(F.col("is_list"), own(F.col("first"))).otherwise(own(F.col("i")))
    return rows.select("page_id", "block_id", "row", "is_list", "number", "open", own(F.col("i")).alias("path"), F.coalesce(part, new).alias("part"), indent.cast("int").alias("indent"))


def block_tree_markdown(pages: DataFrame, blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, markdown.

    ``pages(page_id, title, properties)``: properties are (name, value) rows of a database's page, shown as
    a list below the title. ``blocks(page_id, block_id, parent_id, ord, type, text, checked, language,
    expression, title, url, caption, name, has_header, cells)``: parent_id is null at the top; text and
    caption are texts, or runs of rich text (S14) as the cells of a table row may be. A block whose parent
    is not on its page is not shown.
    """
    s = Scratch(blocks.sparkSession, "blocks")
    for c in ("text", "caption"):
        if blocks.schema[c].dataType.simpleString().startswith("array"):
            blocks = blocks.withColumn(c, rich_text(F.col(c), typed=True))
    blocks = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    x = placed_blocks(blocks, s, depth).filter("own is not null").repartition("page_id")  # for both groupings below
    pad = F.repeat(F.lit("  "), F.col("indent"))
    line = F.when(F.col("indent") > 0, F.array_join(F.transform(_lines(F.col("own")), lambda y: F.concat(pad, y)), "\n")).otherwise(F.col("own"))
    x = x.withColumn("line", line).filter((F.col("indent") == 0) | (F.size(_lines(F.col("own"))) > 0))
    parts = x.groupBy("page_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda y: y["line"]), "\n").alias("text"))
    body = parts.filter(F.col("text").rlike(r"\S")).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda y: y["text"]).alias("parts"))
    title = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    rows = F.filter("properties", lambda p: F.coalesce(p["value"], F.lit("")) != "")
    props = F.array_join(F.transform(rows, lambda p: F.concat(F.lit("- "), p["name"], F.lit(": "), p["value"])), "\n")
    head = F.array_compact(F.array(title, F.nullif(F.coalesce(props, F.lit("")), F.lit(""))))
    out = pages.join(body, "page_id", "left").select("page_id", F.concat(F.array_join(F.concat(head, F.coalesce("parts", F.array().cast("array<string>"))), "\n\n"), F.lit("\n")).alias("markdown"))
    return s.finish(out)
