"""Quality rules with cross-document line frequency, with DataFrame operations only.

Rules on one document (counts over its whole text) come first. Then every line of a document is
normalised and hashed, and per host the distinct documents that hold it are counted, those that fail
the rules included. A line is removed wherever the host has it if its documents are above both limits
(an absolute number and a share of the host's documents) and have ``MIN_TEXTS`` different texts or
more: what stands in copies of a few texts only is no boilerplate but a matter of deduplication. A
document that keeps too small a share of its words is rejected.

Lines are compared without case, without space at their ends, with other space as one blank and with
every run of digits as one 0; so lines that differ only in numbers are one line. A document loses 20
times the mean number of lines of its host's documents at most, since each is in a twentieth of them.

Words are runs of characters other than 0x20 and 0x09-0x0D. Defined results: null text has no words
and fails; a null host is a host of its own; repeated rows are judged alike and count once; an empty
table gives an empty result; extra columns pass through ``clean_documents`` whatever their names and
are ignored otherwise. Row identity is (doc_id, text): rows that share both share one verdict, and
rows that share an id only are two documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20
#: A line is boilerplate in more documents of a host than both; a document with fewer of its words left is depleted.
MIN_DOCS, MIN_SHARE, MIN_LEFT = 20, 0.05, 0.3
#: Different texts among these documents.
MIN_TEXTS = 5


def _line_key(line: Column) -> Column:
    """Hash of a line without case, digits and surrounding or repeated space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), _SPACE, " ")))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Windows are hashed; only where two agree are they sorted with their places, neighbours compared
    and the lengths of the covered places added up.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(a: Column) -> Column:
            same = F.filter(
                F.transform(a, lambda x, i: F.when((F.get(a, i - 1)["h"] == x["h"]) | (F.get(a, i + 1)["h"] == x["h"]), x["p"])),
                lambda p: p.isNotNull(),
            )
            return F.sort_array(same)

        def total(p: Column) -> Column:
            step = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))
            return F.aggregate(F.transform(p, step), F.lit(0).cast("long"), lambda acc, x: acc + x)

        return _let(_let(pairs, places), total)

    def body(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(grams(h), body)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(_WORD))
    n = F.size("_words")
    return (
        out.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(_SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", _repeat_words(F.col("_words"), n))
        .drop("_words")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    )


def frequent_lines(lines: DataFrame, facts: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(host, line) above the limits, of distinct rows (host, line, doc_id, content)."""
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content").alias("texts")).filter((F.col("n") > min_docs) & (F.col("texts") >= min_texts))
    hosts = facts.select("host", "doc_id", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(hosts, "host").filter(F.col("n") > F.col("docs") * min_share).select("host", "line")


def _content(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t, F.octet_length(t))


def judge(docs: DataFrame, s: Scratch, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` with its measures and verdict, and the hashes of the lines it loses."""
    name = F.col(host).cast("string")
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)).alias("host"))
    line = lambda x: F.struct(_line_key(x).alias("line"), F.regexp_count(x, F.lit(_WORD)).alias("w"))
    facts = measures(row).withColumn("content", _content(F.col("text"))).withColumn("lines", F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD)), line)).drop("text")
    facts = s.keep(facts, "facts")
    flat = facts.select("host", "doc_id", "content", F.explode(F.array_distinct("lines.line")).alias("line"))
    lines = s.keep(flat.distinct(), "lines")
    bad = s.keep(frequent_lines(lines, facts), "frequent")
    lost = lines.join(bad, ["host", "line"]).groupBy("host", "content").agg(F.collect_set("line").alias("lost_lines"))
    per_row = F.aggregate(F.filter("lines", lambda x: F.array_contains("lost_lines", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    return (
        facts.join(lost, ["host", "content"], "left")
        .withColumn("words_lost", F.when(F.col("lost_lines").isNull(), F.lit(0).cast("long")).otherwise(per_row))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("words_lost") >= F.col("n_words") * MIN_LEFT))
    )


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, words_lost, kept."""
    s = Scratch(docs.sparkSession, "quality")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_lost", "kept"]
    return s.finish(judge(docs, s, host).select(names))


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that stay, with their columns, without the lines above the limits."""
    s = Scratch(docs.sparkSession, "quality")
    verdict = judge(docs, s, host).filter("kept").select(F.col("doc_id").alias("id"), F.col("host").alias("of"), F.col("content").alias("judged"), F.coalesce("lost_lines", F.array().cast("array<bigint>")).alias("lost"))
    verdict = s.finish(verdict.dropDuplicates(["id", "of", "judged"]), "kept")
    # The whole row travels as one column, so no name of the caller's can clash.
    rows = docs.select(F.struct("*").alias("row"))
    text, name = F.col("row")["text"], F.col("row")[host].cast("string")
    of = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name))
    same = F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("id")) & (of == F.col("of")) & (_content(text) == F.col("judged"))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("lost", _line_key(x))), "\n")
    out = rows.join(verdict, same).withColumn("row", F.col("row").withField("text", F.when(F.size("lost") > 0, left).otherwise(text)))
    return out.select("row.*")


def op6_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
