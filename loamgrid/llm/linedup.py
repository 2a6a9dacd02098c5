"""Line deduplication: lines that many documents share stay in one of them only.

Every text is split at line feeds. The lines that are long enough to count are exploded with their
positions and hashed; a line that the whole table has in fewer rows than the threshold asks for cannot
be in enough documents, so one aggregation of hashes (combined before its shuffle, whatever a hot line's
share) leaves few candidates. Of these the distinct documents are counted, and the positions to drop
come back to each text as a set, so that a text is put together again by position: one hash set of
positions, no search line by line.

A line's key is the line without ``SPACE`` at both ends and with A-Z in lower case; its hash is half a
SHA-256. Defined results: a null or empty text is one empty line; the lines that stay keep their own
space and case; a document is a doc_id, so rows that repeat an id are one document in all counts, and
all of them keep the lines their id keeps; rows without an id are together one document that comes
before all others; a line that occurs several times in a document counts once and stays or goes as a
whole; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.exactdup import _LOWER, _UPPER
from loamgrid.plans.session import Scratch

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def _digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What a row is: its id, or that it has none, and its text. Rows that share these lose the same lines."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNotNull().alias("has_id"), F.xxhash64(text, F.octet_length(text)).alias("content")]


_ROW = ["id", "has_id", "content"]


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, has_id, content, pos, line) for each line of ``min_chars`` code points or more; line is a hash."""
    t = _text(F.col("text"))
    long = docs.select(*_row_key(F.col("doc_id"), t), F.posexplode(F.split(t, "\n", -1)).alias("pos", "l")).filter(F.char_length("l") >= min_chars)
    long = long.withColumn("l", F.btrim("l", F.lit(SPACE))).filter(F.char_length("l") >= min_chars)
    return long.select(*_ROW, "pos", _digest(line_key(F.col("l"))).alias("line"))


def dropped_positions(docs: DataFrame, s: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, has_id, content, drop) for the rows that lose lines; drop is the set of their positions."""
    lines = s.keep(keyed_lines(docs, min_chars), "lines")
    document = F.struct("has_id", "id")  # in order: no id comes first
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("line")
    hits = s.keep(lines.join(often, "line"), "hits")
    shared = hits.groupBy("line").agg(F.count_distinct(document).alias("docs"), F.max(document).alias("keeper")).filter(F.col("docs") >= min_docs)
    lost = hits.join(shared.select("line", "keeper"), "line").filter(document != F.col("keeper"))
    return lost.groupBy(*_ROW).agg(F.collect_set("pos").alias("drop"))


def deduplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, text, n_lines, n_dropped) for each row of ``docs``: row as it came, text as it stays."""
    s = Scratch(docs.sparkSession, "linedup")
    lost = dropped_positions(docs, s, min_chars, min_docs)
    # The whole row travels as one column, so no name of the caller's can clash.
    rows = docs.select(F.struct("*").alias("row"))
    t = _text(F.col("row")["text"])
    rows = rows.select("row", *_row_key(F.col("row")["doc_id"], t)).join(lost.hint("merge"), _ROW, "left")
    lines = F.split(t, "\n", -1)
    # Both are sets without nulls: linear in the lines, and the positions that stay remain in order.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    put = lambda v: F.array_join(F.transform(stay, lambda p: F.get(v[0], p)), "\n")
    whole = F.get(F.transform(F.array(F.array(lines)), put), F.lit(0))
    out = rows.select(
        "row",
        F.when(F.col("drop").isNull(), t).otherwise(whole).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return s.finish(out)


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs``, all rows and columns, without the lines they lose."""
    out = deduplicate_lines(docs, min_chars, min_docs)
    return out.select(F.when(F.col("n_dropped") > 0, F.col("row").withField("text", F.col("text"))).otherwise(F.col("row")).alias("row")).select("row.*")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op11_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS v FROM documents),
p AS (SELECT doc_id, unnest(v) AS line, unnest(range(len(v))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM p),
g AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""
}
