"""Which pages a source takes in, and what a run of it does to the documents of its collection, item by item and in all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.documents import safe_filename, scope_closure
from loamgrid.plans.session import Scratch

#: What an item can come to, and the name of its count in a source's statistics.
COUNTS = {"added": "added", "updated": "updated", "unchanged": "unchanged", "removed": "removed", "duplicate": "duplicates", "too_large": "skipped_too_large", "quota": "skipped_quota", "error": "skipped_errors"}
_EVENT = "tenant_id", "source_id", "pos", "external_id", "collection_id", "kind", "bytes", "old_bytes", "sha256", "old_sha256", "held", "used", "quota"


def listed_items(listed: DataFrame, most: int) -> DataFrame:
    """The first ``most`` items of each source by ``pos``, and whether its listing had more."""
    by = Window.partitionBy("source_id").orderBy("pos")
    more = listed.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most + 1)
    cut = more.filter(F.col("n") > most).select("source_id", F.lit(True).alias("truncated"))
    return more.filter(F.col("n") <= most).drop("n").join(cut, "source_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def _decided(max_bytes: int) -> Column:
    """Outcomes that no other item can change; null for an item that asks for room."""
    return (
        F.when(F.col("version").eqNullSafe(F.col("old_version")) & F.col("document_id").isNotNull(), "unchanged")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("bytes") > max_bytes, "too_large")
        .when(F.col("sha256") == F.col("old_sha256"), "unchanged")
    )


def _in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """The contested items of a tenant, in order: each needs room in the quota, then a text that no document of its collection has.

    What is refused uses nothing; an update gives back what its document had, a removed document its room and text.
    """
    pdf = pdf.sort_values(["source_id", "pos", "external_id"], kind="stable")
    used, held, out = None, {}, []
    for x in pdf.itertuples(index=False):
        used = int(x.used) if used is None else used
        new, old = (x.collection_id, x.sha256), (x.collection_id, x.old_sha256)
        if x.kind == "removed":
            used, held[old], status = used - int(x.old_bytes), False, "removed"
        elif not pd.isna(x.quota) and used - int(x.old_bytes) + int(x.bytes) > x.quota:
            status = "quota"
        elif held.get(new, x.held):
            status = "duplicate"
        else:
            if x.kind == "updated":
                held[old] = False
            used, held[new], status = used + int(x.bytes) - int(x.old_bytes), True, x.kind
        out.append(status)
    return pdf[["source_id", "pos", "external_id"]].assign(status=out)


def sync_sources(listed: DataFrame, existing: DataFrame, sources: DataFrame, uploads: DataFrame, quotas: DataFrame, most: int, max_bytes: int) -> DataFrame:
    """One row per listed item and per document that goes: source_id, pos, external_id, status, document_id, filename, sha256, bytes, truncated, error.

    ``listed(source_id, pos, external_id, version, title, text, error)``: text is null where an item could
    not be rendered, which ``error`` explains. ``existing(source_id, external_id, document_id, version,
    sha256, size_bytes)`` are the documents of the sources, ``uploads(collection_id, sha256, size_bytes)``
    all others of their collections, ``sources(source_id, collection_id, tenant_id)`` and
    ``quotas(tenant_id, quota)`` with no quota where it is null. Sources of a tenant take their turn by id.

    A document whose item is listed no more goes first, unless the listing was cut at ``most`` items: that
    says nothing of what lies beyond. Everything that an item's own row decides is decided by expressions;
    only the rest is replayed in order, a tenant at a time, and no source brings more than ``most`` of it.
    """
    s = Scratch(listed.sparkSession, "sync")
    own = existing.join(sources, "source_id")
    old = existing.select("source_id", "external_id", "document_id", F.col("version").alias("old_version"), F.col("sha256").alias("old_sha256"), F.col("size_bytes").alias("old_bytes"))
    payload = F.col("text").cast("binary")
    items = listed_items(listed, most).join(old, ["source_id", "external_id"], "left").withColumns({"bytes": F.octet_length(payload).cast("long"), "sha256": F.sha2(payload, 256)})
    items = s.keep(items.withColumn("decided", _decided(max_bytes)).drop("text").join(sources, "source_id"), "items")

    cut = items.filter("truncated").select("source_id").distinct()
    gone = old.join(items.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti").join(cut, "source_id", "left_anti").join(sources, "source_id")
    gone = s.keep(gone.withColumn("pos", F.lit(-1).cast("long")), "gone")

    texts = own.select("collection_id", "sha256", "size_bytes", "tenant_id").unionByName(uploads.join(sources.select("collection_id", "tenant_id").distinct(), "collection_id").select("collection_id", "sha256", "size_bytes", "tenant_id"))
    used = texts.groupBy("tenant_id").agg(F.sum("size_bytes").alias("used"))
    held = texts.select("collection_id", "sha256").distinct().withColumn("held", F.lit(True))
    asks = items.filter("decided is null").withColumn("kind", F.when(F.col("document_id").isNull(), "added").otherwise("updated")).join(held, ["collection_id", "sha256"], "left")
    room = gone.withColumns({"kind": F.lit("removed"), "bytes": F.lit(None).cast("long"), "sha256": F.lit(None).cast("string"), "held": F.lit(None).cast("boolean")})
    money = quotas.select("tenant_id", "quota")
    events = asks.select(*_EVENT[:11]).unionByName(room.select(*_EVENT[:11])).join(used, "tenant_id", "left").join(money, "tenant_id", "left")
    events = events.withColumns({"used": F.coalesce("used", F.lit(0)), "held": F.coalesce("held", F.lit(False)), "old_bytes": F.coalesce("old_bytes", F.lit(0))})
    told = events.select(*_EVENT).groupBy("tenant_id").applyInPandas(_in_turn, "source_id long, pos long, external_id string, status string")

    key = ["source_id", "pos", "external_id"]
    out = items.join(told.filter("pos >= 0"), key, "left").select(*key, F.coalesce("decided", "status").alias("status"), "document_id", safe_filename(F.col("title")).alias("filename"), "sha256", "bytes", "truncated", F.when(F.col("decided") == "error", F.concat(F.left("title", F.lit(60)), F.lit(": "), "error")).alias("error"))
    lost = gone.select(*key, F.lit("removed").alias("status"), "document_id", F.lit(None).cast("string").alias("filename"), F.col("old_sha256").alias("sha256"), F.col("old_bytes").alias("bytes"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))
    return s.finish(out.unionByName(lost))


def sync_stats(outcome: DataFrame, sources: DataFrame, errors: int = 10) -> DataFrame:
    """One row per source: how many items came to what, whether the listing was cut, and its first errors."""
    n = [F.count_if(F.col("status") == k).alias(v) for k, v in COUNTS.items()]
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))), F.lit(1), F.lit(errors)), lambda x: x["error"])
    # Only the first errors of a source are brought together.
    nth = F.row_number().over(Window.partitionBy("source_id", F.col("error").isNull()).orderBy("pos"))
    few = outcome.withColumn("error", F.when(nth <= errors, F.col("error")))
    counts = few.groupBy("source_id").agg(F.count_if(F.col("pos") >= 0).alias("listed"), *n, F.bool_or("truncated").alias("truncated"), first.alias("errors"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("listed", *COUNTS.values())} | {"truncated": F.coalesce("truncated", F.lit(False)), "errors": F.coalesce("errors", F.array().cast("array<string>"))}
    return sources.select("source_id").join(counts, "source_id", "left").withColumns(zero)


def normalised_id(text: Column) -> Column:
    """A dashed lower-case id of 32 hexadecimal digits, given as it is, without dashes, or at the end of a page's URL, whatever letters its title ends with; else null."""
    # Each step is named by a list of one, so that an expression stands once in the plan, however often it is used.
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def plain(t: Column) -> Column:
        path = F.regexp_extract(F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", ""), r"^(?://[^/?#]*)?([^?#]*)", 1)
        ids = F.regexp_extract_all(F.replace(path, F.lit("-"), F.lit("")), F.lit("[0-9a-fA-F]{32}(?![0-9a-fA-F])"), F.lit(0))
        return F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("?")), F.try_element_at(ids, F.lit(-1))).otherwise(F.replace(t, F.lit("-"), F.lit("")))

    # Without dashes so far: only what fits gets them.
    dashed = F.regexp_replace(F.lower(let(F.btrim(text, F.lit(" \t\n\x0b\f\r")), plain)), r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})\z", "$1-$2-$3-$4-$5")
    return let(dashed, lambda x: F.when(F.contains(x, F.lit("-")), x))


def pages_in_scope(objects: DataFrame, blocks: DataFrame, roots: DataFrame, hops: int = 64) -> DataFrame:
    """Ids of the pages that a source takes in.

    ``objects(id, kind, parent_id, archived)`` are pages and databases, ``blocks(id, parent_id)`` what pages
    may stand in, ``roots(id)`` ids or URLs. A page counts if it is a root or its chain of parents, through
    databases and blocks, meets one; archived objects end a chain unless they are roots. Without roots all
    pages count.
    """
    ids = lambda df, *more: df.select(normalised_id(F.col("id")).alias("id"), *more).filter("id is not null")
    s = Scratch(objects.sparkSession, "pages")
    # Ids are read from their texts once, however many levels there are.
    live = s.keep(ids(objects.filter(~F.coalesce("archived", F.lit(False))), "kind", normalised_id(F.col("parent_id")).alias("parent")), "live")
    pages = live.filter("kind = 'page'").select("id").distinct()
    start = ids(roots).distinct()
    if not start.limit(1).count():
        return s.finish(pages)
    held = s.keep(ids(blocks, normalised_id(F.col("parent_id")).alias("parent")), "blocks")
    nodes = live.select("id", "parent").unionByName(held).unionByName(start.withColumn("parent", F.lit(None).cast("string")))
    return s.finish(pages.join(scope_closure(nodes, start, hops), "id", "left_semi"))
