"""Usage, billing, ingestion and storage analytics (U1-U25) over tables of logs, ledgers and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ["all", "managers", "hr", "finance", "leadership"]  # order of privilege


def usage_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Counts, refusals, token sums and mean latency of each scope."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("refused").alias("refused"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )


def daily_series(log: DataFrame) -> DataFrame:
    """Queries and tokens of each UTC day."""
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.sum("prompt_tokens").alias("prompt_tokens"))


def since(log: DataFrame, now: Column, days: int) -> DataFrame:
    """The log of the last ``days`` days up to ``now``."""
    return log.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def in_scope(log: DataFrame, user: str | None = None, ip: str | None = None) -> DataFrame:
    """What a visitor may sum up: an account's own queries, or a guest's by address; neither: nothing."""
    if user is not None:
        return log.filter(F.col("user_id") == user)
    return log.filter((F.col("ip_digest") == ip) & F.col("user_id").isNull()) if ip is not None else log.limit(0)


def cost_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """U1 with the sum of costs; queries of unknown cost count as none."""
    return usage_summary(log, by).join(log.groupBy(*by).agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(24,6)").alias("cost_usd")), by)


def daily_cost(log: DataFrame, by: list[str]) -> DataFrame:
    """Queries and cost of each UTC day and scope."""
    return log.groupBy(*by, F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(24,6)").alias("cost_usd"))


def query_cost(log: DataFrame, prices: dict[str, tuple[str, str]]) -> DataFrame:
    """Cost by the model's base name (before ``@``), six places half-even; unknown model: null."""
    base = F.split_part("model", F.lit("@"), F.lit(1))
    price = lambda i: F.coalesce(*[F.when(base == m, F.lit(p[i]).cast("decimal(10,4)")) for m, p in prices.items()])
    exact = (F.col("prompt_tokens").cast("decimal(20,0)") * price(0) + F.col("completion_tokens").cast("decimal(20,0)") * price(1)) / F.lit(1000000).cast("decimal(10,0)")
    return log.withColumn("cost", F.bround(exact.cast("decimal(24,12)"), 6).cast("decimal(18,6)"))


def reservation_bound(text: Column, price: str) -> Column:
    """UTF-8 bytes and 1024 more, priced per million, rounded up at eight places."""
    units = (F.octet_length(text) + 1024).cast("decimal(20,0)") * F.lit(price).cast("decimal(10,4)")
    return (F.ceil(units * 100).cast("decimal(20,0)") * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(18,8)")


def ledger_totals(ledger: DataFrame, by: list[str]) -> DataFrame:
    """What is settled, and what is reserved and not settled yet."""
    return ledger.groupBy(*by).agg(
        F.coalesce(F.sum("actual"), F.lit(0)).cast("decimal(24,8)").alias("spent"),
        F.coalesce(F.sum(F.when(F.col("actual").isNull(), F.col("amount"))), F.lit(0)).cast("decimal(24,8)").alias("reserved"),
    )


def remaining_allowance(totals: DataFrame, day: str, limit: float) -> DataFrame:
    """Of each day the scope that has used most, and what the limit leaves."""
    used = F.col("spent") + F.col("reserved")
    top = totals.withColumn("used", used).groupBy(day).agg(F.max_by("ip_digest", F.struct("used", "ip_digest")).alias("scope"), F.max("used").alias("used"))
    left = F.greatest(F.lit(0).cast("decimal(24,8)"), F.lit(str(limit)).cast("decimal(24,8)") - F.col("used"))
    return top.select(day, "scope", left.cast("decimal(24,8)").alias("remaining"), F.date_add(day, 1).alias("reset_day"))


def guest_import(ledger: DataFrame) -> DataFrame:
    """U8: allocations by ip, and by user where a reservation has a payer; no duplicates."""
    ip = ledger.select("reservation_id", F.concat(F.lit("ip:"), "ip_digest").alias("scope"))
    user = ledger.filter("payer is not null").select("reservation_id", F.concat(F.lit("user:"), F.col("payer").cast("string")).alias("scope"))
    return ip.unionByName(user).dropDuplicates(["reservation_id", "scope"])


def settlement(events: DataFrame) -> DataFrame:
    """The first actual amount of a reservation counts; conflicts and overruns are flagged."""
    first = F.min_by("actual", F.when(F.col("actual").isNotNull(), F.col("ts")))
    return events.groupBy("reservation_id").agg(first.alias("settled"), (F.count_distinct("actual") > 1).alias("conflict"), F.coalesce(first > F.max("amount"), F.lit(False)).alias("overrun"))


def admission_replay(ledger: DataFrame, limit: float) -> DataFrame:
    """U10, T5 in batch: admits in order of time while the amounts admitted so far and the new one stay within the limit.

    One group is a scope's day. Denied rows do not count, so each decision needs the one before; amounts
    are counted in whole units of 1e-8, so sums are exact.
    """
    most = int(round(limit * 10**8))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "reservation_id"])
        used, out = 0, []
        for x in pdf["units"]:
            used, ok = admission_step(used, int(x), most)
            out.append(ok)
        return pdf[["reservation_id"]].assign(admitted=out)

    units = (F.col("amount") * F.lit(10**8)).cast("long").alias("units")
    return ledger.select("day", "ip_digest", "ts", "reservation_id", units).groupBy("day", "ip_digest").applyInPandas(replay, "reservation_id long, admitted boolean")


def admission_step(used: int, amount: int, most: int) -> tuple[int, bool]:
    """What is used after a request, and whether it was admitted."""
    return (used + amount, True) if used + amount <= most else (used, False)


def ingest_status(docs: DataFrame) -> DataFrame:
    """Documents by status, queued bytes and restricted documents of each collection."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "ready", "failed")]
    queued = F.coalesce(F.sum(F.when(F.col("status").isin("pending", "processing"), F.col("size_bytes"))), F.lit(0))
    return docs.groupBy("collection").agg(*status, queued.alias("queued_bytes"), F.count_if(F.col("access_label") != "all").alias("restricted"))


def eta_seconds(docs: DataFrame, last: int = 20) -> DataFrame:
    """Queued bytes over the speed of the last ready documents, rounded up, at least 1."""
    recent = docs.filter("status = 'ready'").withColumn("n", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("processed_s"), F.desc("doc_id")))).filter(F.col("n") <= last)
    speed = recent.groupBy("collection").agg(F.sum("size_bytes").alias("b"), F.sum(F.col("processed_s") - F.col("created_s")).alias("s"))
    queued = ingest_status(docs).select("collection", "queued_bytes")
    rate = F.col("b") / F.nullif(F.col("s"), F.lit(0))
    return queued.join(speed, "collection", "left").select("collection", F.when(F.col("queued_bytes") > 0, F.greatest(F.lit(1), F.ceil(F.col("queued_bytes") / rate))).cast("long").alias("eta_s"))


def counts_per_collection(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents of each collection, 0 where there are none."""
    n = docs.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    return collections.join(n, "collection", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def restricted_labels(docs: DataFrame, by: str) -> DataFrame:
    """Labels other than ``all``, in order of privilege."""
    have = F.collect_set(F.when(F.col("access_label") != "all", F.col("access_label")))
    ordered = F.filter(F.array(*map(F.lit, LABELS)), lambda x: F.array_contains("have", x))
    return docs.groupBy(by).agg(have.alias("have")).select(by, F.array_join(ordered, ",").alias("labels"))


def listing_page(docs: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first, the id against ties, with the total."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    page = docs.orderBy(F.desc("created_s"), F.desc("doc_id")).offset(offset).limit(limit).select("doc_id", "created_s")
    return page.crossJoin(F.broadcast(total))  # one row


def passage_page(chunks: DataFrame, labels: list[str], around: int, limit: int) -> DataFrame:
    """U16: what a reader may see of each document in reading order, ``limit`` passages around one."""
    seen = chunks.filter(F.col("access_label").isin(labels))
    by = Window.partitionBy("document_id")
    pos = seen.withColumn("pos", F.row_number().over(by.orderBy("chunk_index", "chunk_id")) - 1).withColumn("before", F.count_if(F.col("chunk_index") < around).over(by))
    offset = F.greatest(F.lit(0), F.col("before") - limit // 3)
    return pos.filter((F.col("pos") >= offset) & (F.col("pos") < offset + limit)).select("document_id", "chunk_id", "pos")


def document_lock(docs: DataFrame, role_labels: DataFrame) -> DataFrame:
    """(document, role) pairs in which the document has a label the role lacks."""
    roles = role_labels.groupBy("role").agg(F.collect_set("label").alias("may"))
    return docs.crossJoin(F.broadcast(roles)).select("doc_id", "role", (~F.array_contains("may", F.col("access_label"))).alias("locked"))  # five roles


def storage_usage(docs: DataFrame, quota: int) -> DataFrame:
    """Bytes and documents of each tenant against a quota."""
    used = docs.groupBy("tenant").agg(F.sum("size_bytes").alias("used_bytes"), F.count(F.lit(1)).alias("documents"))
    return used.withColumn("over", F.col("used_bytes") > quota)


def orphan_originals(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored objects that no document names."""
    return stored.join(docs.select("tenant", "sha256").distinct(), ["tenant", "sha256"], "left_anti")


def recovery_sweep(docs: DataFrame, now: int, limit: int = 100) -> DataFrame:
    """Due pending rows and expired leases, oldest first, up to ``limit``."""
    due = ((F.col("status") == "pending") & (F.col("created_s") < now - 60)) | ((F.col("status") == "processing") & (F.col("created_s") < now - 660))
    return docs.filter(due).orderBy("created_s", "doc_id").limit(limit).select("doc_id", "status", "created_s")


def retry_schedule(docs: DataFrame, most: int = 4, base: int = 10) -> DataFrame:
    """When a failed document is tried again; none when its attempts are used up."""
    wait = (F.lit(base) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long")
    out = F.when((F.col("status") == "failed") & (F.col("attempts") >= 1) & (F.col("attempts") < most), F.col("processed_s") + wait)
    return docs.select("doc_id", "attempts", out.alias("next_attempt_s"), ((F.col("status") == "failed") & (F.col("attempts") >= most)).alias("exhausted"))


def auto_sync_due(sources: DataFrame, now: int) -> DataFrame:
    """Sources whose interval is over, or whose queued or partial run lost its lease."""
    due = (F.col("last_s") + F.col("interval_s") <= now) | (F.col("status").isin("queued", "partial") & (F.col("lease_s") < now))
    return sources.filter(due).select("source_id", "status")


def reprocess_selection(docs: DataFrame, collection: str, suffix: str) -> DataFrame:
    """Documents of a collection by the ending of their name."""
    return docs.filter((F.col("collection") == collection) & F.lower("filename").endswith(suffix.lower())).select("doc_id", "filename")


def visible_collections(collections: DataFrame, tenants: DataFrame, tenant: int) -> DataFrame:
    """A tenant's own collections, and public read-only ones of active service tenants."""
    service = tenants.filter("kind = 'service' and is_active").select(F.col("id").alias("tenant")).withColumn("service", F.lit(True))
    return collections.join(service, "tenant", "left").filter((F.col("tenant") == tenant) | (F.col("is_public") & F.col("read_only") & F.coalesce("service", F.lit(False)))).select("collection")


def slugify(name: Column, key: Column | None = None) -> Column:
    """Lower case, runs of other characters become one hyphen, none at the ends; where nothing is left a name made of ``key``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return slug if key is None else F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("collection-"), F.left(F.sha2(key.cast("string"), 256), F.lit(8))))


def tenure(log: DataFrame, limit: int) -> DataFrame:
    """T4 in batch: the first ``limit`` attempts of a scope and UTC day are admitted."""
    by = Window.partitionBy("user_id", F.to_date("created_at")).orderBy("created_at", "id")
    return log.select("id", (F.row_number().over(by) <= limit).alias("admitted"))


def fixed_window_attempts(log: DataFrame, seconds: int, limit: int) -> DataFrame:
    """T6 in batch: attempts of each user and window of ``seconds``, blocked above the limit."""
    period = F.floor(F.unix_timestamp("created_at") / seconds).cast("long")
    return log.groupBy("user_id", period.alias("period")).agg(F.count(F.lit(1)).alias("attempts")).withColumn("blocked", F.col("attempts") > limit)


def idempotent_replay(requests: DataFrame) -> DataFrame:
    """T7 in batch: within a key and a day the first request answers; another fingerprint conflicts."""
    by = Window.partitionBy("user_id", F.to_date("created_at")).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return requests.select("id", F.first("id").over(by).alias("first_id"), (F.first("model").over(by) != F.col("model")).alias("conflict"))


def lease_audit(events: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """Transitions of each key's log, how often they occur, and whether the state machine has them."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = events.select("user_id", "event_id", F.lag("event_type").over(by).alias("before"), F.col("event_type").alias("after"))
    known = F.concat_ws(">", "before", "after").isin([f"{a}>{b}" for a, b in legal])
    return step.filter("before is not null").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).withColumn("legal", known)
