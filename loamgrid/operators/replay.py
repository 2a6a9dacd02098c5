"""Decisions that depend on those before them, replayed in order of time: budgets (U10, T5) and idempotent requests.

Rows of a group are dealt to one task, sorted there and read one after the other, so a task holds the
state of a group and never its rows. A group is as small as the rule allows: a key, or the scopes of a
day that some request ties together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch

UNITS = 10**8  # of one currency unit; sums of whole units are exact


def in_order(rows: DataFrame, group: list[str], order: list[str], fresh: Callable[[], Any], step: Callable, schema: str) -> DataFrame:
    """``step(state, row)`` for each row in order, with a state of ``fresh()`` for each group; its results are the rows of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            out = []
            for key, x in zip(zip(*(f[g] for g in group)), f.itertuples(index=False)):
                if key != now:
                    now, state = key, fresh()
                out.append(step(state, x))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


# Budgets


class Book(dict):
    """A mapping that gives a default without keeping it. Streams put one of stored state in its place."""

    def read(self, key: str, default: Any) -> Any:
        return self.get(key, default)

    def put(self, key: str, value: Any) -> None:
        self[key] = value


class Ledger:
    """What the scopes of a day have spent and reserved.

    A request belongs to the scope of its address and, with an account, to the account's as well. An
    account answers also for the requests that its address made that day without one: they come into its
    scope when it asks, and stay there only if it is admitted. Amounts are whole units.
    """

    def __init__(self, most: int, totals: Any = None, spent: Any = None, guests: Any = None):
        self.most = most
        #: Units of each scope; (value, reserved, settled, scopes) of each admitted request; requests without account of each address.
        self.totals, self.spent, self.guests = (Book() if x is None else x for x in (totals, spent, guests))

    def reserve(self, key: str, ip: str, payer: str | None, units: int) -> str:
        """``admitted`` if no scope goes over the limit, else ``denied``."""
        scopes = [f"ip:{ip}"] + ([] if payer is None else [f"user:{payer}"])
        after = {x: self.totals.read(x, 0) for x in scopes}
        new = []
        if payer is not None:
            for g in self.guests.read(ip, []):
                value, reserved, settled, own = self.spent.read(g, None)
                if scopes[1] not in own:
                    new.append((g, (value, reserved, settled, [*own, scopes[1]])))
                    after[scopes[1]] += value
        if any(v + units > self.most for v in after.values()):
            return "denied"
        for g, row in new:
            self.spent.put(g, row)
        for x, v in after.items():
            self.totals.put(x, v + units)
        self.spent.put(key, (units, units, False, scopes))
        if payer is None:
            self.guests.put(ip, [*self.guests.read(ip, []), key])
        return "admitted"

    def settle(self, key: str, units: int | None) -> str:
        """The first known amount takes the place of what was reserved, in every scope that answers for it."""
        row = self.spent.read(key, None)
        if row is None:
            return "missing"
        value, reserved, settled, scopes = row
        if units is None:
            return "unknown"
        if settled:
            return "repeated" if units == value else "conflict"
        for x in scopes:
            self.totals.put(x, self.totals.read(x, 0) + units - value)
        self.spent.put(key, (units, reserved, True, scopes))
        return "overrun" if units > reserved else "settled"

    def step(self, x: Any) -> tuple[Any, str, str]:
        """(id, kind, outcome) of one event."""
        units = None if pd.isna(x.units) else int(x.units)
        if x.kind == "settle":
            return x.id, x.kind, self.settle(str(x.id), units)
        return x.id, x.kind, self.reserve(str(x.id), x.ip, None if pd.isna(x.payer) else x.payer, units)


def budget_events(reserved: DataFrame, settled: DataFrame) -> DataFrame:
    """(day, id, ts, kind, ip, payer, units) of ``reserved(id, day, ts, ip, payer, amount)`` and ``settled(id, ts, amount)``.

    A settlement belongs to the day and address of its reservation, whenever it comes; at one moment
    reservations come first.
    """
    units = (F.col("amount").cast("decimal(18,8)") * F.lit(UNITS)).cast("long").alias("units")
    asks = reserved.select("day", "id", "ts", F.lit("reserve").alias("kind"), "ip", F.col("payer").cast("string").alias("payer"), units)
    known = settled.select("id", F.col("ts").alias("at"), units).join(asks.select("id", "day", "ip", "payer"), "id")
    return asks.unionByName(known.select("day", "id", F.col("at").alias("ts"), F.lit("settle").alias("kind"), "ip", "payer", "units"))


def scope_groups(events: DataFrame) -> DataFrame:
    """(day, ip, group): the smallest of the addresses that a day's requests tie together.

    An account that asks from two addresses ties them. Each round gives every address the smallest label
    among those it is tied to, then that label's own; rounds end when no label changes, after about the
    logarithm of the longest chain. Every round is written, so none recomputes the ones before.
    """
    s = Scratch(events.sparkSession, "groups")
    uses = s.keep(events.filter("kind = 'reserve'").select("day", "ip", "payer").distinct(), "uses")
    tied = uses.filter("payer is not null")
    labels = s.keep(uses.select("day", "ip", F.col("ip").alias("group")).distinct(), "labels")
    while True:
        near = tied.join(labels, ["day", "ip"]).groupBy("day", "payer").agg(F.min("group").alias("least"))
        best = tied.join(near, ["day", "payer"]).groupBy("day", "ip").agg(F.min("least").alias("least"))
        new = labels.join(best, ["day", "ip"], "left").select("day", "ip", "group", F.least("group", F.coalesce("least", "group")).alias("new"))
        up = new.select("day", F.col("ip").alias("new"), F.col("new").alias("above"))
        new = s.keep(new.join(up, ["day", "new"]).select("day", "ip", "group", F.least("new", "above").alias("new")), "labels")
        changed = new.filter("`group` <> new").limit(1).count()
        labels = new.select("day", "ip", F.col("new").alias("group"))
        if not changed:
            return s.finish(labels)


def budget_replay(events: DataFrame, limit: float) -> DataFrame:
    """U10 with both scopes: (id, kind, outcome) of every event, in order of time within a day's group of scopes."""
    most = round(limit * UNITS)
    rows = events.join(scope_groups(events), ["day", "ip"]).withColumn("turn", F.when(F.col("kind") == "reserve", 0).otherwise(1))
    kind = events.schema["id"].dataType.simpleString()
    return in_order(rows, ["day", "group"], ["ts", "turn", "id"], lambda: Ledger(most), Ledger.step, f"id {kind}, kind string, outcome string")


# Idempotent requests


class Remembered:
    """The request that a key's answers come from, until its time is over. A failed request is not remembered."""

    def __init__(self, first: Any = None, fingerprint: str | None = None, until: float = float("-inf")):
        self.first, self.fingerprint, self.until = first, fingerprint, until

    def ask(self, key: Any, at: float, fingerprint: str | None, failed: bool, ttl: float) -> tuple[Any, str]:
        """(id of the request whose answer counts, what became of this one)."""
        if at >= self.until:
            if failed:
                return key, "failed"
            self.first, self.fingerprint, self.until = key, fingerprint, at + ttl
            return key, "first"
        # A request without a fingerprint is bound to none.
        return (self.first, "replayed") if fingerprint is None or fingerprint == self.fingerprint else (self.first, "conflict")


def idempotent_requests(requests: DataFrame, ttl: float = 86400) -> DataFrame:
    """(id, first_id, outcome) of ``requests(key, id, at, fingerprint, failed)``; ``at`` is in seconds.

    The first request of a key answers for ``ttl`` seconds: the same request gets its answer again,
    another one conflicts. The first one after that begins anew, so windows start at requests and not
    at days.
    """
    kind = requests.schema["id"].dataType.simpleString()

    def step(state: Remembered, x: Any) -> tuple[Any, Any, str]:
        first, outcome = state.ask(x.id, x.at, None if pd.isna(x.fingerprint) else x.fingerprint, bool(x.failed), ttl)
        return x.id, first, outcome

    return in_order(requests, ["key"], ["at", "id"], Remembered, step, f"id {kind}, first_id {kind}, outcome string")
