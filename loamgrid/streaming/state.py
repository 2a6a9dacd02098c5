"""Streams with typed state of their own for each key, removed by timers of event time.

State lives in the state store of the checkpoint, so a stream goes on after a restart where it was. Each
processor hands the decision to the class that the batch form uses (``operators.replay``). Within a
micro-batch a key's rows are taken in order of time; timers run when the watermark has passed them.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loamgrid.operators.replay import Ledger, Remembered, UNITS
from loamgrid.streaming.ops import DeltaAssembly, bucket_step

CHUNK = 20_000  # rows that are objects at a time
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that typed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _chunks(rows: Iterator[Any], n: int = CHUNK) -> Iterator[list]:
    """Rows in lists of ``n``: results leave the task as they are made."""
    while some := list(itertools.islice(rows, n)):
        yield some


def _sorted(frames: Iterator[pd.DataFrame], *by: str) -> Iterator[Any]:
    """The rows of a key in order. They are held as columns, never as a sorted copy or as objects."""
    whole = pd.concat(list(frames), ignore_index=True)
    order = np.lexsort([whole[c].to_numpy() for c in reversed(by)])
    for i in range(0, len(order), CHUNK):
        yield from whole.take(order[i : i + CHUNK]).itertuples(index=False)


class _Timed(StatefulProcessor):
    """Keeps one timer for a key: the time at which its state may go."""

    states: dict[str, str] = {}
    columns: list[str] = []

    def init(self, handle: Any) -> None:
        self.handle = handle
        for name, schema in self.states.items():
            setattr(self, name, handle.getValueState(name, schema))

    def at(self, seconds: float) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(seconds * 1000))

    def frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, late: str, key: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Answers(_Timed):
    states = {"assembly": "phase string, held string, section string, seq long"}
    columns = ["query_id", "seq", "visible", "refused", "section", "ended"]

    def __init__(self, patience: float):
        self.patience = patience

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.assembly.get() if self.assembly.exists() else None
        a, out, ended, last = DeltaAssembly(*old[:3]) if old else DeltaAssembly(), [], False, 0.0
        for x in _sorted(rows, "seq"):
            ended, last = ended or bool(x.last), max(last, x.ts.timestamp())
            out.append((key[0], x.seq, a.feed(x.text or "", bool(x.last)), a.refused, a.section if x.last else None, "last" if x.last else None))
        if ended:
            self.assembly.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            self.assembly.update((a.phase, a.held, a.section, out[-1][1]))
            self.at(last + self.patience)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """An answer that goes on no more is ended as it is."""
        if self.assembly.exists():
            phase, held, section, seq = self.assembly.get()
            a = DeltaAssembly(phase, held, section)
            text = a.feed("", True)
            self.assembly.clear()
            yield self.frame([(key[0], seq + 1, text, a.refused, a.section, "timeout")])


def answer_deltas(deltas: DataFrame, patience: float = 600, late: str = "1 minute") -> DataFrame:
    """(query_id, seq, visible, refused, section, ended) of ``deltas(query_id, seq, ts, text, last)``.

    ``visible`` is what may be shown with each piece. The last one, or a timer ``patience`` seconds after
    a piece that none followed, gives out the section of quotes and removes the state.
    """
    schema = "query_id long, seq long, visible string, refused boolean, section string, ended string"
    return _run(deltas, late, ["query_id"], _Answers(patience), schema)


class _Buckets(_Timed):
    states = {"bucket": "tokens double, at double"}
    columns = ["id", "admitted", "retry_after"]

    def __init__(self, per_minute: float):
        self.per_minute = per_minute

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tokens, at = self.bucket.get() if self.bucket.exists() else (self.per_minute, 0.0)
        for some in _chunks(_sorted(rows, "ts", "id")):
            out = []
            for x in some:
                tokens, at, ok, wait = bucket_step(tokens, at, x.ts.timestamp(), self.per_minute)
                out.append((x.id, ok, wait))
            yield self.frame(out)
        self.bucket.update((float(tokens), float(at)))
        self.at(at + 60)  # a bucket is full by then

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())


def limited_requests(requests: DataFrame, per_minute: float, late: str = "1 minute") -> DataFrame:
    """(id, admitted, retry_after) of ``requests(key, id, ts)``; a bucket idle for a minute is full and is forgotten."""
    return _run(requests, late, ["key"], _Buckets(per_minute), "id long, admitted boolean, retry_after long")


class _Stored:
    """A map of stored state in the place of a ``Book``; values are tuples of its schema's fields.

    What a batch has read or changed is held, and written once at its end: a call to the state store costs
    far more than a decision, and most decisions change nothing.
    """

    def __init__(self, state: Any, wrap: Any, unwrap: Any):
        self.state, self.wrap, self.unwrap = state, wrap, unwrap

    def begin(self) -> None:
        self.held: dict = {}
        self.changed: set = set()
        self.any = self.state.exists()

    def read(self, key: str, default: Any) -> Any:
        if key not in self.held and self.any and self.state.containsKey((key,)):
            self.held[key] = self.unwrap(self.state.getValue((key,)))
        return self.held.get(key, default)

    def put(self, key: str, value: Any) -> None:
        self.held[key] = value
        self.changed.add(key)

    def end(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.wrap(self.held[key]))
        self.held, self.changed = {}, set()


class _Budgets(_Timed):
    columns = ["id", "kind", "outcome"]

    def __init__(self, most: int, grace: float):
        self.most, self.grace = most, grace

    def init(self, handle: Any) -> None:
        super().init(handle)
        one, many = (lambda v: (v,)), (lambda v: (list(v),))
        self.maps = {
            "totals": _Stored(handle.getMapState("totals", "scope string", "units long"), one, lambda v: v[0]),
            "spent": _Stored(handle.getMapState("spent", "id string", "value long, reserved long, settled boolean, scopes array<string>"), lambda v: (*v[:3], list(v[3])), lambda v: (*v[:3], list(v[3]))),
            "guests": _Stored(handle.getMapState("guests", "ip string", "ids array<string>"), many, lambda v: list(v[0])),
        }

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for x in self.maps.values():
            x.begin()
        ledger = Ledger(self.most, **self.maps)
        for some in _chunks(_sorted(rows, "ts", "turn", "id")):
            yield self.frame([ledger.step(x) for x in some])
        for x in self.maps.values():
            x.end()
        self.at((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).tz_localize("UTC").timestamp() + self.grace)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """A day's budget ended at midnight, and what was open has been settled or stays reserved."""
        for x in self.maps.values():
            x.state.clear()
        return iter(())


def budget_decisions(events: DataFrame, limit: float, late: str = "1 hour", grace: float = 6 * 3600) -> DataFrame:
    """T5: (id, kind, outcome) of ``events(day, group, id, ts, kind, ip, payer, units)``, kinds and fields as in ``budget_events``.

    ``group`` names addresses that accounts tie together, such as ``scope_groups`` finds them in what is
    known; requests of one group share a state. A timer ``grace`` seconds after midnight removes a day's
    state: until then requests of the day may be settled.
    """
    rows = events.withColumn("turn", F.when(F.col("kind") == "reserve", 0).otherwise(1))
    return _run(rows, late, ["day", "group"], _Budgets(round(limit * UNITS), grace), "id long, kind string, outcome string")


class _Requests(_Timed):
    states = {"kept": "first long, fingerprint string, until double"}
    columns = ["id", "first_id", "outcome"]

    def __init__(self, ttl: float):
        self.ttl = ttl

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        r = Remembered(*self.kept.get()) if self.kept.exists() else Remembered()
        for some in _chunks(_sorted(rows, "ts", "id")):
            yield self.frame([(x.id, *r.ask(int(x.id), x.ts.timestamp(), None if pd.isna(x.fingerprint) else x.fingerprint, bool(x.failed), self.ttl)) for x in some])
        if r.first is not None:
            self.kept.update((int(r.first), r.fingerprint, float(r.until)))
            self.at(r.until)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())


def idempotent_stream(requests: DataFrame, ttl: float = 86400, late: str = "1 hour") -> DataFrame:
    """T7 as a stream of ``requests(key, id, ts, fingerprint, failed)``; a key is forgotten when its time is over."""
    return _run(requests, late, ["key"], _Requests(ttl), "id long, first_id long, outcome string")
