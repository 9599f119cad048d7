"""Operators with typed state per key: status events on change, counts with retractions, the date gate.

State lives in RocksDB, so it may outgrow memory and a restart reads it back
from the checkpoint. Each operator keeps a bounded state a key and emits rows
in append mode. A key's rows of one micro-batch are put in order in memory;
the source's rate limit bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import text
from ledgerloom.operators.publication import clean_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; a checkpoint remembers it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _ordered(rows: Iterator[Row], order: list[str]) -> list[Row]:
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order))


class _StatusEvents(StatefulProcessor):
    """State: the fields last written, and what the last event said."""

    def __init__(self, keys: list[str], order: list[str], fields: list[str], state: str):
        self.order, self.fields, self.shape = order, fields, state
        self.row = Row(*keys, *order, *fields, "event", "substantive_change", "event_reason")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", self.shape)
        self.said = handle.getValueState("said", "sign string")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        self.written.update(tuple(initialState[f] for f in self.fields))
        if initialState["sign"] is not None:
            self.said.update((initialState["sign"],))

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Row]:
        was = tuple(self.written.get()) if self.written.exists() else None
        last = self.said.get()[0] if self.said.exists() else None
        for r in _ordered(rows, self.order):
            now = tuple(r[f] for f in self.fields)
            changed, sign = now != was, r["sign"]
            if sign is None:
                reason = "not_requested"
            elif not changed:
                reason = "skipped_no_substantive_record_change"
            elif sign == last:
                reason = "skipped_latest_status_event_equivalent"
            else:
                reason, last = "applied_substantive_record_change", sign
            was = now
            yield self.row(*key, *(r[c] for c in self.order), *now, r["event"], changed, reason)
        self.written.update(was)
        if last is not None:
            self.said.update((last,))

    def close(self) -> None:
        pass


def _signed(rows: DataFrame, event: Column) -> DataFrame:
    """With ``event`` in public words and ``sign``, what it says (null without an event)."""
    clean = F.get(clean_events(F.array(event)), F.lit(0))
    sign = F.concat_ws("|", text.collapse(F.lower(clean["label"])), text.collapse(F.lower(clean["note"])))
    return rows.withColumn("sign", F.when(event.isNotNull(), sign)).withColumn("event", F.when(event.isNotNull(), clean))


def status_events(proposed: DataFrame, keys: list[str], order: list[str], fields: list[str], stored: DataFrame | None = None) -> DataFrame:
    """What :func:`~ledgerloom.operators.publication.write_plan` decides, for a stream of proposals.

    ``proposed`` has the keys, ``order``, the fields and ``event`` (``at, label,
    note``, or null). The first proposal of a key that ``stored`` (keys, fields
    and ``event``, its latest one) does not hold is a change. Each row comes
    back with ``substantive_change`` and ``event_reason``; an event is added
    where that is ``applied_substantive_record_change``.
    """
    shape = _types(proposed, fields)
    out = f"{_types(proposed, [*keys, *order, *fields])}, event struct<at:string,label:string,note:string>, substantive_change boolean, event_reason string"
    rows = _signed(proposed, F.col("event")).select(*keys, *order, *fields, "event", "sign")
    start = None
    if stored is not None:
        start = _signed(stored, F.col("event")).select(*keys, *fields, "sign").groupBy(*keys)
    return rows.groupBy(*keys).transformWithState(_StatusEvents(keys, order, fields, shape), out, "Append", "None", start)


class _Rollover(StatefulProcessor):
    """State: the identity that counts, and the evidence held of every identity."""

    def __init__(self, keys: list[str], order: list[str], identity: str, is_evidence: str, kind: str):
        self.order, self.identity, self.is_evidence, self.kind = order, identity, is_evidence, kind
        self.row = Row(*keys, *order, identity, "delta", "change")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", f"identity {self.kind}")
        self.held = handle.getMapState("held", f"identity {self.kind}", "n long")

    def _count(self, identity: Any) -> int:
        return self.held.getValue((identity,))[0] if self.held.containsKey((identity,)) else 0

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Row]:
        now = self.current.get()[0] if self.current.exists() else None
        began, deltas, counts = now, [], {}
        count = lambda i: counts[i] if i in counts else counts.setdefault(i, self._count(i))
        for r in _ordered(rows, self.order):
            at, identity = tuple(r[c] for c in self.order), r[self.identity]
            if identity is None:
                continue
            if r[self.is_evidence]:
                counts[identity] = count(identity) + 1
                if identity == now:
                    deltas.append((at, identity, 1, "counted"))
            elif identity != now:
                if now is not None and count(now):
                    deltas.append((at, now, -count(now), "retracted"))
                if count(identity):
                    deltas.append((at, identity, count(identity), "restored"))
                now = identity
        for identity, n in counts.items():
            if n:
                self.held.updateValue((identity,), (n,))
        if now != began:
            self.current.update((now,))
        for at, identity, delta, why in deltas:
            yield self.row(*key, *at, identity, delta, why)

    def close(self) -> None:
        pass


def rollover_deltas(stream: DataFrame, keys: list[str], order: list[str], identity: str, is_evidence: str) -> DataFrame:
    """Signed changes of the number of reports that count: ``delta`` and ``change`` (counted, retracted, restored).

    The stream has reports (``is_evidence``) of an identity of a record, and
    rows that set the identity of the record from then on. Only reports of the
    present identity count: when it advances, one negative row takes all of the
    old one's out, and those that arrived early for the new one come in; nothing
    is recomputed. The sum of all deltas is the count of a full recompute. Null
    identities are left out.
    """
    kind = dict(stream.dtypes)[identity]
    out = f"{_types(stream, [*keys, *order])}, `{identity}` {kind}, delta long, change string"
    rows = stream.select(*keys, *order, identity, is_evidence)
    return rows.groupBy(*keys).transformWithState(_Rollover(keys, order, identity, is_evidence, kind), out, "Append", "None")


class _DateGate(StatefulProcessor):
    """State: the reports that came too early, until the watermark is ``remember_ms`` past their arrival."""

    def __init__(self, keys: list[str], order: list[str], report: str, kind: str, remember_ms: int):
        self.order, self.report, self.kind, self.remember_ms = order, report, kind, remember_ms
        self.row = Row(*keys, *order, report, "verdict")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", f"report {self.kind}", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Row]:
        timers = set()
        for r in _ordered(rows, self.order):
            report, verdict = (r[self.report],), r["dated"]
            if report[0] is not None:
                if self.early.containsKey(report):
                    verdict = "early" if verdict == "early" else "early_before"
                elif verdict == "early":
                    until = r["arrived_ms"] + self.remember_ms
                    self.early.updateValue(report, (until,))
                    timers.add(until)
            yield self.row(*key, *(r[c] for c in self.order), r[self.report], verdict)
        for until in timers:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for report, until in list(self.early.iterator()):
            if until[0] <= now:
                self.early.removeKey(report)
        return iter(())

    def close(self) -> None:
        pass


def date_gate(
    reports: DataFrame, releases: DataFrame, keys: list[str], order: list[str], report: str, dated: str, released: str, arrived: str, delay: str = "30 days", remember_days: int = 365
) -> DataFrame:
    """Each report with its ``verdict``: accepted, early, early_before or unknown_date.

    A report dated before its release (a static table of the keys) is early and
    never opened again: if it comes back with another date it is early_before.
    There is no bound on how late a report may be dated. ``arrived`` is the event
    time: rows that arrive out of order by more than ``delay`` are dropped by
    the watermark (Spark counts them), and what is known of an early report is
    forgotten ``remember_days`` after its arrival, which bounds the state.
    """
    kind = dict(reports.dtypes)[report]
    gate = (
        F.when(F.col(dated).isNull() | F.col(released).isNull(), "unknown_date").when(F.col(dated) < F.col(released), "early").otherwise("accepted")
    )
    rows = reports.withWatermark(arrived, delay).join(releases, keys, "left")
    rows = rows.select(*keys, *order, report, gate.alias("dated"), F.unix_millis(F.col(arrived)).alias("arrived_ms"), *([] if arrived in order else [arrived]))
    out = f"{_types(rows, [*keys, *order])}, `{report}` {kind}, verdict string"
    return rows.groupBy(*keys).transformWithState(_DateGate(keys, order, report, kind, remember_days * 86_400_000), out, "Append", "EventTime")


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Run over what has arrived, appending to a Parquet folder whose log commits each batch once."""
    with rocksdb(stream.sparkSession):
        run = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


