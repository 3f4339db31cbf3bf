"""The change-only ledger as a stream (T1, T2, T8): keyed state in RocksDB, one event per change.

Replaying the whole history with ``availableNow`` gives the events of the batch form in palimpsest.operators.ledger, in whatever
batches and order its rows arrive, if they wait for as long as they may be late.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

_STATE = StructType([StructField(c, StringType()) for c in ("status", "stage", "evidence")] + [StructField(c, BooleanType()) for c in ("known", "missing", "frozen")])
_WAITING = StructType([StructField(c, StringType()) for c in ("observed_at", "event_id", "to_status", "stage", "url")] + [StructField("terminal", BooleanType()), StructField("at_ms", LongType())])
EVENT = StructType([StructField(c, StringType()) for c in ("id", "observed_at", "kind", "from_status", "to_status", "event_id")])


def _none(value):
    return None if value is None or value is pd.NA or value != value else value


class WatchProcessor(StatefulProcessor):
    """Holds the last real row of a key and emits the kinds of :func:`palimpsest.operators.ledger.event_kind`.

    With ``waits`` rows are kept in the state until the watermark has passed the latest of them, and only then applied in the order
    of their times: a row that arrives some batches late still finds its place. Without, each batch is applied as it comes.
    """

    def __init__(self, waits: bool = False):
        self._waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", _STATE)
        self._waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [_row(r) for batch in rows for r in batch.itertuples(index=False)]
        if not self._waits:
            yield self._apply(key, arrived)
            return
        self._waiting.appendList(arrived)
        self._handle.registerTimer(max(r[-1] for r in arrived) + 1)
        yield pd.DataFrame(columns=EVENT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self._waiting.get())
        later = [r for r in waiting if r[-1] > until]
        self._waiting.clear()
        if later:
            self._waiting.put(later)
        yield self._apply(key, [r for r in waiting if r[-1] <= until])

    def _apply(self, key, rows: list[tuple]) -> pd.DataFrame:
        state = self._last.get() if self._last.exists() else None
        status, stage, evidence, known, missing, frozen = state or (None, None, None, False, False, False)
        events = []
        for seen, _, *now, terminal, _ in sorted(rows, key=lambda r: r[:2]):
            if frozen:
                break
            gone = now[0] is None
            if not known:
                kind = "first_seen"
            elif gone:
                kind = None if missing else "source_missing"
            elif missing:
                kind = "source_restored"
            elif terminal:
                kind = "terminal"
            elif [status, stage] != now[:2]:
                kind = "status_changed"
            else:
                kind = "evidence_changed" if evidence != now[2] else None
            if kind:
                parts = [key[0], seen, status, stage, None if gone else now[0], None if gone else now[1]]
                digest = hashlib.sha256("|".join(p or "" for p in parts).encode()).hexdigest()
                events.append((key[0], seen, kind, status, now[0], "watch-" + digest[:24]))
            known, missing = True, gone
            if not gone:
                (status, stage, evidence), frozen = now, terminal
        self._last.update((status, stage, evidence, known, missing, frozen))
        return pd.DataFrame(events, columns=EVENT.names)

    def close(self) -> None:
        pass


def _row(r) -> tuple:
    return (r.observed_at, r.event_id, _none(r.to_status), _none(r.stage), _none(r.url), bool(_none(r.terminal)), int(r.at_ms))


def ledger_stream(rows: DataFrame, lateness: str | None = None) -> DataFrame:
    """A stream of watch rows (id, observed_at as text, event_id, to_status, stage, url, terminal) to ledger events.

    ``lateness``: how long rows wait for earlier ones (an interval such as '7 days'); the state then holds the rows of that span. A row
    that comes later still is applied when it comes, never dropped. None: rows count in the order of their batches.
    """
    timed = rows.withColumn("seen_at", F.to_timestamp("observed_at"))
    timed = timed.withWatermark("seen_at", lateness) if lateness else timed
    # Without its time column the operator has nothing to drop late rows by.
    slim = timed.withColumn("at_ms", F.unix_millis("seen_at")).drop("seen_at")
    return slim.groupBy("id").transformWithStateInPandas(WatchProcessor(bool(lateness)), EVENT, "append", "eventTime" if lateness else "none")


def closing_row(spark: SparkSession, schema: StructType) -> DataFrame:
    """A row of no key far in the future: written behind the last real rows it moves the watermark past all of them."""
    blank = {f.name: None for f in schema.fields} | {"id": "", "event_id": "", "observed_at": "9000-01-01 00:00:00"}
    return spark.createDataFrame([tuple(blank[f.name] for f in schema.fields)], schema)


def replay(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available and read its result; ``folder`` is new and shared by all executors.

    The sink is written by the stream's own commits, so a restarted run adds nothing twice.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    place = folder
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start(f"{place}/events")
    run.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{place}/events")
