"""Streams with a state for each key: label events with human precedence, and first arrivals.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which the caller's session names.
State is kept by key and restored from the query's checkpoint. With ``keep_ms`` a key untouched for so long (processing
time) is forgotten: a later event then starts anew, so the limit is to be longer than events can be late or repeated. Such a query keeps asking for the time, so it never runs
dry: give it a trigger that ends or stop it, not ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.durable import ship
from ..operators.store import label_errors

_LABEL = "label string, label_source string, confidence double, note string, rationale string, signals string"
_FIELDS = ("label", "label_source", "confidence", "note", "rationale", "signals")
#: Times are kept in microseconds.
_PLACED = f"at long, ordinal long, {_LABEL}"
_STATE = f"created_at long, strong struct<{_PLACED}>, latest struct<{_PLACED}>"


class _Labels(StatefulProcessor):
    """The last event that binds (of a human, or overwriting one) and the last of all: which of them stands follows, in whatever order they came."""

    def __init__(self, keys: list[str], keep_ms: int | None):
        self.keys, self.keep_ms = keys, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("label", _STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        created, strong, latest = (known[0], known[1], known[2]) if known is not None else (None, None, None)
        before, out = self._standing(strong, latest), []
        place = lambda r: (r[0], r[1])
        for r in rows:
            if r.error is not None:
                out.append(self._row(key, "refused", r.error, r.at, r.ordinal, None, None, None))
                continue
            event = (r.at, r.ordinal, *[r[f] for f in _FIELDS])
            created = r.at if created is None else min(created, r.at)
            if latest is None or place(event) > place(latest):
                latest = event
            if (r.label_source == "human" or r.overwrite_human) and (strong is None or place(event) > place(strong)):
                strong = event
        if latest is not None:
            now = self._standing(strong, latest)
            new = (created, tuple(strong) if strong is not None else None, tuple(latest))
            if known is None or new != (known[0], tuple(known[1]) if known[1] is not None else None, tuple(known[2])):
                self.state.update(new)
            if before is None or tuple(now) != tuple(before) or created != known[0]:
                out.append(self._row(key, "label", None, now[0], now[1], now, created, now[0]))
        yield from out

    def _standing(self, strong, latest):
        return strong if strong is not None and strong[3] == "human" else latest

    def _row(self, key, kind: str, reason, at, ordinal, event, created, updated) -> Row:
        values = event[2:] if event is not None else (None,) * len(_FIELDS)
        return Row(*self.keys, "kind", "reason", "at", "ordinal", *_FIELDS, "created_at", "updated_at")(*key, kind, reason, at, ordinal, *values, created, updated)

    def close(self) -> None:
        pass


def label_stream(stream: DataFrame, keys: list[str], keep_ms: int | None = None) -> DataFrame:
    """The label of each key that a batch changed, and the events refused; what ``store.apply_labels`` gives of all valid events so far.

    Events: keys, label, label_source, confidence, overwrite_human, at (timestamp), ordinal, and note, rationale, signals if
    there. Returned: keys, kind (``label`` or ``refused``), reason (of a refusal), at, ordinal, the label's columns,
    created_at, updated_at. Late events take their place by (at, ordinal), repeated ones change nothing. An event without a
    time or ordinal is refused. Update mode.
    """
    ship(stream.sparkSession)
    text = lambda c: F.lower(F.trim(c))
    error = F.coalesce(label_errors(), F.when(F.col("at").isNull() | F.col("ordinal").isNull(), "no_place"))
    rest = [F.col(c).cast("string").alias(c) if c in stream.columns else F.lit(None).cast("string").alias(c) for c in ("note", "rationale", "signals")]
    events = stream.select(*keys, F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("ordinal").cast("long").alias("ordinal"), text("label").alias("label"), text("label_source").alias("label_source"), F.col("confidence").cast("double").alias("confidence"), F.coalesce("overwrite_human", F.lit(False)).alias("overwrite_human"), *rest, error.alias("error"))
    schema = f"{', '.join(f'`{k}` {stream.schema[k].dataType.simpleString()}' for k in keys)}, kind string, reason string, {_PLACED}, created_at long, updated_at long"
    out = events.groupBy(*keys).transformWithState(statefulProcessor=_Labels(keys, keep_ms), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if keep_ms else "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "created_at", "updated_at")})


class _First(StatefulProcessor):
    """Lets a key's first row through, by the order columns within a batch."""

    def __init__(self, order: list[str], keep_ms: int | None):
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in self.order], default=None)
        if first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, keys: list[str], order: list[str], keep_ms: int | None = None) -> DataFrame:
    """The first row of each key, once for the whole stream; within a batch the least by ``order`` (nulls first). Append mode.

    Unlike ``incremental.append_items`` no batch reads what was written before: what is known of a key is its state.
    """
    ship(stream.sparkSession)
    return stream.groupBy(*keys).transformWithState(statefulProcessor=_First(order, keep_ms), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")
