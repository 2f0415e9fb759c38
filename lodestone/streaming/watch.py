"""File events as a stream: pauses close a batch, the last event of a file counts, and a batch is applied at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The pause after which pending events are handled.
DEBOUNCE = "500 milliseconds"


def _sessions(events: DataFrame, at: str, pause_seconds: float, key: str) -> DataFrame:
    """events with `batch`, the number of their session within its key: a session ends with a pause."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w)) > int(pause_seconds * 1_000_000)
    marked = events.withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int"))
    return marked.withColumn("batch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def debounced(events: DataFrame, key: str, at: str = "ts", pause_seconds: float = 0.5) -> DataFrame:
    """(opened, closed, key, at, path, event_type): a table's events with the session that they fall into.

    Each event opens or prolongs a session of its key, for instance of its project. No session is gathered.
    """
    s = _sessions(events, at, pause_seconds, key)
    own = Window.partitionBy(key, "batch")
    return s.select(F.min(at).over(own).alias("opened"), F.max(at).over(own).alias("closed"), F.col(key).alias("key"), F.col(at).alias("at"), "path", "event_type")


def last_of_batch(batch: DataFrame) -> DataFrame:
    """(opened, closed, key, path, event_type, events): of each batch and path the last event."""
    return batch.groupBy("opened", "closed", "key", "path").agg(F.max_by("event_type", F.struct("at", "event_type")).alias("event_type"), F.count(F.lit(1)).alias("events"))


def batches_of_table(events: DataFrame, key: str, at: str = "ts", pause_seconds: float = 0.5) -> DataFrame:
    """(key, batch, first, last, events): the sessions of a table."""
    return _sessions(events, at, pause_seconds, key).groupBy(key, "batch").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events"))


#: Pending paths of a key beyond which they are handled without waiting for a pause.
PENDING = 100_000


def pending_events(events: DataFrame, pause: str = DEBOUNCE, key: str | None = None) -> DataFrame:
    """(key, path, event_type) of a stream: once no event of a key has come for `pause`, the last event of each of its paths.

    The state holds one entry a pending path, not one an event, and PENDING at most. Time is that of processing, as a watcher
    has it. Within one moment a deletion counts as the later.
    """
    milliseconds = int(float(pause.split()[0]) * {"m": 1, "s": 1000}[pause.split()[1][0]])
    src = events.select((F.col(key).cast("string") if key else F.lit("all")).alias("key"), "path", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("seq").cast("bigint") if "seq" in events.columns else F.lit(0).cast("bigint")).alias("s"))
    schema = "key string, path string, event_type string"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, *values = state.get if state.exists else ([], [], [], [])
        held = dict(zip(paths, zip(*values)))
        if not state.hasTimedOut:
            for pdf in batches:
                for path, kind, t, s in zip(pdf["path"], pdf["event_type"], pdf["t"].tolist(), pdf["s"].tolist()):
                    old = held.get(path)
                    if old is None or (t, s, kind == "delete") >= (old[1], old[2], old[0] == "delete"):
                        held[path] = (kind, t, s)
            if len(held) < PENDING:
                paths = list(held)
                state.update((paths, [held[p][0] for p in paths], [held[p][1] for p in paths], [held[p][2] for p in paths]))
                state.setTimeoutDuration(milliseconds)
                return
        if state.exists:
            state.remove()
        if held:
            yield pd.DataFrame([(name[0], p, v[0]) for p, v in held.items()], columns=["key", "path", "event_type"])

    return src.groupBy("key").applyInPandasWithState(step, schema, "paths array<string>, kinds array<string>, t array<bigint>, s array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run(events: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, trigger: str | None = None, pause: str = DEBOUNCE, key: str | None = None) -> StreamingQuery:
    """Apply events in batches: apply(changed, deleted), two tables of paths, of which a path is in one only.

    With a trigger the stream is live: events wait until none has come for `pause`, see pending_events(), and are then applied
    at once. Without one, all that is there is applied and the query ends. The checkpoint gives each event at least once;
    apply is a replacement by path, so a repeated batch changes nothing. Events have path, event_type ('delete' deletes), ts,
    and optionally seq.
    """
    order = F.struct("ts", "seq") if "seq" in events.columns else F.struct("ts", "event_type")

    def handle(batch: DataFrame, _: int) -> None:
        last = (batch if trigger else batch.groupBy("path").agg(F.max_by("event_type", order).alias("event_type"))).persist()
        try:
            if not last.isEmpty():
                apply(last.where("event_type <> 'delete'").select("path"), last.where("event_type = 'delete'").select("path"))
        finally:
            last.unpersist()

    src = pending_events(events, pause, key) if trigger else events
    writer = src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
