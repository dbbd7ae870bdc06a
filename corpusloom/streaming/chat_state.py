"""Conversations as a stream: the history of each is keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
OUTPUT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("n_messages", T.LongType()),
    T.StructField("context_tokens", T.LongType()),
    T.StructField("messages", T.StringType()),
    T.StructField("status", T.StringType()),
])
#: Role of a row that makes its conversation forget what was said before.
RESET = "reset"


def conversation_processor(patience_ms: int | None = None, idle_ms: int | None = None) -> StatefulProcessor:
    """The stateful operator. It is a local class so that it travels by value to every worker."""

    class ConversationState(StatefulProcessor):
        """Appends every message; for a user message emits the request it sends: all messages so far, as JSON.

        The history is read back only in batches with a user message. A null text counts as empty. A row that comes after a later
        turn of its conversation was handled is reported as ``late`` and changes nothing.

        Without patience, the turns of a batch are handled as they are. With it, turns are numbered from 0, and one whose
        predecessor is missing waits: until the gap closes, or for ``patience_ms`` after the last arrival, when the waiting
        turns go on in order. Of rows that repeat a waiting turn the last counts. A conversation that says nothing
        for ``idle_ms`` is forgotten.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.history = handle.getListState("history", MESSAGE)
            self.totals = handle.getValueState("totals", "last long, messages long, tokens long")
            if patience_ms is not None or idle_ms is not None:
                self.waiting = handle.getMapState("waiting", "turn long", "role string, text string")
                self.seen = handle.getValueState("seen", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("turn", kind="stable")
            texts = batch["text"].where(batch["text"].notna(), "")
            said = list(zip(batch["turn"].tolist(), batch["role"], texts, strict=True))
            if patience_ms is not None:
                last = self.totals.get()[0] if self.totals.exists() else -1
                for turn, role, text in said:
                    if turn > last:
                        self.waiting.updateValue((turn,), (role, text))
                said = [row for row in said if row[0] <= last]
                while self.waiting.containsKey((last + 1,)):
                    last += 1
                    said.append((last, *self.waiting.getValue((last,))))
                    self.waiting.removeKey((last,))
            yield self._handle(key, said)
            if patience_ms is not None or idle_ms is not None:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.seen.update((now,))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if patience_ms is not None and any(True for _ in self.waiting.keys()):
                    self.handle.registerTimer(now + patience_ms)
                if idle_ms is not None:
                    self.handle.registerTimer(now + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            said = sorted((turn, role, text) for (turn,), (role, text) in self.waiting.iterator())
            self.waiting.clear()
            yield self._handle(key, said)
            if idle_ms is not None and timerValues.getCurrentProcessingTimeInMs() >= self.seen.get()[0] + idle_ms:
                for state in (self.history, self.totals, self.seen):
                    state.clear()

        def _handle(self, key, rows: list[tuple]) -> pd.DataFrame:
            last, messages, tokens = self.totals.get() if self.totals.exists() else (None, 0, 0)
            said = None
            out = []
            for turn, role, text in rows:
                if last is not None and turn <= last:
                    out.append((key[0], turn, None, None, None, "late"))
                    continue
                last = turn
                if role == RESET:
                    self.history.clear()
                    said, messages, tokens = [], 0, 0
                    continue
                if role == "user":
                    if said is None:
                        said = [{"role": r, "content": c} for r, c in self.history.get()]
                    body = json.dumps([*said, {"role": role, "content": text}], ensure_ascii=False, separators=(",", ":"))
                    out.append((key[0], turn, messages + 1, tokens, body, "ok"))
                self.history.appendValue((role, text))
                if said is not None:
                    said.append({"role": role, "content": text})
                messages, tokens = messages + 1, tokens + len(text.split())
            if last is not None:
                self.totals.update((last, messages, tokens))
            frame = pd.DataFrame(out, columns=OUTPUT.names)
            return frame.astype({"n_messages": "Int64", "context_tokens": "Int64"})

        def close(self) -> None:
            pass

    return ConversationState()


def replay(turns: DataFrame, patience_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Streaming frame of turns to the request of each user turn."""
    timed = patience_ms is not None or idle_ms is not None
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=conversation_processor(patience_ms, idle_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if timed else "None",
    )


def run(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
        files_per_batch: int = 1000, patience_ms: int | None = None, idle_ms: int | None = None) -> StreamingQuery:
    """Replay what is in ``source`` now; without patience, batches must arrive in turn order.

    Turns that still wait at the end stay in the state for the next call.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    # A query keeps the settings it was started with; the caller's session gets its own back. Timers are looked at in
    # batches with rows only: otherwise a query with timers never ends.
    settings = {PROVIDER: ROCKSDB, NO_DATA: "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return (
            replay(stream, patience_ms, idle_ms).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
