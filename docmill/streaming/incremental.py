"""Streaming forms: corrections by last write, conversation memory, document ingest.

State is what is kept per key: one value, or the last turns of a conversation until it has been idle.
Every sink is idempotent per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.finalize import last_writes
from ..sources.writers import upsert

MEMORY = "conv_id long, turn long, text string, retrieval_query string"


def remembered(turns: DataFrame, *, keep: int = 4, most: int = 1400, idle_hours: float | None = None) -> DataFrame:
    """Each user turn of a stream with the previous `keep` ones before it; turns of a conversation arrive in order.

    turns: conv_id, turn, role, text. The state of a conversation is its last `keep` user turns; with
    `idle_hours` it goes when none has come for so long, else it stays.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for r in rows[rows.role == "user"].itertuples():
            text = r.text or ""
            out.append((key[0], r.turn, text, " ".join([*filter(None, past), text]).strip()[-most:]))
            past = [*past, text][-keep:]
        state.update((past,))
        if idle_hours is not None:
            state.setTimeoutDuration(int(idle_hours * 3_600_000))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "retrieval_query"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, MEMORY, "past array<string>", "append", GroupStateTimeout.NoTimeout if idle_hours is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest_corrections(log: DataFrame, *, order: str = "line_no") -> DataFrame:
    """The running last write of each key (complete or update mode)."""
    return last_writes(log, "cache_key", "corrected_text", order)


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, *, key: str = "source_file"):
    """Keeps a table current: each micro-batch replaces the rows of the sources it brings, in the buckets that hold them.

    A replayed batch replaces its own rows by the same ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time windows with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
