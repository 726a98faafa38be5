"""Conversations: the last turns of a session, follow-up questions, and a stream that keeps session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TURNS, TTL = 6, 21600


def history(turns: DataFrame, limit: int = TURNS) -> DataFrame:
    """The last ``limit`` turns of each session (session_id, seq, role, content), with ``place`` from 1, oldest first."""
    last = turns.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).filter(F.col("back") <= limit)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).drop("back")


def standalone(turns: DataFrame) -> DataFrame:
    """User turns with ``standalone``: a question that needs context has the user turn before it in front."""
    asked = turns.filter("role = 'user'")
    before = F.lag("content").over(Window.partitionBy("session_id").orderBy("seq"))
    both = F.when(T.needs_context(F.col("content")) & F.col("before").isNotNull() & (F.col("before") != ""), F.concat_ws(" ", "before", "content")).otherwise(F.col("content"))
    return asked.withColumn("before", before).withColumn("standalone", both).drop("before")


def session_stream(turns: DataFrame, limit: int = TURNS, ttl_s: int = TTL) -> DataFrame:
    """Streaming: (session_id, turns, content) after each batch, keeping a session's last ``limit`` turns until it was idle for ``ttl_s`` (0 or less: for ever)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        held = list(state.get[0]) if state.exists and not state.hasTimedOut else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for pdf in batches for r in zip(pdf["seq"], pdf["content"])]
        held = [*held, *(c for _, c in sorted(rows))][-limit:]
        state.update((held,))
        if ttl_s > 0:
            state.setTimeoutDuration(1000 * ttl_s)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [len(held)], "content": ["\n".join(held)]})

    kind = GroupStateTimeout.ProcessingTimeTimeout if ttl_s > 0 else GroupStateTimeout.NoTimeout
    return turns.groupBy("session_id").applyInPandasWithState(step, "session_id long, turns int, content string", "held array<string>", "update", kind)
