"""Chunk dispatch as a keyed state machine: lease, idempotent completion, retry, split, failure.

Messages (chunk_id, requested_at, outcome, n_segments) are grouped by chunk; the state is its status,
attempts, lease and split depth. Time comes from the messages, so a replay gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

# Attempts of a chunk, depth of splits, length of a lease.
MAX_ATTEMPTS, MAX_DEPTH, LEASE = 3, 3, timedelta(minutes=10)
STATE = "status string, attempts int, locked_until timestamp, depth int"
OUT = "chunk_id bigint, requested_at timestamp, action string, status string, attempts int"


def step(state: tuple, at, outcome: str, n_segments: int) -> tuple[tuple, str]:
    """The next state and what is done: ACK (nothing to do), COMPLETE, RETRY, SPLIT, FAIL or LEASE."""
    status, attempts, until, depth = state
    expired = status == "RUNNING" and (until is None or until < at)
    if attempts >= MAX_ATTEMPTS or not (status in ("PENDING", "FAILED") or expired):
        return state, "ACK"
    attempts += 1
    if outcome == "success":
        return ("COMPLETED", attempts, None, depth), "COMPLETE"
    if outcome == "crash":  # the lease stays until it expires
        return ("RUNNING", attempts, at + LEASE, depth), "LEASE"
    if attempts < MAX_ATTEMPTS:
        return ("FAILED", attempts, None, depth), "RETRY"
    if n_segments > 1 and depth < MAX_DEPTH:
        return ("SUPERSEDED", attempts, None, depth), "SPLIT"
    return ("FAILED", attempts, None, depth), "FAIL"


def _handle(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = group.get if group.exists else ("PENDING", 0, None, 0)
    for frame in frames:
        rows = []
        for m in frame.sort_values(["requested_at", "outcome"]).itertuples(index=False):
            state, action = step(state, m.requested_at.to_pydatetime(), m.outcome, m.n_segments)
            rows.append((key[0], m.requested_at, action, state[0], state[1]))
        yield pd.DataFrame(rows, columns=["chunk_id", "requested_at", "action", "status", "attempts"])
    group.update(state)


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, ("PENDING", 0, None, 0)
    for frame in frames:
        rows = []
        for m in frame.itertuples(index=False):
            if m.chunk_id != key:
                key, state = m.chunk_id, ("PENDING", 0, None, 0)
            state, action = step(state, m.requested_at.to_pydatetime(), m.outcome, m.n_segments)
            rows.append((key, m.requested_at, action, state[0], state[1]))
        yield pd.DataFrame(rows, columns=["chunk_id", "requested_at", "action", "status", "attempts"])


def dispatch(messages: DataFrame) -> DataFrame:
    """Actions on a stream of messages, or on a batch, which is replayed in order of time: dealt by
    chunk, sorted within tasks and read as a stream."""
    m = messages.select("chunk_id", F.col("requested_at").cast("timestamp").alias("requested_at"), "outcome", "n_segments")
    if m.isStreaming:
        return m.groupBy("chunk_id").applyInPandasWithState(_handle, OUT, STATE, "append", "NoTimeout")
    return m.repartition("chunk_id").sortWithinPartitions("chunk_id", "requested_at", "outcome").mapInPandas(_replay, OUT)
