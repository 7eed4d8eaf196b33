"""The lease fold as a stateful stream, and stats and metric streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas as S
from ..operators.leases import MOVES, LeaseLog, entries

OUTPUT = "cluster string, " + S.RESPONSES
STATE = "payload string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    log = LeaseLog(state.get[0] if state.exists else None)
    rows: list[tuple] = []
    whole = pd.concat(list(frames))
    for e in entries(whole):
        rows.append((key[0], e["log_index"], *log.take(e)))
    state.update((log.dump(),))
    yield pd.DataFrame(rows, columns=["cluster", "log_index", "status", "reason", "generation", "deadline_tick"]).astype({"generation": "Int64", "deadline_tick": "Int64"})


def answers(mutations: DataFrame) -> DataFrame:
    """A stream of mutations with a cluster column -> the verdict on each; a batch is applied in log order.

    Late entries are judged by the logical clock in the state, so no watermark is needed. A cluster's log is one
    group, as it is one log; clusters run side by side.
    """
    rows = mutations.where(mutations.kind.isin(*MOVES))
    return rows.groupBy("cluster").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stats_stream(ticks: DataFrame, stats: Callable[[], DataFrame], emit: Callable[[DataFrame, int], Any]):
    """Emit a stats row for each micro-batch of a `rate` stream, as foreachBatch; returns the stream's writer."""
    return ticks.writeStream.foreachBatch(lambda _, no: emit(stats(), no))
