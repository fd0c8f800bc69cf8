"""Budgets over a stream: each source's documents go to train or validation until both are full, and the counts outlive restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

SIDES = ("train", "validation")
#: Where Spark keeps the state of transformWithState.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Budgets(StatefulProcessor):
    """State of a key: the ids written to each side so far, and the rows seen.

    Rows of a key come in one micro-batch in any order and are taken in that of the columns given; later batches hold later
    rows. A key's rows of one micro-batch are in one task, so the source's rows for each batch bound it.
    """

    def __init__(self, key: str, order: list[str], targets: tuple[int, int]):
        self.key, self.order, self.targets = key, order, targets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("written", "train long, validation long, rows long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have = list(self.state.get()) if self.state.exists() else [0, 0, 0]
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for n, held in zip(frame["n"].tolist(), frame["held"].tolist(), strict=True):
            open_ = [have[i] < self.targets[i] for i in (0, 1)]
            side = 1 if held and open_[1] else 0 if open_[0] else 1 if open_[1] else None
            written = 0 if side is None else min(n, self.targets[side] - have[side])
            out.append((None if side is None else SIDES[side], 0 if side is None else have[side], written, n - written))
            if side is not None:
                have[side] += written
        have[2] += len(frame)
        self.state.update(tuple(have))
        done = pd.DataFrame(out, columns=["split", "start", "written", "skipped"], index=frame.index)
        yield pd.concat([frame[[self.key, *self.order]], done], axis=1)

    def close(self) -> None:
        pass


def routed(stream: DataFrame, key: str, order: list[str], train: int, validation: int) -> DataFrame:
    """(key, order…, split, start, written, skipped) of a stream with n and held, each key under budgets of its own; split is null where both are full.

    In place of a manifest that a driver keeps, the state lies with the query's checkpoint, by key.
    """
    from gristmill.plans.shipping import ship

    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", split string, start long, written long, skipped long"
    rows = stream.select(key, *order, stream["n"].cast("long").alias("n"), "held")
    return rows.groupBy(key).transformWithStateInPandas(Budgets(key, order, (train, validation)), schema, "append", "none")
