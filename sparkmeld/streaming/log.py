"""The classification log as keyed state: the last 50 events of each key, and a sample of the last ten on a command."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

RING, SAMPLE = 50, 10
_OUT = "key string, event_id long, command string, classes array<string>"
_STATE = "classes array<string>, kinds array<string>"


def commands(events: DataFrame) -> DataFrame:
    """A stream of events(key, event_id, ts, kind image/audio, value) -> a row per audio event with the sample it sees.

    Within a batch, events of a key are taken in the order of (ts, event_id). The sample is the images among the last
    ten events of any kind before the command; the command joins the log after it has run.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        classes, kinds = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if row.kind == "audio":
                last = list(zip(classes, kinds, strict=True))[-SAMPLE:]
                out.append((key[0], int(row.event_id), row.value, [c for c, k in last if k == "image"]))
            classes, kinds = [*classes, row.value][-RING:], [*kinds, row.kind][-RING:]
        state.update((classes, kinds))
        yield pd.DataFrame(out, columns=["key", "event_id", "command", "classes"])

    keyed = events.select(F.col("key").cast("string").alias("key"), "event_id", "ts", "kind", "value")
    return keyed.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
