"""Spectra of signals in a column: numpy's real FFT on Arrow batches, one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: Lowest of the high frequencies, as a share of them all.
HIGH = 0.8


def dominant(signals: DataFrame) -> DataFrame:
    """signals(id, x array) -> (id, idx, mag, high): strongest frequency over 0 (ties to the lowest), its magnitude, share of energy that is high.

    Magnitudes are compared to six places. Null signals, and those of fewer than two numbers or with a null, have nulls.
    """
    kind = signals.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            out = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for n in np.unique(size[size > 1]):
                own = np.flatnonzero(size == n)
                x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                mag = np.abs(np.fft.rfft(x, axis=1))
                best = mag[:, 1:].round(6).argmax(1) + 1
                energy = (mag * mag).sum(1)
                high = (mag[:, int(HIGH * (mag.shape[1] - 1)) + 1 :] ** 2).sum(1)
                for i, ok, k, m, e, h in zip(own, np.isfinite(energy), best, mag[np.arange(len(own)), best], energy, high, strict=True):
                    if ok:
                        out[0][i], out[1][i], out[2][i] = int(k), float(m), float(h / e) if e else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["id", "idx", "mag", "high"])

    return signals.select("id", "x").mapInArrow(run, f"id {kind.simpleString()}, idx int, mag double, high double")
