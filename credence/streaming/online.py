"""Filtering a stream of observations: a local level's moments are the state of each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_local_level(stream: DataFrame, process: float, noise: float, mean: float = 0.0, variance: float = 1.0) -> DataFrame:
    """(series_id, t, m, p) after each observation of a stream (series_id, t, y); nulls predict only.

    Observations of a series must come in order of t across batches; within one they are sorted."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, p = state.get if state.exists else (mean, variance)
        df = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, y in zip(df["t"], df["y"]):
            p += process
            if pd.notna(y):
                k = p / (p + noise)
                m, p = m + k * (y - m), (1 - k) ** 2 * p + k * k * noise
            out.append((key[0], int(t), m, p))
        state.update((m, p))
        yield pd.DataFrame(out, columns=["series_id", "t", "m", "p"])

    return stream.groupBy("series_id").applyInPandasWithState(run, "series_id string, t long, m double, p double", "m double, p double", "append", GroupStateTimeout.NoTimeout)
