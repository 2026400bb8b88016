"""The sequence tracker over a stream: state for each product, equal to the batch classification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "arrival long, product string, seq long, anomaly string, expected long, missing long"


def step(mode: str, hwm: int | None, epoch: int, seq: int, seen: int) -> str:
    """What ``seq`` is after the high-water mark ``hwm``, last seen in reseed epoch ``seen``."""
    if hwm is None:
        return "none"
    if epoch != seen:
        return "stale" if seq <= hwm else "none" if seq == hwm + 1 else "reconnect_gap"
    if seq <= hwm:
        return "regression"
    return "gap" if mode == "contiguous" and seq != hwm + 1 else "none"


def track(stream: DataFrame, mode: str) -> DataFrame:
    """Classify sequenced messages (``file_idx, rec, arrival, product, seq, epoch``) of a stream.

    Each product's rows are put in arrival order within a micro-batch. Reseeds carry no product: the source stamps their
    running count on each row as ``epoch``. Nothing is dropped for being late.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hwm, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["file_idx", "rec"])
        out = []
        for r in rows.itertuples():
            kind = step(mode, hwm, r.epoch, r.seq, seen)
            out.append((r.arrival, key[0], r.seq, kind, None if hwm is None else hwm + 1, None if hwm is None else r.seq - hwm - 1))
            hwm, seen = r.seq if hwm is None else max(hwm, r.seq), r.epoch
        state.update((hwm, seen))
        frame = pd.DataFrame(out, columns=["arrival", "product", "seq", "anomaly", "expected", "missing"])
        yield frame.astype({"expected": "Int64", "missing": "Int64"})

    return stream.groupBy("product").applyInPandasWithState(run, OUT, "hwm long, seen long", "append", GroupStateTimeout.NoTimeout)
