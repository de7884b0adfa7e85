"""Deduplication by fixed windows: a message is accepted if none with its key was accepted within the window before it.

A rejected message doesn't extend the window; exactly one window later is accepted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(times: np.ndarray, window: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Indices of accepted ones of ascending times, and the last accepted time; jumps from one to the next."""
    out, i = [], 0
    if last is not None:
        i = int(np.searchsorted(times, last + window))
    while i < len(times):
        out.append(i)
        last = int(times[i])
        i = max(i + 1, int(np.searchsorted(times, last + window)))
    return np.array(out, np.int64), last


def fixed_window(df: DataFrame, keys: list[str], seconds: float, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The accepted rows of ``df``; rows with a null time go.

    Rows stream through partitions sorted by key and time; what is held is one batch and the
    last accepted time.
    """
    width = int(seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for rb in batches:
            if not rb.num_rows:
                continue
            group = np.array(rb.column("__group"))
            times = pc.cast(rb.column("__at"), pa.int64()).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            picked = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if now is None or group[a] != now:
                    now, last = group[a], None
                at, last = accepted(times[a:b], width, last)
                picked.append(at + a)
            yield rb.take(pa.array(np.concatenate(picked))).select(names)

    names = df.columns
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    cut = df.filter(F.col(ts).isNotNull()).withColumns({"__group": group, "__at": F.unix_micros(F.col(ts).cast("timestamp"))})
    return cut.repartition("__group").sortWithinPartitions("__group", "__at", *([tie] if tie else [])).mapInArrow(run, df.schema)
