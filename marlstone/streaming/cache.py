"""A cache with a fixed time to live, replayed over an access log, in batch and as a stream.

An entry expires a fixed time after it was written; hits do not extend it; an access at or after expiry
evicts and writes anew.  Accesses of failed calls are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(accesses: DataFrame, key: str, time: str, order: str, ttl: int, at: str | None = None) -> DataFrame:
    """(key, order, outcome: miss, hit or evict) for each access.

    One exchange sorts by key and time (by ``at`` if times are coarser than the order of accesses); rows stream
    through a fold that holds the last key's expiry, so the accesses of one key are never gathered.  An access
    without a time comes after its key's others and never finds an entry expired.
    """
    last = lambda c: F.col(c).asc_nulls_last()
    rows = accesses.repartition(F.col(key)).sortWithinPartitions(key, last(at or time), last(order)).select(key, time, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, expires = object(), None
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != last:
                    last, expires, what = k, None if t is None else t + ttl, "miss"
                elif t is not None and expires is not None and t >= expires:
                    expires, what = t + ttl, "evict"
                else:
                    what = "hit"
                out.append(what)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.string())], names=[key, order, "outcome"])

    kinds = {c: accesses.schema[c].dataType.simpleString() for c in (key, order)}
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string")


def stream(accesses: DataFrame, key: str, time: str, order: str, ttl: int) -> DataFrame:
    """The same as arbitrary stateful streaming: the state of a key is its expiry."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expires = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([time, order])
        out = []
        for t in rows[time]:
            what = "miss" if expires is None else "evict" if t >= expires else "hit"
            expires = t + ttl if what != "hit" else expires
            out.append(what)
        state.update((int(expires),))
        yield pd.DataFrame({key: k[0], order: rows[order], "outcome": out})

    kinds = {c: accesses.schema[c].dataType.simpleString() for c in (key, order)}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string"
    return accesses.groupBy(key).applyInPandasWithState(step, out, "expires long", "append", GroupStateTimeout.NoTimeout)
