"""Streams with state of their own: byte chunks to lines, and titles that are remembered for a time."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(batches: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> list[tuple]:
    """The values of `columns` by `order`, nulls last. Groups are many and small, for which pandas' own sort takes most of the time."""
    held: list[tuple] = []
    for b in batches:
        held += zip(*(b[c].tolist() for c in columns), strict=True)
    at = [columns.index(c) for c in order]
    null = lambda x: x is None or x != x
    return sorted(held, key=lambda r: [(1,) if null(r[i]) else (0, r[i]) for i in at]) if len(held) > 1 else held


def lines(chunks: DataFrame) -> DataFrame:
    """(stream_id, nth, value): the whole lines of byte streams that come in chunks (stream_id, seq, bytes), cut anywhere.

    State holds the bytes after a stream's last line end, so a line or a character may be cut by any number of chunks and
    batches; a line is decoded once it is whole (bad bytes as U+FFFD), without white space at its end. Within a batch chunks
    go by seq; batches have to come in order. What follows the last line end is not a line yet. nth counts from 0."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, nth = state.get if state.exists else (b"", 0)
        parts = _rows(batches, ["seq", "bytes"], ["seq"])
        *whole, rest = (bytes(rest) + b"".join(bytes(b) for _, b in parts if b is not None)).split(b"\n")
        state.update((rest, nth + len(whole)))
        if whole:
            yield pd.DataFrame({"stream_id": key[0], "nth": range(nth, nth + len(whole)), "value": [w.decode("utf-8", "replace").rstrip() for w in whole]})

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.select("stream_id", "seq", "bytes").groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, nth long, value string", "rest binary, nth long", "append", GroupStateTimeout.NoTimeout)


def dedup_nodes(nodes: DataFrame, window_ms: int, now: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(id, title, updated, kept, survivor) for a stream of nodes (id, title, updated in milliseconds, seq): a node is dropped where
    the newest kept one of its title was updated less than `window_ms` before now, and survivor is the one that stays.

    now: a column of milliseconds that is taken for each row's clock; by default it is that of the worker. State is one value for
    each title. With `ttl_ms` it is removed that long after its title was last kept, by the batches' clock; batches go on for that,
    so a query that should end by itself (availableNow) goes without. Within a batch nodes of a title go by seq and id. A null
    title is a title like others."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get if state.exists else None), []
        for id_, _, updated, at in _rows(batches, ["id", "seq", "updated", "now"], ["seq", "id"]):
            clock = int(time.time() * 1000) if now is None else int(at)
            block = last is not None and last[1] > clock - window_ms
            if not block:
                last = (id_, int(updated))
            out.append((id_, key[0], int(updated), not block, last[0]))
        state.update(last)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["id", "title", "updated", "kept", "survivor"])

    rows = nodes.select("id", "title", "updated", "seq", (F.col(now) if now else F.lit(0)).cast("long").alias("now"))
    wait = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("title").applyInPandasWithState(run, "id string, title string, updated long, kept boolean, survivor string", "id string, at long", "append", wait)


__all__ = ["dedup_nodes", "lines"]
