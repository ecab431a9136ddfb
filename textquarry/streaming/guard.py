"""Structured Streaming forms of the text guard, event decoding and title deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textquarry.functions import dlp, text
from textquarry.operators.chat import event_data, openai_event


def guard(stream: DataFrame, column: str = "text") -> DataFrame:
    """Each row with its masked text, sensitivity, injection score and failure class. Stateless, so it works on batches too."""
    hits = dlp.rule_hits(column)
    return stream.withColumns({"masked": text.mask_secrets(column), "sensitivity": dlp.sensitivity(hits), "injection": text.injection_score(column), "failure": text.classify_failure(column)})


def decode_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event columns of `data:` lines; other lines are dropped. A text source only hands over whole lines."""
    return lines.withColumn("event", openai_event(event_data(F.col(column)))).filter("event is not null").select(*[c for c in lines.columns if c != column], "event.*")


def accumulate(events: DataFrame, idle: str | None = None) -> DataFrame:
    """(stream_id, content, reasoning, total_tokens, done): each stream of events (stream_id, seq, kind, content, total_tokens)
    as one row when its done event comes, or unfinished after `idle` (if given) without events, by the batches' clock;
    with it batches go on, so a query that should end by itself must do without. State holds the text so far; what
    comes after a stream's end begins a new one. Within a batch events go by seq."""
    wait = None if idle is None else pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said, thought, tokens = state.get if state.exists else ("", "", None)
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], said, thought, tokens, False))
        else:
            for e in pd.concat(list(batches)).sort_values("seq").itertuples():
                text_ = e.content if isinstance(e.content, str) else ""
                if e.kind == "delta":
                    said += text_
                elif e.kind == "reasoning":
                    thought += text_
                if pd.notna(e.total_tokens):
                    tokens = int(e.total_tokens) if tokens is None else max(tokens, int(e.total_tokens))
                if e.kind == "done":
                    rows.append((key[0], said, thought, tokens, True))
                    said, thought, tokens = "", "", None
        open_ = bool(said or thought or tokens is not None) and not state.hasTimedOut
        if open_:
            state.update((said, thought, tokens))
            if wait is not None:
                state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["stream_id", "content", "reasoning", "total_tokens", "done"]).astype({"total_tokens": "Int64"})

    some = events.select("stream_id", "seq", "kind", "content", "total_tokens")
    kind = dict(events.dtypes)["stream_id"]
    return some.groupBy("stream_id").applyInPandasWithState(
        run, f"stream_id {kind}, content string, reasoning string, total_tokens long, done boolean", "said string, thought string, tokens long", "append", GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def dedup_titles(nodes: DataFrame, hours: int, event_time: str = "updated_at", title: str = "title") -> DataFrame:
    """The first node of a title within `hours` of event time. (The batch form compares with a given now.)"""
    return nodes.withWatermark(event_time, f"{hours} hours").dropDuplicatesWithinWatermark([title])


def live(entries: DataFrame, stored: str, ttl_seconds: int) -> DataFrame:
    """Cache entries that are not older than their time to live, by the batch's clock."""
    return entries.filter(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(stored) <= ttl_seconds)
