"""Sentence chunking under a token budget, and token budgets as folds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from textquarry.functions import text as T
from textquarry.plans.rounds import numbered

_CLASSES = [re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), c) + "]") for c in (T.WHITE, T.CONTROL, T.ONE, T.ONE_AND_HALF, T.TWO)]
_WHITE = "".join(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Quarters of a token that a character of each class, or of none, counts; the class of one and a half a token is counted apart.
_QUARTERS, _MIDDLE, _UNKNOWN = np.array([1, 0, 4, 0, 2, 1]), 3, 255
#: Characters whose chunks a task of chunk_rows() holds at a time.
PIECE = 1_000_000
_CLASS_OF = np.full(0x110000, _UNKNOWN, np.uint8)  # filled as characters come up


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in np.unique(points[_CLASS_OF[points] == _UNKNOWN]).tolist():
        _CLASS_OF[c] = next((k for k, p in enumerate(_CLASSES) if p.fullmatch(chr(c))), len(_CLASSES))
    return _CLASS_OF[points]


def _estimate(quarters: int, middle: int) -> int:
    total = quarters * 0.25 + middle / 1.5
    return max(1, int(total + 0.5)) if total else 0


def tokens(text: str) -> int:
    """estimate_tokens for a Python string."""
    kinds = _classes(text)
    return _estimate(int(_QUARTERS[kinds].sum()), int((kinds == _MIDDLE).sum()))


def units(text: str) -> list[str]:
    return [u for p in re.split(r"(?<=[.!?。！？])|[\r\n]", text) if (u := p.strip(_WHITE))]


@dataclass(frozen=True)
class ChunkOptions:
    """At most `most` tokens a chunk (1 at least), of which at most `overlap` (below most) are carried over."""

    most: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        object.__setattr__(self, "most", max(1, self.most))
        object.__setattr__(self, "overlap", max(0, min(self.overlap, self.most - 1)))


def chunks(text: str | None, options: ChunkOptions) -> list[str]:
    """Sentences joined by a space up to the budget; a longer one stands alone. The next chunk begins with the trailing
    sentences that fit the overlap: with the last one alone where none or all would, and with none where the chunk
    had one sentence or where the last one leaves no room for the next.

    A joined text's estimate follows from its sentences' character classes, so running sums spare joining it."""
    queue = units(text or "")
    kinds = [_classes(u) for u in queue]
    quarters = np.concatenate(([0], np.cumsum([int(_QUARTERS[k].sum()) for k in kinds]))).tolist()
    middle = np.concatenate(([0], np.cumsum([int((k == _MIDDLE).sum()) for k in kinds]))).tolist()
    size = lambda a, b: _estimate(int(quarters[b] - quarters[a]) + b - a - 1, int(middle[b] - middle[a]))
    out, first = [], 0
    for i in range(len(queue)):
        while first < i and size(first, i + 1) > options.most:
            out.append(" ".join(queue[first:i]))
            first = _carried(first, i, size, options)
        if first == i and size(i, i + 1) > options.most:
            out.append(queue[i])
            first = i + 1
    return [*out, " ".join(queue[first:])] if first < len(queue) else out


def _carried(first: int, end: int, size, options: ChunkOptions) -> int:
    """Where the chunk after first..end-1 begins."""
    if options.overlap == 0 or end - first == 1:
        return end
    at = end - 1
    while at > first and size(at - 1, end) <= options.overlap:
        at -= 1
    if at == first:
        at = end - 1
    return end if at == end - 1 and size(at, end + 1) > options.most else at


def chunk_text(text: Column | str, most: int = 512, overlap: int = 64) -> Column:
    """array<string> of chunks; explode it for a row each."""
    options = ChunkOptions(most, overlap)

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([chunks(t, options) for t in part], dtype=object)

    return run(text)


def chunk_rows(df: DataFrame, text: str, most: int = 512, overlap: int = 64) -> DataFrame:
    """A row for each chunk of the column `text`: the other columns, nth, chunk. Tasks hold the chunks of PIECE characters of texts at a time,
    or of one text."""
    options, others = ChunkOptions(most, overlap), [c for c in df.columns if c != text]
    piece = PIECE  # as it is here, not where tasks run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nth, out, size = [], [], [], 0
            for i in range(batch.num_rows):
                t = batch.column(len(others))[i].as_py()
                made = chunks(t, options)
                at += [i] * len(made)
                nth += range(len(made))
                out += made
                size += len(t or "")
                if size >= piece or i == batch.num_rows - 1:
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(others))), pa.array(nth, pa.int32()), pa.array(out, pa.string())], [*others, "nth", "chunk"])
                    at, nth, out, size = [], [], [], 0

    kinds = dict(df.dtypes)
    return df.select(*others, F.col(text).cast("string")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "nth int", "chunk string"]))


@udtf(returnType="nth int, chunk string")
class ChunkTable:
    """SELECT * FROM chunk_table(text, most, overlap)"""

    def eval(self, text: str, most: int, overlap: int):
        yield from enumerate(chunks(text, ChunkOptions(most, overlap)))


def reserve(requests: DataFrame, total: int, key: str = "budget", order: str = "pos", amount: str = "tokens") -> DataFrame:
    """Try the reservations of each budget in order: add `granted` and `remaining`. What would exceed `total` is refused and
    takes nothing, so a later smaller one may still pass; negative amounts release, down to nothing used. A fold over
    rows in order that holds only what is used, so a budget of any number of requests streams through its task."""
    at = {c: requests.columns.index(c) for c in (key, amount)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget, used = (), 0
        for batch in batches:
            granted, left = [], []
            for b, n in zip(batch.column(at[key]).to_pylist(), batch.column(at[amount]).to_pylist(), strict=True):
                if budget != (b,):
                    budget, used = (b,), 0
                ok = n is not None and (n <= 0 or used + n <= total)
                used = max(0, used + n) if ok else used
                granted.append(ok)
                left.append(total - used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(granted, pa.bool_()), pa.array(left, pa.int64())], [*batch.schema.names, "granted", "remaining"])

    dealt = requests.repartition(F.xxhash64(key)).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*requests.dtypes, ("granted", "boolean"), ("remaining", "bigint")]))


def chunk_batch(df: DataFrame, size: int, order: str) -> DataFrame:
    """Add `batch`: the number of the group of `size` rows in `order`. Rows are numbered by ranges, so no single task sees all of
    them; the ranges are laid down before they are counted, as Spark draws other bounds whenever it deals rows to ranges anew."""
    if size < 1:
        raise ValueError("batch size must be positive")
    placed = numbered(df, [order], "_place")
    return placed.withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")
