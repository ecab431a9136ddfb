"""Table functions over table arguments, so that SQL has the folds of the DataFrame operators.

SELECT * FROM reserve(TABLE(requests) PARTITION BY budget ORDER BY (pos), 100, 'tokens')
SELECT * FROM accept(TABLE(messages) PARTITION BY conv_id ORDER BY (turn))
SELECT * FROM chunk_rows(TABLE(documents), 512, 64, 'text')

Each keeps the columns of its table and adds its own behind them; a partition of any size streams through, since a fold holds its
running state only. A name that the table has already is an error, as is a named column that it lacks."""

from __future__ import annotations

from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from textquarry.functions.chunk import ChunkOptions, chunks
from textquarry.operators.chat import AFTER


def _added(rows: AnalyzeArgument, needs: list[str], new: list[StructField]) -> AnalyzeResult:
    if not rows.isTable:
        raise ValueError("the first argument is a table")
    have = {f.name.lower() for f in rows.dataType.fields}
    for name in needs:
        if name.lower() not in have:
            raise ValueError(f"the table has no column {name}")
    for f in new:
        if f.name.lower() in have:
            raise ValueError(f"the table already has a column {f.name}")
    return AnalyzeResult(StructType([*rows.dataType.fields, *new]))


def _constant(x: AnalyzeArgument, what: str):
    if not x.isConstantExpression or x.value is None:
        raise ValueError(f"{what} is a constant")
    return x.value


@udtf
class Reserve:
    """Rows of a budget in order: granted and remaining, as chunk.reserve() has them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, total: AnalyzeArgument, amount: AnalyzeArgument) -> AnalyzeResult:
        _constant(total, "total")
        return _added(rows, [_constant(amount, "amount")], [StructField("granted", BooleanType()), StructField("remaining", LongType())])

    def __init__(self) -> None:
        self.used = 0

    def eval(self, row, total: int, amount: str):
        n = row[amount]
        ok = n is not None and (n <= 0 or self.used + n <= total)
        self.used = max(0, self.used + n) if ok else self.used
        yield (*row, ok, total - self.used)


@udtf
class Accept:
    """Messages of a conversation in order: accepted, as chat.accept() has it; null for a message without role."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _added(rows, ["role"], [StructField("accepted", BooleanType())])

    def __init__(self) -> None:
        self.last = None

    def eval(self, row):
        role = row["role"]
        fine = None if role is None else role in AFTER[self.last]
        if fine:
            self.last = role
        yield (*row, fine)


@udtf
class ChunkRows:
    """Each row once for each chunk of its text: nth and chunk. A null or empty text has no chunks and no row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument, overlap: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        ChunkOptions(_constant(most, "most"), _constant(overlap, "overlap"))
        return _added(rows, [_constant(text, "text")], [StructField("nth", IntegerType()), StructField("chunk", StringType())])

    def eval(self, row, most: int, overlap: int, text: str):
        for i, c in enumerate(chunks(row[text], ChunkOptions(most, overlap))):
            yield (*row, i, c)


__all__ = ["Accept", "ChunkRows", "Reserve"]
