"""SQLite files as a data source, to copy graphs from and to them. The file has to lie on a path that driver and executors share."""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

from textquarry.operators.graph_store import EDGES, NODES, fill_defaults, join_list, split_list

_TYPES: dict[str, DataType] = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
_KINDS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


#: A task reads a range of so many row ids where no number of partitions is given, and passes on so many rows at a time.
RANGE_ROWS, BATCH_ROWS = 500_000, 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(path)


def _unlogged(c: sqlite3.Connection) -> None:
    """For files that nobody reads until they are whole: no journal, no wait for the disk."""
    c.execute("PRAGMA journal_mode = OFF")
    c.execute("PRAGMA synchronous = OFF")


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int | None):
        self.path, self.table, self.columns, self.parts = path, table, schema.fieldNames(), parts
        self.schema, self.rows = schema, (RANGE_ROWS, BATCH_ROWS)
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of a column with a value, and lists of values, are left to SQLite; the others go back to Spark."""
        for f in filters:
            name = _quoted(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name and type(f) in _COMPARED and isinstance(f.value, int | float | str) and not isinstance(f.value, bool):
                self.where.append((f"{name} {_COMPARED[type(f)]} ?", [f.value]))
            elif name and isinstance(f, In) and 0 < len(f.value) <= 500 and all(isinstance(v, int | float | str) for v in f.value):
                self.where.append((f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids, found from the least and the greatest alone."""
        with _open(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        parts = self.parts or max(8, -(-(high - low + 1) // self.rows[0]))
        step = max(1, -(-(high - low + 1) // parts))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(w for w, _ in self.where)])
        schema = to_arrow_schema(self.schema)
        with _open(self.path) as c:
            found = c.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE {where}", [partition.first, partition.last, *(v for _, vs in self.where for v in vs)])
            while rows := found.fetchmany(self.rows[1]):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Staged(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task fills a file of its own beside the target; commit() puts them together in a copy and gives that the target's name,
    so readers see the old file or the new one. Whatever fails before leaves the target as it was; tasks that go on after their
    job has failed may leave a folder path.staging-*, which nothing reads."""

    def __init__(self, path: str, table: str, schema: StructType, overwrite: bool):
        self.path, self.table, self.overwrite = path, table, overwrite
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"
        self.columns = ", ".join(f"{_quoted(f.name)} {_KINDS[f.dataType.simpleString()]}" for f in schema.fields)
        self.width = len(schema.fields)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        os.makedirs(self.staging, exist_ok=True)
        at, n = f"{self.staging}/{uuid.uuid4().hex}.db", 0
        with sqlite3.connect(at) as c:
            _unlogged(c)
            c.execute(f"CREATE TABLE t ({self.columns})")
            for batch in iterator:
                n += batch.num_rows
                c.executemany(f"INSERT INTO t VALUES ({', '.join('?' * self.width)})", zip(*(x.to_pylist() for x in batch.columns), strict=True))
        return _Staged(at, n)

    def commit(self, messages: list[_Staged | None]) -> None:
        os.makedirs(self.staging, exist_ok=True)
        new = f"{self.staging}/whole.db"
        if os.path.exists(self.path):
            shutil.copyfile(self.path, new)
        c = sqlite3.connect(new, isolation_level=None)
        _unlogged(c)
        if self.overwrite:
            c.execute(f"DROP TABLE IF EXISTS {_quoted(self.table)}")
        c.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(self.table)} ({self.columns})")
        before = c.total_changes
        for m in messages:
            if m is not None:
                c.execute("ATTACH ? AS part", [m.path])
                c.execute(f"INSERT INTO {_quoted(self.table)} SELECT * FROM part.t")
                c.execute("DETACH part")
        got = c.total_changes - before
        c.close()
        want = sum(m.rows for m in messages if m is not None)
        if got != want:
            raise ValueError(f"{want} rows were staged, {got} arrived")
        with open(new, "rb") as f:
            os.fsync(f.fileno())
        os.replace(new, self.path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[_Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SqliteSource(DataSource):
    """Options: path, table, partitions (by the number of rows, 8 at least)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, _TYPES.get(kind.upper().split("(")[0], StringType())) for _, name, kind, *_ in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema, int(self.options["partitions"]) if "partitions" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["table"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format `sqlite_file` known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def read(spark: SparkSession, path: str, table: str, partitions: int | None = None) -> DataFrame:
    register(spark)
    parts = {} if partitions is None else {"partitions": partitions}
    return spark.read.format("sqlite_file").options(path=path, table=table, **parts).load()


def write(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("sqlite_file").options(path=path, table=table).mode(mode).save()


def copy_graph_to(nodes: DataFrame, edges: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """Nodes (lists joined by commas) and edges to the tables `nodes` and `edges` of a file, in place of those there. Returns the
    counts, and only those for a dry run; an error where what arrived differs."""
    if dry_run:
        return {"nodes": nodes.count(), "edges": edges.count()}
    lists = [f.name for f in NODES if f.dataType.simpleString().startswith("array")]
    counts = {}
    for table, rows in {"nodes": fill_defaults(nodes).withColumns({c: join_list(c) for c in lists}), "edges": edges.select(EDGES.fieldNames())}.items():
        seen = Observation()  # counted on the way
        write(rows.observe(seen, F.count(F.lit(1)).alias("n")), path, table, "overwrite")
        counts[table] = seen.get["n"]
    with _open(path) as c:
        there = {t: c.execute(f"SELECT count(*) FROM {_quoted(t)}").fetchone()[0] for t in counts}
    if there != counts:
        raise ValueError(f"{counts} went, {there} arrived")
    return counts


def copy_graph_from(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph of such a file; columns that an older one lacks have their defaults."""
    nodes = read(spark, path, "nodes")
    lists = [f.name for f in NODES if f.dataType.simpleString().startswith("array") and f.name in nodes.columns]
    return fill_defaults(nodes.withColumns({c: split_list(F.coalesce(c, F.lit(""))) for c in lists})), read(spark, path, "edges").select(EDGES.fieldNames())


__all__ = ["SqliteSource", "copy_graph_from", "copy_graph_to", "read", "register", "write"]
