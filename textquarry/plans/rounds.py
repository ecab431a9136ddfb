"""Rounds of iterative plans: each is written to the shared folder and read back, so lineage stays short."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. A local one is made only where that is unset and
    the master is local; on a cluster each executor would write to a disk of its own, so there it is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back. A lost executor then costs a re-read
    only. What drop() leaves is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def cut_by(df: DataFrame, what: str, key: str, placed: bool = False) -> DataFrame:
    """cut() into as many buckets of `key` as Spark shuffles into, sorted by it: joins and aggregates on the key then read each
    bucket where it is needed and shuffle nothing. Rows are dealt out by the key first, so that a bucket is one file and not one
    for each task. `placed`: they are already, by a join or an aggregate on the key or by a table of cut_by() on it."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path, parts = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if placed else df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    _KEPT[path] = spark
    out = spark.table(name)
    out.cut_at, out.cut_as = path, name
    return out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place of each row, from 0, in the order of the columns `order` (unique together). Range partitions are sorted and numbered
    on their own as they are written, from where those before them end; of those there is one row each."""
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "laid")
    part, whole = F.shiftright("_at", 33), Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_begin"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(begin), part == F.col("_part")).select(*df.columns, place.cast("long").alias(name))


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what a query writes by other ways than cut(); deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}"
    _KEPT[path] = spark
    return path


def drop(*tables: DataFrame | None) -> None:
    """Delete tables written by cut() that no later plan reads."""
    for df in tables:
        path = getattr(df, "cut_at", None)
        if path and _KEPT.pop(path, None) is not None:
            if getattr(df, "cut_as", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.cut_as}")
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to the folder
            pass
    _KEPT.clear()
