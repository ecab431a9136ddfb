"""Readers and writers: JSON lines, catalogues, discovery payloads, dotenv files, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.json_text import shell_decode
from textquarry.operators.catalog import PROVIDERS
from textquarry.operators.graph_store import EDGES, NODES, fill_defaults


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON array of providers, in order; lines: as write_catalogue leaves it."""
    if lines:
        return spark.read.schema(PROVIDERS).json(path)
    body = PROVIDERS.split(", ", 1)[1]
    return spark.read.schema(body).json(path, multiLine=True).withColumn("pos", F.monotonically_increasing_id().cast("int"))


def write_catalogue(providers: DataFrame, path: str) -> None:
    providers.orderBy("pos").write.mode("overwrite").json(path)


def payload(spark: SparkSession, path: str) -> DataFrame:
    """A captured discovery payload as one text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def model_list(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Model ids of a captured list body: {"models":[{"name"}]} (ollama) or {"data":[{"id"}]} (openai)."""
    if kind == "ollama":
        return df.select(F.explode(F.from_json(column, "models array<struct<name:string>>")["models"]["name"]).alias("id"))
    return df.select(F.explode(F.from_json(column, "data array<struct<id:string>>")["data"]["id"]).alias("id"))


def dotenv(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=value lines; comments and bad names are skipped, `export` is allowed."""
    line = F.regexp_extract_all("value", F.lit(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)="), F.lit(1))
    value = F.regexp_extract("value", r"^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*=(.*)$", 1)
    rows = spark.read.text(path).filter(F.size(line) > 0)
    return rows.select(F.element_at(line, 1).alias("key"), shell_decode(value).alias("value"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from Parquet; columns that an older table lacks get their defaults."""
    return fill_defaults(spark.read.parquet(f"{path}/nodes")), spark.read.schema(EDGES).parquet(f"{path}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes laid out by id, edges by source, so that readers skip files by their statistics."""
    nodes.select(NODES.fieldNames()).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.select(EDGES.fieldNames()).repartitionByRange("source").sortWithinPartitions("source").write.mode("overwrite").parquet(f"{path}/edges")


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def copy_graph(nodes: DataFrame, edges: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """Copy to Parquet; returns the counts, and only those for a dry run."""
    if not dry_run:
        write_graph(nodes, edges, path)
    return {"nodes": nodes.count(), "edges": edges.count()}
