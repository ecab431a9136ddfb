"""Register the functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textquarry.functions import chunk, dlp, json_text, tables, text


def register(spark: SparkSession) -> None:
    """dlp_scan, redact_findings, apply_redactions, extract_json, shell_decode, shell_encode, the tables chunk_table(text, most,
    overlap) and dlp_findings(text), those over table arguments reserve, accept and chunk_rows, and, as SQL functions that the optimiser sees through, those of one text in NATIVE."""
    spark.udf.register("dlp_scan", dlp.scan)
    spark.udf.register("redact_findings", dlp.redact_findings)
    spark.udf.register("apply_redactions", dlp.apply_redactions)
    spark.udf.register("extract_json", json_text.extract_json)
    spark.udf.register("shell_decode", json_text.shell_decode)
    spark.udf.register("shell_encode", json_text.shell_encode)
    spark.udtf.register("chunk_table", chunk.ChunkTable)
    spark.udtf.register("dlp_findings", dlp.FindingTable)
    spark.udtf.register("reserve", tables.Reserve)
    spark.udtf.register("accept", tables.Accept)
    spark.udtf.register("chunk_rows", tables.ChunkRows)
    for name, (kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")


def _replaced(pattern: str, by: str) -> str:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"regexp_replace(t, {quoted(pattern)}, {quoted(by)})"


#: name: (type, body over the text t)
NATIVE = {
    "mask_secrets": ("STRING", _replaced(text.DIALECT + text.SECRET, "$1" + text.MASK.replace("*", r"\*"))),
    "strip_ansi": ("STRING", _replaced(text.ANSI, "")),
    "sanitize_output": ("STRING", _replaced(text.UNSAFE, "")),
    "text_preview": ("STRING", "CASE WHEN length(t) > 64 THEN left(t, 64) || '…' ELSE t END"),
    "redact_credential": ("STRING", f"CASE WHEN t = '' THEN '' WHEN length(t) <= 8 THEN '{text.MASK}' ELSE left(t, 4) || '{text.MASK}' || right(t, 4) END"),
}
