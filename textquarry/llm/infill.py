"""Fill-in-the-middle by escaped markers: cut points are delimiters that one regexp_replace puts after every unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter that stands after each unit, and the escape that keeps a text's own delimiters and escapes apart from it:
#: ESCAPE is written as ESCAPE 0 and DELIMITER as ESCAPE 1, each of which is still one character of the text.
DELIMITER, ESCAPE = "\x1e", "\x1b"
_CHARACTER = f"{ESCAPE}[01]|[^{ESCAPE}]"
#: What a unit is, over escaped texts. Each pattern fits every text without a gap, so the units put together are the text.
UNITS = {
    "character": _CHARACTER,
    "word": r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++",
    "line": r"[^\n]*+\n|[^\n]++",
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescape(text: Column) -> Column:
    """Undoes escape(). An ESCAPE 1 never arises from an escaped ESCAPE, which is followed by its own 0."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def mark(text: Column, unit: str = "character") -> Column:
    """The escaped text with DELIMITER after each unit."""
    return F.regexp_replace(escape(text), UNITS[unit], "$0" + DELIMITER)


def count_marks(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def part(marked: Column, n: Column, first: Column, last: Column) -> Column:
    """Units first to last - 1 (from 0) of the `n` units of `marked`, as text: up to the delimiter of rank `last` from the
    left, and of that what follows the delimiter of rank `first`, counted from the right."""
    head = F.call_function("substring_index", marked, F.lit(DELIMITER), last.cast("int"))
    whole = F.when(last >= n, marked).otherwise(head)
    # Of all n units the last delimiter is still there, so the rank from the right is one more.
    back = F.when(last >= n, n - first + 1).otherwise(last - first)
    cut = F.call_function("substring_index", whole, F.lit(DELIMITER), (-back).cast("int"))
    return F.when(first >= last, F.lit("")).otherwise(unescape(F.replace(cut, F.lit(DELIMITER), F.lit(""))))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32: the first four groups of eight hexadecimal digits of the sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, unit: str = "character") -> DataFrame:
    """Add n, form, prefix, middle, suffix and output to `docs` (doc_id, text, ...).

    n is the number of units. A text is cut in two places, both drawn from 0 to n by the hash of its doc_id; out of 100
    texts `rate` are rearranged, and of those `spm_rate` go with the suffix first: psm is PREFIX prefix SUFFIX suffix
    MIDDLE middle, spm is SUFFIX suffix PREFIX prefix MIDDLE middle. A plain text stays as it is: those not drawn, empty
    ones, and those that contain one of the markers, which could not be read back. prefix, middle and suffix are null then.

    A null text counts as empty; a null doc_id draws as an empty one. Rows that repeat a doc_id draw alike, each over its own
    text. Columns of `docs` that have one of the added names are replaced, others stay. A row's work is linear in its text,
    and no row leaves its task.
    """
    own = [c for c in docs.columns if c.lower() not in {"text", "n", "form", "prefix", "middle", "suffix", "output"}]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(*own, text.alias("text"), mark(text, unit).alias("_marked"))
    counted = marked.select("*", count_marks(F.col("_marked")).alias("n"), F.array(*draws(F.col("doc_id"), seed)).alias("_h"))
    h = [F.col("_h")[k] for k in range(4)]
    told = (F.col("n") == 0) | (h[2] % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        told = told | F.contains("text", F.lit(marker))
    form = F.when(told, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    formed = counted.select(*own, "text", "_marked", "n", form.alias("form"), F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    n, a, b = F.col("n"), F.col("_a"), F.col("_b")
    piece = lambda first, last: F.when(F.col("form") != "plain", part(F.col("_marked"), n, first, last))
    parts = formed.select(*own, "text", "n", "form", piece(F.lit(0), a).alias("prefix"), piece(a, b).alias("middle"), piece(b, n).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() had, from its output and form alone. No marker overlaps another or is part of a rearranged
    text, so the first of each kind is the one that was put there."""
    after = lambda x, m: F.call_function("substring_index", x, F.lit(m), F.lit(-1))
    before = lambda x, m: F.call_function("substring_index", x, F.lit(m), F.lit(1))
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    prefix = F.when(form == "psm", before(after(head, PREFIX), SUFFIX)).otherwise(after(head, PREFIX))
    suffix = F.when(form == "psm", after(head, SUFFIX)).otherwise(before(after(head, SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


__all__ = ["mark", "part", "restore", "transform"]
