"""Dense and sparse vector expressions. JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """In double precision; 0 for unequal lengths, empty vectors and zero norms."""
    n = norm(a) * norm(b)
    return F.when((F.size(_col(a)) == F.size(_col(b))) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def normalize(a: Column | str) -> Column:
    """To length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: (x / n).cast("float"))).otherwise(_col(a))


def sparse(indices: Column | str, values: Column | str) -> Column:
    """array<struct<index,value>> by index, zeros dropped; null where the lengths differ."""
    pairs = F.zip_with(_col(indices), _col(values), lambda i, v: F.struct(i.alias("index"), v.alias("value")))
    return F.when(F.size(_col(indices)) == F.size(_col(values)), F.array_sort(F.filter(pairs, lambda p: p["value"] != 0)))


def prune_top_k(vector: Column | str, k: int) -> Column:
    """The k entries of greatest magnitude, the lower index among equals, in order of index."""
    ranked = F.array_sort(F.transform(_col(vector), lambda p: F.struct((-F.abs(p["value"])).alias("m"), p["index"].alias("index"), p["value"].alias("value"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda p: F.struct(p["index"].alias("index"), p["value"].alias("value"))))


def sparse_dot(a: Column | str, b: Column | str) -> Column:
    other = F.map_from_entries(_col(b))
    return F.aggregate(_col(a), F.lit(0.0), lambda s, p: s + p["value"].cast("double") * F.coalesce(F.try_element_at(other, p["index"]).cast("double"), F.lit(0.0)))
