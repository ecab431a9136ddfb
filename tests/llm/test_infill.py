import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textquarry.llm import infill

SCHEMA = "doc_id long, text string"


def plain(doc_id, text):
    """(n, form, prefix, middle, suffix, output) by slices of code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_against_slices(spark):
    rng = random.Random(3)
    letters = ["a", "é", "漢", "😀", "\x1e", "\x1b", "0", "1", "\n", "\r", " ", "<", ">", "P", "S", "$", "\\", "\x00"]
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 5, 40])))) for i in range(3000)]
    rows += [(None, None), (None, "null id"), (5, None), (5, "again"), (5, "again"), (7, "x<P>y"), (8, "<S"), (9, "P>")]
    got = infill.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got), key=key) == sorted(((i, t or "", *plain(i, t)) for i, t in rows), key=key)
    assert all(r.again == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_leave_no_gap(spark, unit):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["ab", " ", "\n", "\t", "\x1e", "\x1b1", "ü", "."], k=rng.randrange(30)))) for i in range(500)]
    got = infill.transform(spark.createDataFrame(rows, SCHEMA), unit=unit, rate=100).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert r.again == r.text
        assert r.form == "plain" or r.prefix + r.middle + r.suffix == r.text
    words = {r.doc_id: r.n for r in got}
    if unit == "word":
        assert all(abs(words[i] - len(t.replace("\x1e", "x").replace("\x1b", "x").split())) <= 1 for i, t in rows)
    else:
        assert all(words[i] == len(t.split("\n")) - (t == "" or t.endswith("\n")) for i, t in rows)


def test_a_long_text_takes_linear_time(spark):
    text = "wörter 😀 \x1e" * 300_000
    r = infill.transform(spark.createDataFrame([(4, text)], SCHEMA), rate=100).select("*", infill.restore(F.col("output"), F.col("form")).alias("again")).first()
    assert (r.n, r.again, r.output) == (len(text), text, plain(4, text)[5])


def test_empty_table_and_clashing_columns(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "some text", 5, "x", "kept")], "doc_id long, text string, N int, output string, other string")
    r = infill.transform(df).first()
    assert (r.n, r.other) == (9, "kept") and r.output != "x"
