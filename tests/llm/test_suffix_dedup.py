import hashlib
import random

import pytest

from textquarry.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioustrnlé") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(20)[:120], prose(80)
    rows = [prose(rnd.randrange(1, 200)) for _ in range(25)]
    rows += [prose(9) + line + prose(rnd.randrange(60)) for _ in range(30)] + [prose(5) + passage[rnd.randrange(200) :] + prose(5) for _ in range(12)]
    rows += rows[:6] + [rows[1][:-3] + "x", None, "", "a" * 500, "ab" * 300, "a" * 99, "a" * 100, "a" * 101, passage + passage]
    out = list(enumerate(rows))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [2_000, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_STRINGS", hot)
    levels, level = set(), S._level
    monkeypatch.setattr(S, "_level", lambda docs, tables, near, length: levels.add(len(tables)) or level(docs, tables, near, length))
    rows = texts()
    for k, v in {"skewedPartitionThresholdInBytes": "200", "skewedPartitionFactor": "1.1"}.items():  # adaptive execution splits what it may
        spark.conf.set(f"spark.sql.adaptive.skewJoin.{k}", v)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.dedup(df).collect())
    assert got == brute(rows, 100) and levels == ({0} if hot == 2_000 else {0, 1, 2})
    again = S.dedup(df.unionAll(df.filter("doc_id < 3"))).collect()
    assert len(again) == len(rows) + 3
    for k in ("adaptive.skewJoin.skewedPartitionThresholdInBytes", "adaptive.skewJoin.skewedPartitionFactor", "adaptive.advisoryPartitionSizeInBytes", "autoBroadcastJoinThreshold"):
        spark.conf.unset(f"spark.sql.{k}")


@pytest.mark.parametrize("length", [32, 255, 256, 400])
def test_other_lengths(spark, length):
    rnd = random.Random(length)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(900))
    rows = list(enumerate([base[:600], "x" + base[:600], base[300:], base[:450] + "!" + base[450:], "ab" * 700, base[100:380] + "q" + base[380:820], "c" * 401]))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length).collect())
    assert got == brute(rows, length) and got[1][2] > 500


def test_a_template_with_numbers(spark):
    """One anchor has more than HOT_STRINGS distinct strings; windows that differ within their contexts go on to whole ones."""
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abcdefgh é") for _ in range(n)) for n in (70, 300))
    rows = [(i, f"{i:07d} {a} {i % 2_900:05d} {b}") for i in range(3_100)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 100) and got[3_050][2] > got[2_000][2] > 300


def test_ids_that_are_null_large_or_repeated(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(None, text), (5, text), (2**53 + 1, "x" + text), (2**53, "y" + text[:200]), (7, text + "one"), (7, "two" + text), (7, text + "one"), (None, text)]
    got = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    own = min((text + "one", "two" + text), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    cut = [("7", own.replace(text, ""))] * (2 if own.endswith("one") else 1) + [("7", t) for t in (text + "one", "two" + text, text + "one") if t != own]
    assert got == sorted([("None", text)] * 2 + [("5", text), (str(2**53 + 1), "x"), (str(2**53), "y"), *cut])


def test_window_length_is_checked(spark):
    with pytest.raises(ValueError):
        S.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 31)


def test_long_text_in_pieces(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(9_000_000))
    rows = [(1, base), (2, "start " + base[8_388_000:8_389_500] + " end"), (3, base[5:5_000_000])]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 1500 and bytes(got[2].kept) == b"start  end" and got[3].kept == b""


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 100)
    assert sorted(tuple(r) for r in QUERIES["op2_column_suffix_dedup"](spark, dir_).collect()) == want
    assert any(w[2] for w in want)
