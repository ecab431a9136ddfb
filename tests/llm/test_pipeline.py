import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from textquarry.llm import decontam as D
from textquarry.llm import toxicity as T
from textquarry.llm.packing import encoder
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scan import plain


def masked(text):
    out, at = "", 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in plain(text)[1].split(",") if x):
        if b > at:
            out += ("" if a < at else text[at:a] + "****")
            at = b
    return out + text[at:]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """sf0.001 with odd rows added."""
    at = tmp_path_factory.mktemp("data")
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "documents":
            bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
            odd = [(90_001, None, None, None, None), (90_002, "", "en", "x", 0), (90_003, bench, "en", "x", 1), (90_004, "my token=abcdefgh1 here", "en", "x", 23), (90_005, None, "en", None, 4)]
            df = df.unionByName(spark.createDataFrame(odd, df.schema))
        df.withColumn("extra", F.lit(1)).write.parquet(f"{at}/{t}.parquet") if t == "documents" else df.write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    chain = T.train(docs, spark.read.parquet(f"{small}/labels.parquet"), T.default_categories())
    left = [i for i in rows if chain.probabilities(rows[i].text)[1] < chain.links[1].cut]
    left = [i for i, _, c in brute([(i, rows[i].text) for i in left], 5, 80) if i == c]
    index = D.Index([tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()], 4)
    left = {i: rows[i].text for i in left if not index.matches(rows[i].text, 0.5)}
    assert 90_003 not in left and {90_001, 90_002, 90_004, 90_005} <= set(left)
    got, stage = {}, docs
    for name, f in C.STAGES[:-1]:
        stage = f(spark, stage, small)
        assert stage.columns == C.COLUMNS, name
        stage = stage.persist()
    for r in stage.collect():
        got[r.doc_id] = r
    assert set(got) == set(left)
    for i, text in left.items():
        want = None if text is None else masked(text)
        assert got[i].text == want and got[i].n_chars == (rows[i].n_chars if want == text else len(want))
    pieces = C.run(spark, small).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == set(left)
    encode = encoder(P.path("byte_bpe_50k.json"))
    for i, parts in by.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(parts, key=lambda p: p.start)])
        assert ids.tolist() == [*encode(got[i].text or "").tolist(), 1]


def test_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
