import hashlib
import os

import numpy as np
import public_tokenizers as P
import zstandard

from textquarry.llm import token_shards as S
from textquarry.llm.packing import encoder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 7):
            slots = S.permute(np.arange(n), n, key)
            assert sorted(slots) == list(range(n))
            assert (S.permute(slots, n, key, inverse=True) == np.arange(n)).all()
    a, b = S.permute(np.arange(5000), 5000, 1), S.permute(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05


def test_round_trip_and_order(spark, tmp_path):
    texts = ["hello world", None, "", "é \U0001F600 x", "word " * 3000, "tie", "tie"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, slot int").repartition(3).cache()
    folder, key = f"file://{tmp_path}/s", 20_240_601
    shards = S.materialise(df, JSON, RANKS, length=16, per_shard=8, shard_partitions=3, folder=folder)
    rows = sorted(shards.collect(), key=lambda r: r.shard)
    n = sum(r.n_sequences for r in rows)
    assert [r.shard for r in rows] == list(range(len(rows))) and all(r.n_sequences == 8 for r in rows[:-1]) and all(r.first_slot == 8 * r.shard for r in rows)
    want = sorted(i for t in texts for i in [*encoder(JSON, None)(t or "").tolist(), S.EOS])
    data = [open(f"{tmp_path}/s/{r.file}", "rb").read() for r in rows]
    got = np.concatenate([np.frombuffer(x, "<u2") for x in data])
    assert sum(r.n_tokens for r in rows) == len(want)
    assert sorted(got.tolist()) == sorted(want + [S.EOS] * (n * 16 - len(want)))
    assert [(r.bytes, r.sha256, r.stride) for r in rows] == [(len(x), hashlib.sha256(x).hexdigest(), 32) for x in data]
    # slot g holds the sequence whose number the permutation sends to g
    made = sorted(S.sequences(df, JSON, RANKS, 16).collect(), key=lambda r: (r.part, r.nth))
    slots = S.permute(np.arange(n), n, key)
    for r, g in zip(made, slots.tolist(), strict=True):
        assert got[g * 16 : g * 16 + 16].tolist() == np.frombuffer(zstandard.decompress(r.payload), "<u2").tolist()
    for a, b in ((5, 21), (0, n), (n - 1, n), (8, 8)):
        part = S.read_slots(spark, folder, a, b, length=16, per_shard=8).collect()
        assert [r.slot for r in part] == list(range(a, b)) and sum((r.ids for r in part), []) == got[a * 16 : b * 16].tolist()
    again = S.materialise(df, JSON, RANKS, length=16, per_shard=8, shard_partitions=3, folder=folder)
    assert sorted(again.collect(), key=lambda r: r.shard) == rows and len(os.listdir(f"{tmp_path}/s")) == len(rows)
    assert S.materialise(df.limit(0), JSON, RANKS).count() == 0


def test_query_holds_each_document_once(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.001"
    rows = QUERIES["op10_feistel_shards"](spark, dir_).collect()
    texts = [r.text for r in spark.read.parquet(f"{dir_}/documents.parquet").select("text").collect()]
    assert sum(r.n_tokens for r in rows) == sum(len(encoder(JSON, None)(t or "")) + 1 for t in texts)


def test_stored_sequences_are_smaller_by_a_learned_dictionary(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = S.learned(df, JSON, RANKS, 2048)
    size = lambda w: S.sequences(df, JSON, RANKS, 2048, w).selectExpr("sum(octet_length(payload))").first()[0]
    assert size(words) < 0.85 * size(b"")
    a, b = (S.sequences(df, JSON, RANKS, 2048, w).orderBy("part", "nth").collect() for w in (words, b""))
    large = zstandard.ZstdDecompressor(dict_data=S._known(words)).decompress
    assert [large(r.payload) for r in a] == [zstandard.decompress(r.payload) for r in b]
    assert S.learned(df.limit(0), JSON, RANKS, 2048) == S.learned(df.limit(3), JSON, RANKS, 2048) == b""
