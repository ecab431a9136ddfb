import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P

from textquarry.llm import packing as K

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_assign_fills_without_padding_and_balances():
    rnd = random.Random(2)
    for n in (0, 1, 5, 400):
        lengths = [rnd.randrange(1, 2048) for _ in range(n)]
        pieces = K.assign(lengths, 2048, 1.0, 1 / 2048)
        room = K.capacities(sum(lengths), 2048)
        assert sum(room) == sum(lengths) and all(r & (r - 1) == 0 for r in room)
        of_doc, of_seq = defaultdict(list), defaultdict(list)
        for d, start, m, s, offset in pieces:
            of_doc[d].append((start, m))
            of_seq[s].append((offset, m))
        for d, parts in of_doc.items():
            assert sum(m for _, m in parts) == lengths[d] and [a for a, _ in sorted(parts)] == np.cumsum([0] + [m for _, m in sorted(parts)])[:-1].tolist()
        for s, parts in of_seq.items():
            assert [a for a, _ in sorted(parts)] == np.cumsum([0] + [m for _, m in sorted(parts)])[:-1].tolist() and sum(m for _, m in parts) == room[s]
        if n == 400:
            assert len(pieces) < 1.6 * n


def test_assign_finds_the_cheapest_sequence_with_room():
    rnd = random.Random(7)
    for lengths in ([rnd.randrange(1, 2048) for _ in range(1500)], [rnd.choice([1, 7, 60, 64, 65, 900, 2047]) for _ in range(900)]):
        room, want = K.capacities(sum(lengths), 2048), []
        free, cost = list(room), [0.0] * len(room)
        for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            start, left = 0, lengths[d]
            while left:
                s = min((s for s in range(len(room)) if free[s]), key=lambda s: (free[s] < left, cost[s], s))
                n = min(left, free[s])
                want.append((d, start, n, s, room[s] - free[s]))
                free[s], cost[s], start, left = free[s] - n, cost[s] + 1.0 * n + 1 / 2048 * n * n, start + n, left - n
        assert K.assign(lengths, 2048, 1.0, 1 / 2048) == want


def test_both_encoders_agree(spark):
    slow, fast = K.encoder(JSON), K.encoder(JSON, RANKS)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*texts, "", "  a\n\n b\t", "<|endoftext|>", "é\U0001F600 语言 it's 12345", " " * 100_000 + "x"]:
        assert slow(t).tolist() == fast(t).tolist()


def test_encoders_find_the_added_token_like_the_plain_library():
    from tokenizers import Tokenizer

    plain, eot = Tokenizer.from_file(JSON), "<|endoftext|>"
    assert plain.encode(f"a {eot} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for t in [f"a {eot} b", eot, eot * 3, f"x{eot}y", f" \n {eot}\n\n z  {eot} ", "<|endoftext|", "<|ENDOFTEXT|>", f"<|{eot}|>", f"é{eot}语言", eot + " " * 100_000 + "x"]:
        want = plain.encode(t, add_special_tokens=False).ids
        assert K.encoder(JSON)(t).tolist() == want and K.encoder(JSON, RANKS)(t).tolist() == want


def test_pack_round_trip(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "word " * 9000), (5, "tie"), (5, "tie")]
    for blocks in (6_000_000, 3):
        rows = K.pack(spark.createDataFrame([(*t, 8) for t in texts], "doc_id long, text string, offset int").repartition(2), JSON, RANKS, block_tokens=blocks).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
            assert len(r.ids) == 4 * r.length
        for i in (1, 2, 3, 4):
            parts = sorted(by[i], key=lambda r: r.start)
            ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
            assert ids == [*K.encoder(JSON)(dict(texts)[i] or "").tolist(), 1] and parts[0].doc_tokens == len(ids)
        assert sum(p.length for p in by[5]) == 2 * by[5][0].doc_tokens
        total = defaultdict(int)
        for r in rows:
            total[r.sequence_id] += r.length
        assert all(v & (v - 1) == 0 for v in total.values())
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_query(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.001"
    rows = QUERIES["op3_cost_balanced_packing"](spark, dir_).collect()
    texts = dict(spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.append(K.encoder(JSON)(texts[r.doc_id] or ""), 1)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]]  # gapless
        assert ends[-1] == 2048 or ends[-1] < 2048 and ends[-1] & (ends[-1] - 1) == 0  # full, or a power of two
    for pieces in documents.values():
        ends = np.cumsum([n for _, n, _ in sorted(pieces)])
        assert [a for a, _, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] == pieces[0][2]
    assert sum(2048 - sum(n for _, n in p) for p in sequences.values() if sum(n for _, n in p) > 1024) == 0
