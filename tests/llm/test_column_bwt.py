import random

from textquarry.llm.column_bwt import ColumnBWT


def test_against_sorted_suffixes(tmp_path):
    rnd = random.Random(5)
    for case in range(60):
        block = (3, 10, 64, 1 << 18)[case % 4]
        docs = [bytes(rnd.choice(b"ab\xc3\x00" if case % 2 else b"abcdefgh ") for _ in range(rnd.choice((0, 1, 5, 30)))) for _ in range(rnd.randrange(1, 12))]
        if case % 3 == 0:
            docs += docs[: len(docs) // 2] + [b"a" * (300 if block > 10 else 15)]
        got = ColumnBWT(docs, str(tmp_path), block=block)
        want = sorted((d[s:], i, s) for i, d in enumerate(docs) for s in range(len(d) + 1))
        want.sort(key=lambda x: ([b + 1 for b in x[0]] + [0], x[1]))
        doc, start = got.suffixes()
        # equal suffixes keep document order
        assert [(docs[i][s:], i) for i, s in zip(doc.tolist(), start.tolist())] == [(t, i) for t, i, _ in want]
        assert got.bwt.tolist() == [docs[i][s - 1] + 1 if s else 0 for _, i, s in want]
        for k in range(1, len(want)):
            a, b = want[k - 1][0], want[k][0]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert got.lcp[k] == min(n, 255)
    empty = ColumnBWT([], str(tmp_path))
    assert not list(tmp_path.iterdir())
    assert len(empty.bwt) == 0 and len(empty.suffixes()[0]) == 0
