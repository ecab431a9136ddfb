import zlib

import numpy as np

from textquarry.llm import langid as L


def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    extra = spark.createDataFrame([("это русский текст про язык и слова " * 20, "ru"), ("το κείμενο είναι γραμμένο στα ελληνικά " * 20, "el"), (None, "en"), ("x", None)], "text string, lang string")
    return L.train(docs.unionByName(extra)), docs


def brute(score, penalty):
    best, paths = score[0].copy(), [[j] for j in range(score.shape[1])]
    for row in score[1:]:
        step = [[best[a] - (penalty if a != b else 0) for a in range(len(row))] for b in range(len(row))]
        pick = [max(range(len(row)), key=lambda a, b=b: (step[b][a], a == b)) for b in range(len(row))]
        paths = [paths[pick[b]] + [b] for b in range(len(row))]
        best = np.array([step[b][pick[b]] + row[b] for b in range(len(row))])
    return float(best.max())


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(0)
    counts = [0, 1, 7, 3, 0, 12]
    text = np.repeat(np.arange(6), counts)
    score = rnd.normal(size=(len(text), 3)) * 3
    path = L.Model(["a", "b", "c"], None, None)._viterbi(score, text, 6, 2.5)
    for i in range(6):
        s, p = score[text == i], path[text == i]
        if len(p):
            value = s[np.arange(len(p)), p].sum() - 2.5 * (p[1:] != p[:-1]).sum()
            assert abs(value - brute(s, 2.5)) < 1e-9


def test_spans_scripts_and_odd_texts(spark):
    m, docs = model(spark)
    en = docs.filter("lang = 'en'").first().text[:300].rsplit(" ", 1)[0]
    fr = docs.filter("lang = 'fr'").first().text[:300].rsplit(" ", 1)[0]
    rows = [(1, en + " " + fr), (2, en + " слова и язык"), (3, None), (4, ""), (5, "12 !?"), (6, "語 言"), (7, (en + " ") * 3000), (7, "\U0001F600 " + en)]
    got = {}
    for r in L.identify(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), m, slice_chars=1000).collect():
        got.setdefault(r.doc_id, []).append(r.language)
    assert [s.lang for s in got[1][0].spans] == ["en", "fr"] and abs(got[1][0].spans[1].start - len(en) - 1) < 12
    assert [s.lang for s in got[2][0].spans] == ["en", "ru"] and (en + " слова и язык")[got[2][0].spans[1].start :] == "слова и язык"
    assert all(got[i][0] == ("und", 0.0, []) for i in (3, 4, 5)) and got[6][0].lang != "und"
    assert sorted((x.lang, len(x.spans), x.spans[0].start) for x in got[7])[1] == ("en", 1, 2) and got[7][0].score == 1.0
    empty = spark.createDataFrame([], "text string, lang string")
    assert L.identify(empty, m).count() == 0
    assert L.identify(docs.limit(2), L.train(empty)).first().language.lang == "und"


def test_held_out_accuracy_of_query(spark):
    from textquarry.llm.queries import QUERIES

    dir_ = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op8_script_viterbi"](spark, dir_).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out and truth[r.doc_id]]) > 0.97
