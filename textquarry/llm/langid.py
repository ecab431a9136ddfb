"""Language identification of mixed-language text: script ranges, character statistics, Viterbi over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
# First and last code point of the main blocks of each script.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("ipa", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ["other"]
_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point, made once for each worker: is it a letter, its lower case (one character), its script."""
    if not _TABLES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        script = np.full(0x110000, len(NAMES) - 1, np.uint8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        for c in range(0x40, 0x32000):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
        _TABLES.append((letter, lower, script))
    return _TABLES[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def scan_words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Words (runs of letters) of many texts at once: trigram bucket of each letter, first letter of each word, its length,
    script, text number, and code-point offset in its text. A trigram is a letter, the one before it and the one after it, or the edge."""
    letter, lower, script = tables()
    each = [code_points(t) if t else np.zeros(0, np.uint32) for t in texts]
    sizes = np.array([len(x) + 1 for x in each])
    base = np.concatenate(([0], np.cumsum(sizes)))
    cp = np.zeros(base[-1] + 1, np.uint32)  # a zero after each text and before the first
    for b, x in zip(base[:-1], each, strict=True):
        cp[b + 1 : b + 1 + len(x)] = x
    is_letter = letter[cp]
    c = np.where(is_letter, lower[cp], np.uint32(0))
    at = np.flatnonzero(is_letter)
    after = np.append(c[1:], np.uint32(0))[at]
    before = c[at - 1]
    h = (before * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(before == 0)
    length = np.diff(np.append(first, len(at)))
    text = np.searchsorted(base, at[first] - 1, side="right") - 1
    return bucket, first, length, script[cp[at[first]]], text, at[first] - 1 - base[text]


def count_statistics(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): how often each trigram bucket, and behind them each word script, occurs in the texts of each
    language, over all rows. Summed within tasks first; the result has at most languages * (BUCKETS + scripts) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                to = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                texts = part["text"].tolist()
                for i in range(0, len(texts), 256):
                    bucket, _, _, script, _, _ = scan_words(texts[i : i + 256])
                    to += np.bincount(np.concatenate([bucket, BUCKETS + script.astype(np.int64)]), minlength=len(to))
        for lang, n in sums.items():
            k = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": k, "n": n[k]})

    return docs.select("lang", "text").mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # bucket x language
    allowed: np.ndarray  # script x language

    def label(self, texts: list[str | None], penalty: float) -> tuple[list[tuple[str, float]], list[list[tuple[int, int, str]]]]:
        """For each text its language with the share of letters so labelled, and its spans (start, end, language) in code points."""
        bucket, first, length, script, text, offset = scan_words(texts)
        n, k = len(texts), len(self.langs)
        if not len(first) or not k:
            return [("und", 0.0)] * n, [[] for _ in range(n)]
        score = np.stack([np.add.reduceat(self.logp[bucket, j], first) for j in range(k)], 1)
        score += np.where(self.allowed[script], 0.0, -1e6)  # scripts narrow the candidates; a script that no language has narrows nothing
        path = self._viterbi(score, text, n, penalty)
        letters = np.zeros((n, k))
        np.add.at(letters, (text, path), length)
        total, best = letters.sum(1), letters.argmax(1)
        said = [(self.langs[b], float(letters[i, b] / total[i])) if total[i] else ("und", 0.0) for i, b in enumerate(best)]
        turn = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (text[1:] != text[:-1]))))
        last = np.append(turn[1:], len(path)) - 1
        spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        for a, b in zip(turn.tolist(), last.tolist(), strict=True):
            spans[text[a]].append((int(offset[a]), int(offset[b] + length[b]), self.langs[path[a]]))
        return said, spans

    def _viterbi(self, score: np.ndarray, text: np.ndarray, n: int, penalty: float) -> np.ndarray:
        """The best language sequence of each text, where a change costs `penalty`; all texts advance a word at a time."""
        start = np.searchsorted(text, np.arange(n))
        count = np.searchsorted(text, np.arange(n), side="right") - start
        order = np.argsort(-count, kind="stable")
        start, count = start[order], count[order]
        back = np.zeros(score.shape, np.int16)
        live = int((count > 0).sum())
        best = score[start[:live]].copy()
        end = np.zeros(n, np.int64)
        langs = np.arange(score.shape[1])
        for t in range(1, int(count.max(initial=0))):
            now = int(np.searchsorted(-count, -t, side="left"))  # texts with more than t words
            end[now:live] = best[now:live].argmax(1)
            live, best = now, best[:now]
            top = best.argmax(1)
            switch = best[np.arange(live), top] - penalty
            stay = best >= switch[:, None]
            rows = start[:live] + t
            back[rows] = np.where(stay, langs, top[:, None])
            best = np.where(stay, best, switch[:, None]) + score[rows]
        end[:live] = best.argmax(1)
        path = np.zeros(len(score), np.int64)
        state, live = end.copy(), 0
        for t in range(int(count.max(initial=0)) - 1, -1, -1):
            live = int(np.searchsorted(-count, -t, side="left"))
            rows = start[:live] + t
            path[rows] = state[:live]
            if t:
                state[:live] = back[rows, state[:live]]
        return path


def train(docs: DataFrame, smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    """Learn from every row of `docs` (text, lang; nulls in either left out): smoothed log shares of trigram buckets for
    each language, and the scripts in which at least `script_share` of its words are written."""
    stats = count_statistics(docs.filter("lang is not null and text is not null")).toArrow()  # MAX_LANGUAGES * BUCKETS numbers
    lang, bucket = stats.column("lang").to_numpy(), stats.column("bucket").to_numpy()
    langs = sorted(set(lang))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.zeros((BUCKETS + len(NAMES), len(langs)))
    n[bucket, np.searchsorted(np.array(langs, object), lang)] = stats.column("n").to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    logp = np.log((grams + smoothing) / (grams.sum(0) + smoothing * BUCKETS)) if langs else grams
    allowed = scripts >= script_share * np.maximum(scripts.sum(0), 1)
    return Model(langs, logp.astype(np.float32), allowed | ~allowed.any(1, keepdims=True))


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, slice_chars: int = 2_000_000) -> DataFrame:
    """Add `language`: struct<lang, score, spans: array<struct<start, end, lang>>> for the whole text of every row.

    Null, empty and letterless texts are `und` with score 0 and no spans. score is the share of letters in words
    labelled lang; ties go to the language that sorts first. A column of docs named language is replaced. Row-wise, no shuffle; a task works on slices of about
    `slice_chars` characters. The model is at most MAX_LANGUAGES * BUCKETS numbers and travels as a broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>")
    def labels(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.tolist()
            lang, score, spans, i = [], [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= slice_chars):
                    size += len(texts[j] or "")
                    j += 1
                said, found = held.value.label(texts[i:j], penalty)
                lang += [x for x, _ in said]
                score += [x for _, x in said]
                spans += [[{"start": a, "end": b, "lang": x} for a, b, x in s] for s in found]
                i = j
            yield pd.DataFrame({"lang": lang, "score": np.asarray(score, float), "spans": spans})

    return docs.withColumn("language", labels(F.col("text").cast("string")))


