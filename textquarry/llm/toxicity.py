"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rows of the training sample at most: those labelled documents whose hash is smallest.
SAMPLE_ROWS = 8_000
VOCABULARY = 20_000
FOLDS = 3
#: Features of fewer documents of the sample are not learned from.
LEAST_DOCUMENTS = 4


def features(text: str | None) -> set[int]:
    """Hashes of the distinct words (A-Z lower-cased) and of their first five bytes, which catch inflected forms."""
    whole = set(WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    return set(map(crc32, whole)) | set(map(crc32, {b"<" + w[:5] for w in whole}))


@dataclass
class Link:
    """One classifier of the chain: weights of word features, of the earlier categories' probabilities, the bias and the cut."""

    name: str
    weights: dict[int, float]
    earlier: list[float]
    bias: float
    cut: float


@dataclass
class Chain:
    links: list[Link]

    def probabilities(self, text: str | None) -> list[float]:
        have, out = features(text), []
        for link in self.links:
            z = link.bias + sum(map(link.weights.__getitem__, link.weights.keys() & have)) + float(np.dot(link.earlier, out))
            out.append(float(_sigmoid(z)))
        return out


def _sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse 0/1 word features of the sample, in row order."""

    def __init__(self, at: np.ndarray, word: np.ndarray, n: int, n_words: int):
        self.at, self.word, self.n, self.n_words = at, word, n, n_words

    def select(self, rows: np.ndarray, words: np.ndarray) -> _Rows:
        to_row, to_word = np.full(self.n, -1, np.int32), np.full(self.n_words, -1, np.int32)
        to_row[rows], to_word[words] = np.arange(len(rows)), np.arange(len(words))
        a, w = to_row[self.at], to_word[self.word]
        ok = (a >= 0) & (w >= 0)
        return _Rows(a[ok], w[ok], len(rows), len(words))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights[self.word], self.n)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, residual[self.at], self.n_words)


def fit_linear(x: _Rows, extra: np.ndarray, y: np.ndarray, lasso: float = 3e-4, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """L1-regularised logistic regression by accelerated proximal steps; `extra` are dense columns, not penalised."""
    n, m, k = max(len(y), 1), x.n_words, extra.shape[1]
    dot = lambda u: x.dot(u[:m]) + extra @ u[m : m + k] + u[-1]
    back = lambda r: np.concatenate([x.back(r), extra.T @ r, [r.sum()]])
    top = np.ones(m + k + 1)
    for _ in range(8):  # the largest eigenvalue by power iteration: a quarter of it bounds the curvature
        top = back(dot(top / np.linalg.norm(top))) / n
    rate = 1 / (0.3 * np.linalg.norm(top) + 1e-9)
    w = np.zeros(m + k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z, t = w, 1.0
    for _ in range(steps):
        new = z - rate * back(_sigmoid(dot(z)) - y) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * lasso, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w[:m], w[m : m + k], float(w[-1])


def select_words(x: _Rows, y: np.ndarray, least: int = LEAST_DOCUMENTS, most: int = VOCABULARY) -> np.ndarray:
    """Words of the sample by the signed chi of their document frequency among positives, the clearest `most` of them."""
    n1, n = max(y.sum(), 1), x.n
    df = np.bincount(x.word, minlength=x.n_words)
    pos = np.bincount(x.word, y[x.at], x.n_words)
    mean = df * n1 / n
    chi = np.abs(pos - mean) / np.sqrt(mean * (1 - df / (n + 1)) + 1)
    best = np.flatnonzero((df >= least) & (chi > 2))
    return np.sort(best[np.argsort(-chi[best], kind="stable")[:most]])


def fit_chain(x: _Rows, names: np.ndarray, labels: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    """Fit one linear model a category in order. Each later one also gets the probabilities of the earlier categories,
    which for its training rows are out-of-fold predictions, so it learns from what the chain will see on new documents."""
    fold = np.arange(x.n) % folds
    earlier, links = np.zeros((x.n, 0)), []
    for k, name in enumerate(categories):
        y, out = labels[:, k].astype(float), np.zeros(x.n)
        for f in range(folds):
            rows, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = x.select(rows, np.arange(x.n_words))
            chosen = select_words(part, y[rows])
            w, v, b = fit_linear(part.select(np.arange(len(rows)), chosen), earlier[rows], y[rows])
            out[held] = x.select(held, chosen).dot(w) + earlier[held] @ v + b
        chosen = select_words(x, y)
        w, v, b = fit_linear(x.select(np.arange(x.n), chosen), earlier, y)
        links.append(Link(name, {int(names[i]): float(a) for i, a in zip(chosen, w, strict=True) if a}, v.tolist(), float(b), _best_cut(_sigmoid(out), y)))
        earlier = np.column_stack([earlier, _sigmoid(out)])
    return Chain(links)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which the out-of-fold F1 is best; 0.5 where nothing is positive."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit the chain on a bounded sample of labelled documents: the `sample_rows` with the smallest hash of doc_id.

    `categories` (in chain order) are 0/1 columns over `labels`; several label rows of a document count as their
    maximum, rows with a null category are left out; of several texts with one doc_id the one whose features sort first
    counts. Only the sample's distinct words go to the driver.
    """
    names = list(categories)
    marked = labels.select("doc_id", *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values()))).dropna()
    marked = marked.groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.sort(np.fromiter(features(t), np.uint32)).tobytes())

    got = rows.select("doc_id", *(f"y{i}" for i in range(len(names))), packed("text").alias("w")).toPandas().sort_values(["doc_id", "w"], ignore_index=True).drop_duplicates("doc_id")
    each = [np.frombuffer(w, np.uint32) for w in got["w"]]
    values = np.sort(np.concatenate([*each, np.zeros(0, np.uint32)]))
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    known = values[begin[np.diff(np.append(begin, len(values))) >= LEAST_DOCUMENTS]]
    del values
    kept = [at[known[at] == w].astype(np.int32) for w in each for at in (np.minimum(np.searchsorted(known, w), len(known) - 1),)] if len(known) else [np.zeros(0, np.int32) for _ in each]
    x = _Rows(np.repeat(np.arange(len(each), dtype=np.int32), [len(w) for w in kept]), np.concatenate([*kept, np.zeros(0, np.int32)]), len(each), len(known))
    got = got.drop(columns="w")
    del each, kept
    if not len(got):
        return Chain([Link(n, {}, [0.0] * k, -12.0, 0.5) for k, n in enumerate(names)])
    return fit_chain(x, known, got[[f"y{i}" for i in range(len(names))]].to_numpy(), names)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """Add `toxicity`, a struct with p_<category> (double) and is_<category> (boolean: at the category's cut or above).

    Whole texts count; null and empty ones have no words and get the bias alone. A column of docs named toxicity is
    replaced. Row-wise: no shuffle. The chain's
    weights are bounded by VOCABULARY words a category and travel as a broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    kind = "struct<" + ",".join(f"p_{x.name}:double,is_{x.name}:boolean" for x in chain.links) + ">"

    @F.pandas_udf(kind)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        links = model.value.links
        for part in texts:
            p = np.array([model.value.probabilities(t) for t in part], float).reshape(len(part), len(links))
            yield pd.DataFrame({k: v for i, x in enumerate(links) for k, v in ((f"p_{x.name}", p[:, i]), (f"is_{x.name}", p[:, i] >= x.cut))})

    return docs.withColumn("toxicity", score(F.col("text").cast("string")))


def default_categories() -> dict[str, Column]:
    """What `labels` tells: low quality first, then toxic."""
    return {"low_quality": F.when(F.col("quality").isNotNull(), F.col("quality") == 0), "toxic": F.when(F.col("toxic").isNotNull(), F.col("toxic") == 1)}
