"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows, each filter keeps its
largest response (max pooling), and a softmax layer names the language. A document's
scores are the means of its windows' probabilities, weighted by their lengths, over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import thinned

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Most rows of labelled text that training reads to the driver, and the window it takes of each, in characters.
TRAIN_ROWS = 6000
STEPS = 1200
BATCH = 96
UNKNOWN = "und"
_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (of a Unicode category L)."""
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class ByteCnn:
    """tables[k][j] holds, for offset j of width WIDTHS[k], each byte's share of the FILTERS responses."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses and their places for (n, WINDOW) bytes; zero bytes pad short windows."""
        best, at = [], []
        for table in self.tables:
            width = len(table)
            span = windows.shape[1] - width + 1
            r = table[0][windows[:, :span]]
            for j in range(1, width):
                r += table[j][windows[:, j : j + span]]
            place = r.argmax(axis=1)
            at.append(place)
            best.append(np.take_along_axis(r, place[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1)

    def pair_tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """The same filters as sums of (offset, table over byte pairs): half the look-ups."""
        out = []
        for table in self.tables:
            parts = [(j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(table) - 1, 2)]
            out.append(parts + ([(len(table) - 1, table[-1])] if len(table) % 2 else []))
        return out

    def probabilities(self, windows: np.ndarray, pairs: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        best = []
        for table, parts in zip(self.tables, pairs, strict=True):
            span = windows.shape[1] - len(table) + 1
            r = None
            for j, t in parts:
                x = np.take(t, (pair if len(t) > 256 else windows)[:, j : j + span], axis=0)
                r = x if r is None else np.add(r, x, out=r)
            best.append(r.max(axis=1))
        return softmax(np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.weights + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> ByteCnn:
    """Cross-entropy by Adam; classes count alike whatever their share of the rows; windows of random lengths."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    codes = {lang: k for k, lang in enumerate(languages)}
    y = np.array([codes[lang] for lang in labels])
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    n = len(WIDTHS) * FILTERS
    model = ByteCnn(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32),
        rng.normal(0, 0.1, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    for t in model.tables:
        t[:, 0] = 0
    parameters = [*model.tables, model.bias, model.weights, model.out_bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        rows = np.array([by_class[k][rng.integers(len(by_class[k]))] for k in rng.integers(len(languages), size=BATCH)])
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, r in enumerate(rows):
            text = texts[r]
            size = int(rng.integers(12, WINDOW + 1))
            start = int(rng.integers(max(1, len(text) - size + 1)))
            piece = text[start : start + size]
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        best, at = model.responses(x)
        hidden = np.maximum(best + model.bias, 0)
        p = softmax(hidden @ model.weights + model.out_bias)
        p[np.arange(BATCH), y[rows]] -= 1
        p /= BATCH
        back = (p @ model.weights.T) * (hidden > 0)
        grads = [np.zeros_like(t) for t in model.tables]
        for k, g in enumerate(grads):  # only the place of the largest response learns
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(len(g)):
                seen = x[np.arange(BATCH)[:, None], at[:, mine] + j]
                np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), back[:, mine])
            g[:, 0] = 0
        grads += [back.sum(axis=0), hidden.T @ p + 1e-4 * model.weights, p.sum(axis=0)]
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-4
        for q, g, a, b in zip(parameters, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return model


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier's text falls in the held-out fold; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def train_on(docs: DataFrame, rows: int = TRAIN_ROWS) -> ByteCnn | None:
    """A network from at most `rows` windows of labelled rows (doc_id, text, lang); None without any.

    The sample takes the rows with the smallest hash of doc_id, and of each a stretch of text at a hashed place.
    """
    size = F.length("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(size - 2 * WINDOW, F.lit(1))) + 1
    sample = (
        thinned(docs.where(F.col("lang").isNotNull()), rows)
        .where(size > 0)
        .select("lang", F.substring("text", start.cast("int"), F.lit(2 * WINDOW)).alias("piece"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "lang", "piece")
        .limit(rows)
        .collect()
    )
    return train([r["piece"].encode() for r in sample], [r["lang"] for r in sample]) if sample else None


PREDICTION = "doc_id long, lang_pred string, score double"
#: Bytes of windows that a worker holds at once.
BLOCK_WINDOWS = 512


class Predictor:
    """The network with its look-up tables, for whole texts."""

    def __init__(self, net: ByteCnn | None):
        self.net = net
        self.pairs = net.pair_tables() if net else []

    def _block(self, todo: list[tuple[int, bytes]], langs: list[str], scores: np.ndarray) -> None:
        counts = [-(-len(t) // WINDOW) for _, t in todo]
        x = np.zeros((sum(counts), WINDOW), np.uint8)
        flat, at, sizes = x.reshape(-1), 0, []
        for (_, t), c in zip(todo, counts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += c * WINDOW
            sizes += [WINDOW] * (c - 1) + [len(t) - (c - 1) * WINDOW]
        p = np.concatenate([self.net.probabilities(x[k : k + BLOCK_WINDOWS], self.pairs) for k in range(0, len(x), BLOCK_WINDOWS)])
        weight = np.array(sizes, np.float64)
        starts = np.cumsum([0, *counts[:-1]])
        mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        for (i, _), m in zip(todo, mean, strict=True):
            k = int(m.argmax())
            langs[i], scores[i] = self.net.languages[k], min(1.0, float(m[k]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        todo: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            if self.net and has_letter(text):
                todo.append((i, raw := text.encode()))
                held += len(raw)
                if held > BLOCK_WINDOWS * WINDOW:
                    self._block(todo, langs, scores)
                    todo, held = [], 0
        if todo:
            self._block(todo, langs, scores)
        return langs, scores


def predict_languages(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    Null texts and texts without a letter get `und` and score 0; so does everything without a model. Every
    byte of a text is in one window. Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for pdf in batches:
            langs, scores = predictor.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, PREDICTION)


def keep_known_languages(docs: DataFrame, model: ByteCnn | None, least_score: float) -> DataFrame:
    """docs, all columns as they were, without texts of no known language: null, without letters, or with a score
    under least_score. Without a model everything but null and letterless texts stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if predictor.net is None:
                keep = [has_letter(t) for t in texts]
            else:
                langs, scores = predictor.predict(texts)
                keep = [lang != UNKNOWN and score >= least_score for lang, score in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
