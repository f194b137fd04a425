"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by minimising the non-negative
unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),  with pi the share of good documents among the
unlabelled, which is estimated from these two samples too: no score can hold more of the positives than pi lets it hold of
the unlabelled. No document is ever used as a known bad example.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thinned

#: Most rows that training reads: positives with the smallest hashes of doc_id, and as many again unlabelled twice over.
TRAIN_POSITIVES = 5000
TRAIN_UNLABELLED = 10000
HIDDEN = 24
STEPS = 1500
BATCH = 256

#: Classes of bytes: white space, line end, lower, upper, digit, each common sign by itself, other signs, non-ASCII.
_SIGNS = ".,!?|*$%&#-:'\""


def _byte_classes() -> np.ndarray:
    table = np.full(256, 5 + len(_SIGNS), np.int64)
    table[[9, 11, 12, 32]] = 0
    table[[10, 13]] = 1
    table[97:123], table[65:91], table[48:58] = 2, 3, 4
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = 5 + k
    table[128:] = 6 + len(_SIGNS)
    return table


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
SHAPES = 10
FEATURES = SHAPES + _CLASSES + _CLASSES * _CLASSES


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text: how it repeats itself, how its words look, and shares of byte classes and their pairs."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = _CLASS[raw]
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    if words:
        counts = Counter(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[:SHAPES] = (
            np.log1p(len(words)) / 10,
            len(counts) / len(words),
            max(counts.values()) / len(words),
            min(float(sizes.mean()), 40) / 10,
            min(float(sizes.std()), 40) / 10,
            np.mean(sizes <= 3),
            1 - len(set(lines)) / max(1, len(lines)),
            min(len(words) / max(1, len(lines)), 200) / 100,
            sum(map(str.isupper, counts)) / len(counts),
            sum(map(str.isalpha, counts)) / len(counts),
        )
    share = np.bincount(kinds, minlength=_CLASSES) / len(kinds)
    out[SHAPES : SHAPES + _CLASSES] = np.sqrt(share)
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
        out[SHAPES + _CLASSES :] = np.sqrt(pairs / (len(kinds) - 1))
    return out


@dataclass
class PuNetwork:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk_gradient(parameters: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """Objective of one step and its gradient, for a batch of positives and one of unlabelled rows of the same size.

    Logistic loss l: the risk pi * l(g) on positives plus the negative risk, l(-g) on unlabelled less pi * l(-g) on
    positives. Where that estimate of the negative risk is below zero, the objective is its opposite instead.
    """
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    soft = lambda v: np.logaddexp(0, v).mean()
    batch = len(xp)
    x = np.concatenate([xp, xu])
    h = np.tanh(x @ parameters[0] + parameters[1])
    g = h @ parameters[2] + parameters[3][0]
    gp, gu = g[:batch], g[batch:]
    negative = soft(gu) - prior * soft(gp)
    d = np.empty(2 * batch)
    if negative >= 0:
        objective = prior * soft(-gp) + negative
        d[:batch] = prior * -sigmoid(-gp) - prior * sigmoid(gp)
        d[batch:] = sigmoid(gu)
    else:
        objective = -negative
        d[:batch] = prior * sigmoid(gp)
        d[batch:] = -sigmoid(gu)
    d /= batch
    dh = d[:, None] * parameters[2][None, :] * (1 - h * h)
    return float(objective), [x.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]


def train_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 5) -> PuNetwork:
    """Non-negative PU learning with the logistic loss: where the estimated negative risk of a batch falls below zero,
    the step goes against it instead."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = PuNetwork(both.mean(axis=0), both.std(axis=0) + 0.05, rng.normal(0, 0.08, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    parameters = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    p_x, u_x = (positive - net.mean) / net.scale, (unlabelled - net.mean) / net.scale
    for step in range(1, steps + 1):
        xp, xu = p_x[rng.integers(len(p_x), size=BATCH)], u_x[rng.integers(len(u_x), size=BATCH)]
        _, grads = risk_gradient(parameters, xp, xu, prior)
        grads[0] += 1e-4 * parameters[0]
        grads[2] += 1e-4 * parameters[2]
        for q, gr, a, b in zip(parameters, grads, first, second, strict=True):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            q -= 0.006 * (1.05 - step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    net.b2 = float(parameters[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> float:
    """The share of positives among the unlabelled, as the least ratio of tail shares over all thresholds of a score.

    For every set of scores, P_unlabelled >= pi * P_positive, so each ratio bounds pi from above, and the least one is close
    where some scores are held by positives only. The score is trained on one half of both samples, the tails are taken on
    the other and the other way round, and tails of less than half the positives, whose shares vary more, are left out.
    """
    halves = [(x[0::2], x[1::2]) for x in (positive, unlabelled)]
    if min(len(h) for pair in halves for h in pair) < 10:
        return min(0.99, max(0.01, len(positive) / max(1, len(positive) + len(unlabelled))))
    least = []
    for one in (0, 1):
        net = train_pu(halves[0][one], halves[1][one], 0.5, steps)
        p, u = (np.sort(net.margin(h[1 - one])) for h in halves)
        cuts = np.quantile(p, np.linspace(0.0, 0.5, 51))
        least.append(((1 - np.searchsorted(u, cuts) / len(u)) / (1 - np.searchsorted(p, cuts) / len(p))).min())
    return float(min(0.99, max(0.01, np.mean(least))))


def _feature_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(x=[features(t).tobytes() for t in pdf["text"].tolist()])

    return docs.select(*columns, "text").mapInPandas(run, ", ".join(f"{c} boolean" for c in columns) + ", x binary")


def train_on(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVES, unlabelled: int = TRAIN_UNLABELLED) -> PuNetwork | None:
    """A network from at most `positives` trusted and `unlabelled` other texts; None without any positive.

    docs and labels must already be confined to rows that may be learned from. Both samples come from one pass over docs,
    and the class prior is estimated from them. The sampled identifiers are broadcast; their number is bounded. Of labels
    that repeat a doc_id the largest holds; null labels and doc_ids are left out.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    trusted = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("good"), F.lit(False).alias("web"))
    web = thinned(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), unlabelled).orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    ids = trusted.unionByName(web.select("doc_id", F.lit(False).alias("good"), F.lit(True).alias("web"))).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("web").alias("web"))
    rows = _feature_rows(docs.join(F.broadcast(ids), "doc_id"), ["good", "web"]).collect()  # at most positives + unlabelled
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, FEATURES)
    order = np.lexsort(x.T[:8])  # rows come in any order; batches should not depend on it
    good, web = np.array([r["good"] for r in rows], bool)[order], np.array([r["web"] for r in rows], bool)[order]
    x = x[order]
    if not good.any() or not web.any():
        return None
    return train_pu(x[good], x[web], estimate_prior(x[good], x[web]))


SCORE = "doc_id long, score double"


def quality_scores(docs: DataFrame, net: PuNetwork | None) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text).

    Null and empty texts are scored on all-zero features; without a network every score is 0.5. Repeated
    rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = np.full(len(pdf), 0.5)
            if shared.value and len(pdf):
                texts = pdf["text"].tolist()
                for k in range(0, len(texts), 512):
                    scores[k : k + 512] = shared.value.score(np.stack([features(t) for t in texts[k : k + 512]]).astype(np.float64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, SCORE)
