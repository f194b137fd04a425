"""Benchmark decontamination by latent semantic retrieval.

Documents become word numbers of the benchmark's vocabulary and are cut into overlapping passages. A randomised SVD of
TF-IDF passages, multiplied out by Spark tasks, gives one latent space for all items, of far fewer axes than there are
benchmark passages; word weights and axes come from all documents, the axes from the benchmark too.
A passage whose cosine with a benchmark passage is high in that space is a candidate, and a candidate counts when the
longest common subsequence of words covers most of the item and its answer is there too, so that light paraphrases are
caught and texts that merely share a phrase are not.

The benchmark is the query set: the space is one, and its items meet all documents in blocks of at most BLOCK_ITEMS, so
what is broadcast is bounded by a block and by the numbering of words, and no result depends on the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BLOCK_ITEMS = 2000
#: Words of a passage and from one passage's start to the next.
PASSAGE, STRIDE = 24, 12
#: Axes of the space, and further ones of the sketch.
RANK, OVERSAMPLING = 48, 8
#: Words are numbered by a hash, below this; the table of the benchmark's own words is what documents are encoded by.
NUMBERS = 65_521
#: Candidates: least cosine in the space, and least share of a passage's squared weights in the benchmark's words. A
#: passage that holds the least part of an item that passes the checks has more of that share.
LEAST_COSINE, LEAST_SHARE = 0.6, 0.3
#: Checks: least part of an item's words in the common subsequence, and of its answer's words and its weight nearby.
LEAST_LCS, LEAST_ANSWER, LEAST_WEIGHT = 0.6, 0.5, 0.6

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def starts_of(n: int) -> np.ndarray:
    """Where the passages of n words start; the last one may be shorter."""
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)


def number_of(word: str) -> int:
    """The same in every block and at every size; two words of the benchmark share one with a probability of 1 / NUMBERS."""
    return crc32(word.encode()) % NUMBERS


@dataclass
class Block:
    """Items of the query set as word numbers, with what marks their answers."""

    items: list[tuple[int, np.ndarray, set[int]]]  # item_id, words, words of the answer

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Block:
        items = []
        for item, text in rows:
            ids = np.array([number_of(w) for w in words_of(text)], np.int64)
            if len(ids):
                sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
                items.append((item, ids, {number_of(w) for w in words_of(sentences[-1])}))
        return Block(items)

    def passages(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which item each passage is of, and its distinct words."""
        owner, out = [], []
        for k, (_, ids, _) in enumerate(self.items):
            for s in starts_of(len(ids)):
                owner.append(k)
                out.append(np.unique(ids[s : s + PASSAGE]))
        return np.array(owner, np.int64), out


def encoded(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """doc_id and the numbers of all words of a text (uint16; NUMBERS for those that are not the benchmark's)."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for pdf in batches:
            ids = [np.array([get(w, NUMBERS) for w in words_of(text)], np.uint16).tobytes() for text in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary")


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16).astype(np.int64)


def _occurrences(pdf: pd.DataFrame, size: int, place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(passage, word) numbers of the vocabulary words of disjoint passages, in order, some ten thousand at a time, and the
    number of passages. place gives words other numbers; those of size or more are left out."""
    held, at, n = [], 0, 0
    raws = pdf["ids"].tolist()
    for i, raw in enumerate(raws):
        ids = _words(raw) if place is None else place[np.frombuffer(raw, np.uint16)]
        known = np.flatnonzero(ids < size)
        held.append((known // PASSAGE + at, ids[known]))
        at += len(ids) // PASSAGE + 1
        n += len(known)
        if n > 10_000 or i == len(raws) - 1:
            yield np.concatenate([p for p, _ in held]), np.concatenate([w for _, w in held]), at
            held, at, n = [], 0, 0


def word_counts(ids: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How often each vocabulary word occurs, and the number of disjoint passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, np.int64)
        for pdf in batches:
            for _, words, passages in _occurrences(pdf, size):
                counts[:size] += np.bincount(words, minlength=size)
                counts[size] += passages
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"word": seen, "n": counts[seen]})

    out = np.zeros(size + 1, np.int64)
    for r in ids.select("ids").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most NUMBERS rows
        out[r["word"]] = r["n"]
    return out[:size], int(out[size])


def _gram(passage: np.ndarray, word: np.ndarray, weighted: np.ndarray, total: np.ndarray) -> None:
    """total += X'X weighted for the rows X of word counts given by (passage, word) pairs sorted by passage."""
    if not len(word):
        return
    begins = np.r_[True, np.diff(passage) != 0]
    rows = np.add.reduceat(weighted[word], np.flatnonzero(begins), axis=0)
    order = np.argsort(word, kind="stable")
    there = word[order]
    starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    total[there[starts]] += np.add.reduceat(rows[(np.cumsum(begins) - 1)[order]], starts, axis=0)


def times_gram(ids: DataFrame, place: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, with A the TF-IDF rows of all disjoint passages; tasks send one short vector for each word they saw.

    place: of each word number among the rows of weight and basis.
    """
    size, width = basis.shape
    shared = ids.sparkSession.sparkContext.broadcast((place.astype(np.uint16), (basis * weight[:, None]).astype(np.float32)))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, weighted = shared.value
        total = np.zeros((size, width))
        for pdf in batches:
            for passage, word, _ in _occurrences(pdf, size, at):
                _gram(passage, word, weighted, total)
        seen = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"word": seen, "v": [total[k].astype(np.float32).tobytes() for k in seen]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf["word"].tolist(), pdf["v"].tolist(), strict=True):
                x = np.frombuffer(v, np.float32).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pd.DataFrame({"word": list(sums), "v": [x.tobytes() for x in sums.values()]})

    out = np.zeros((size, width))
    parts = ids.select("ids").mapInPandas(part, "word long, v binary").repartition("word")
    for r in parts.mapInPandas(add, "word long, v binary").collect():  # at most NUMBERS rows
        out[r["word"]] = np.frombuffer(r["v"], np.float64)
    return out * weight[:, None]


@dataclass
class Space:
    weight: np.ndarray  # of each word number
    other: float  # of words that are not the benchmark's
    axes: np.ndarray  # numbers x RANK


def latent_space(ids: DataFrame, items: list[tuple[int, np.ndarray, set[int]]], seed: int = 13) -> Space:
    """Randomised SVD: a random sketch of A'A, its orthonormal basis, and the eigenvectors of A'A within that basis.

    Weights count all passages, and the axes are fitted on all of them. The benchmark's own passages join them with the
    same total energy, so the space leans towards what is searched for.
    """
    counts, passages = word_counts(ids, NUMBERS)
    weight = np.log((passages + 1) / (counts + 0.5)).clip(0.1)
    _, words = Block(items).passages()
    present = np.unique(np.concatenate(words))  # the other numbers have no row in A
    place = np.full(NUMBERS + 1, len(present))
    place[present] = np.arange(len(present))
    own_passage = np.repeat(np.arange(len(words)), [len(w) for w in words])
    own_word = place[np.concatenate(words)]
    held = weight[present]
    corpus_energy = float((counts[present] * held**2).sum())
    own_energy = float((held[own_word] ** 2).sum())
    lean = corpus_energy / own_energy if corpus_energy else 1.0

    def gram(basis: np.ndarray) -> np.ndarray:
        own = np.zeros(basis.shape)
        _gram(own_passage, own_word, basis * held[:, None], own)
        return times_gram(ids, place, held, basis) + lean * own * held[:, None]

    width = min(len(present), RANK + OVERSAMPLING)
    q, _ = np.linalg.qr(gram(np.random.default_rng(seed).standard_normal((len(present), width))))
    image = gram(q)
    values, vectors = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    axes = np.zeros((NUMBERS, min(width, RANK)), np.float32)
    axes[present] = q @ vectors[:, np.argsort(values)[::-1][:RANK]]
    return Space(weight, float(np.median(held)), axes)


def in_space(words: list[np.ndarray], space: Space) -> np.ndarray:
    """Passages of distinct words as directions in the space; one without length there is no direction."""
    out = np.zeros((len(words), space.axes.shape[1]), np.float32)
    for k, w in enumerate(words):
        out[k] = space.weight[w].astype(np.float32) @ space.axes[w]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def lcs(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; masks has for each word of one side the bits of its places there."""
    full = (1 << size) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


MATCH = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, start long"


def search(ids: DataFrame, block: Block, space: Space) -> DataFrame:
    """The best match of each document and item that passes all checks."""
    owner, words = block.passages()
    shared = ids.sparkSession.sparkContext.broadcast((block.items, owner, in_space(words, space), space))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, owner, queries, sp = shared.value
        size = len(sp.weight)
        square = np.append(sp.weight**2, sp.other**2)
        masks = []
        for _, its, _ in items:
            m: dict[int, int] = {}
            for k, w in enumerate(its.tolist()):
                m[w] = m.get(w, 0) | 1 << k
            masks.append(m)
        axes = sp.axes * sp.weight[:, None].astype(np.float32)

        def candidates(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, float]]:
            """(row, item, cosine) of the passages words[begin:end]."""
            place = begin[:, None] + np.arange(PASSAGE)
            table = np.where(place < end[:, None], words[np.minimum(place, len(words) - 1)], size + 1)
            table.sort(axis=1)
            first = np.ones(table.shape, bool)
            first[:, 1:] = table[:, 1:] != table[:, :-1]
            inside = first & (table < size)
            rows = np.flatnonzero(inside.any(axis=1))
            counts = inside[rows].sum(axis=1)
            word = table[rows][inside[rows]]
            starts = np.r_[0, np.cumsum(counts)[:-1]]
            if not len(rows):
                return
            latent = np.add.reduceat(axes[word], starts, axis=0)
            length = np.linalg.norm(latent, axis=1)
            inner = length > 0
            latent, rows = latent[inner] / length[inner, None], rows[inner]
            cosines = latent @ queries.T
            best: dict[tuple[int, int], float] = {}
            for r, q in zip(*np.nonzero(cosines >= LEAST_COSINE), strict=True):
                at = (int(rows[r]), int(owner[q]))
                best[at] = max(best.get(at, 0.0), float(cosines[r, q]))
            for (r, item), cosine in best.items():
                yield r, item, cosine

        for pdf in batches:
            out = []
            docs = pdf["doc_id"].astype("Int64").tolist()
            raws = pdf["ids"].tolist()
            for some in batched(range(len(docs)), 64):
                texts = [_words(raws[i]) for i in some]
                words = np.concatenate(texts)
                if not len(words):
                    continue
                base = np.r_[0, np.cumsum([len(t) for t in texts])]
                begins = [starts_of(len(t)) for t in texts]
                of = np.repeat(np.arange(len(texts)), [len(x) for x in begins])
                begin = np.concatenate(begins) + base[of]
                end = np.minimum(begin + PASSAGE, base[of + 1])
                mass = np.r_[0.0, np.cumsum(square[words])]
                inside = np.r_[0.0, np.cumsum(np.where(words < size, square[words], 0.0))]
                keep = np.flatnonzero((end > begin) & (inside[end] - inside[begin] >= LEAST_SHARE * (mass[end] - mass[begin])))
                best: dict[tuple[int, int], tuple] = {}
                for k in range(0, len(keep), 2048):
                    chosen = keep[k : k + 2048]
                    for r, item, cosine in candidates(words, begin[chosen], end[chosen]):
                        at = int(chosen[r])
                        doc = int(of[at])
                        _, its, answer = items[item]
                        lo, hi = max(base[doc], begin[at] - len(its)), min(base[doc + 1], end[at] + len(its))
                        near = words[lo:hi].tolist()
                        share = lcs(masks[item], len(its), near) / len(its)
                        if share < LEAST_LCS:
                            continue
                        there = set(near)
                        answered = len(answer & there) / len(answer)
                        every = np.unique(its)
                        covered = sp.weight[[w for w in every.tolist() if w in there]].sum() / sp.weight[every].sum()
                        if answered >= LEAST_ANSWER and covered >= LEAST_WEIGHT and (share, cosine) > best.get((doc, item), (0.0, 0.0))[:2]:
                            best[doc, item] = (share, cosine, answered, int(begin[at] - base[doc]))
                out += [(docs[some[doc]], items[i][0], round(min(1.0, c), 4), round(s, 4), round(a, 4), b) for (doc, i), (s, c, a, b) in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "start"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return ids.mapInPandas(run, MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, start (word) of each document that repeats an item.

    Null and empty texts, on either side, match nothing; a null doc_id can match and stays null; repeated documents
    each match; empty tables give an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = [(r["item_id"], r["text"]) for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").collect()]  # the query set
    items = Block.of(rows).items
    found = []
    if items:
        numbers = {w: number_of(w) for _, text in rows for w in words_of(text)}
        ids = staged(encoded(docs, numbers))
        space = latent_space(ids, items)
        found = [search(ids, Block(list(some)), space) for some in batched(items, BLOCK_ITEMS)]
    empty = docs.sparkSession.createDataFrame([], MATCH)
    return reduce(DataFrame.unionByName, found) if found else empty


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that repeat a benchmark item; rows with a null doc_id stay."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
