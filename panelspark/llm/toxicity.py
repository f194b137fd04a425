"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to symbols: insult (words and stems whose weights are learned from labels), threat, target, negation,
reported speech, quotation, clause end, line end, other. Five small transducers rewrite the symbols: reported speech flags what is
quoted or attributed, negation flags what is negated within reach, target flags what stands in a clause with a person in it
(it guesses at the clause's start, and a wrong guess dies at its end), threat turns threats aimed at a person into matches, and
insult turns insults into matches. Arcs carry weights: those of matches say how far a pattern such as `insult, aimed` or
`insult, negated` counts, an insult that stands alone counting half until labels say otherwise. The five are composed into one
transducer, which runs over a text once. A clause counts by its heaviest match, and a document's score combines its matched
clauses, never isolated words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that training reads (those with the smallest hashes of doc_id), and most lexicon entries kept.
TRAIN_ROWS = 20000
LEXICON = 5000
CANDIDATES = 50000
#: A lexicon entry needs so many toxic documents of different content, and so large a share of toxic ones among all that hold it.
LEAST_DOCS = 5
LEAST_SHARE = 0.85
STEMS = (4, 5, 6)

# Closed word classes of the four languages that the grammar knows.
TARGETS = "you your yours yourself u they them he she him her du dich dir ihr euch sie tu te toi vous ton ta usted tú ti ustedes vosotros ellos".split()
NEGATIONS = "not never isn't aren't don't nicht kein keine nie pas jamais ni nunca jamás tampoco".split()
REPORTS = "said says saying wrote quoted claimed called reported sagte schrieb zitierte dit écrit disait dijo escribió según".split()
THREATS = "kill murder stab strangle shoot umbringen töten erschießen tuer égorger matar apuñalar".split()

#: Symbols that words are mapped to, and those that matches and clause ends become.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, BREAK, MATCH_INSULT, MATCH_THREAT = range(11)
WORDS = range(BREAK + 1)
#: Flags that transducers add to an insult or a threat; a symbol with flags is symbol + FLAG * flags.
REPORTED, NEGATED, AIMED, FLAG = 1, 2, 4, 16
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|]|[\"“”«»]")
_ENDS, _QUOTES = set(".!?;:|"), set('"“”«»')
#: How many words a negation reaches.
REACH = 3
#: Weight of a threatening word.
THREAT_WEIGHT = 0.9

#: Weights of patterns (match, flags) before any label is seen, and for how many documents this counts in learning.
PRIOR = {(m, f): w for m in (MATCH_INSULT, MATCH_THREAT) for f, w in enumerate([0.5, 0.4, 0.3, 0.3, 1.0, 0.6, 0.4, 0.4])}
PRIOR_DOCS = 5.0

Arc = tuple[int, float, int]  # output, weight, next state


@dataclass
class Transducer:
    """Letter-to-letter transducer: arcs[state][input] are its (output, weight, next state)."""

    arcs: list[dict[int, list[Arc]]]
    starts: list[int]
    finals: set[int]


def transducer(states: int, inputs: list[int], step: Callable[[int, int], list[Arc]], starts: list[int], finals: set[int]) -> Transducer:
    """From a function that gives the arcs of (state, input)."""
    return Transducer([{x: arcs for x in inputs if (arcs := step(q, x))} for q in range(states)], starts, finals)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that rewrites by a and then by b; weights multiply. States that reach no final state are left out."""
    number: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int]] = []

    def state(pair: tuple[int, int]) -> int:
        if pair not in number:
            number[pair] = len(number)
            todo.append(pair)
        return number[pair]

    starts = [state((p, q)) for p in a.starts for q in b.starts]
    arcs: list[dict[int, list[Arc]]] = []
    for p, q in todo:  # grows as states are found
        here: dict[int, list[Arc]] = {}
        for x, first in a.arcs[p].items():
            here[x] = [(z, w * v, state((p2, q2))) for y, w, p2 in first for z, v, q2 in b.arcs[q].get(y, [])]
        arcs.append(here)
    finals = {n for (p, q), n in number.items() if p in a.finals and q in b.finals}
    live, grown = set(finals), True
    while grown:
        more = {n for n, here in enumerate(arcs) if n not in live and any(nxt in live for out in here.values() for _, _, nxt in out)}
        grown, live = bool(more), live | more
    return Transducer([{x: kept for x, out in here.items() if (kept := [arc for arc in out if arc[2] in live])} for here in arcs], [n for n in starts if n in live], finals)


def _flagged(inputs: list[int], flag: int) -> list[int]:
    return inputs + [x + FLAG * flag for x in inputs if x % FLAG in (INSULT, THREAT)]


_PLAIN = list(WORDS)
_AFTER_REPORT = _flagged(_PLAIN, REPORTED)
_AFTER_NEGATION = _flagged(_AFTER_REPORT, NEGATED)
_AFTER_TARGET = _flagged(_AFTER_NEGATION, AIMED)
_AFTER_THREAT = [x for x in _AFTER_TARGET if x % FLAG != THREAT] + [MATCH_THREAT + FLAG * f for f in range(8)]


def reported_transducer() -> Transducer:
    """States: plain, reporting word in the clause, inside a quotation, both. A line end closes quotations."""

    def step(q: int, x: int) -> list[Arc]:
        reporting, quoted = q & 1, q >> 1
        out = x + FLAG * REPORTED if q and x in (INSULT, THREAT) else x
        if x == REPORT:
            reporting = 1
        elif x == QUOTE:
            quoted = 1 - quoted
        elif x == END:
            reporting = 0
        elif x == BREAK:
            reporting = quoted = 0
        return [(out, 1.0, reporting + 2 * quoted)]

    return transducer(4, _PLAIN, step, [0], set(range(4)))


def negation_transducer() -> Transducer:
    """State: how many more words the last negation reaches, plus one."""

    def step(q: int, x: int) -> list[Arc]:
        out, kind = x, x % FLAG
        if kind in (INSULT, THREAT) and q:
            out = x + FLAG * NEGATED
        nxt = {NEGATION: REACH + 1, END: 0, BREAK: 0, OTHER: max(0, q - 1)}.get(kind, q)
        return [(out, 1.0, nxt)]

    return transducer(REACH + 2, _AFTER_REPORT, step, [0], set(range(REACH + 2)))


def target_transducer() -> Transducer:
    """States: a target is promised, it has been met, none is promised. A clause begins with either promise."""
    promised, met, none = range(3)

    def step(q: int, x: int) -> list[Arc]:
        kind = x % FLAG
        if kind in (END, BREAK):
            return [] if q == promised else [(x, 1.0, promised), (x, 1.0, none)]
        if kind == TARGET:
            return [] if q == none else [(x, 1.0, met)]
        return [(x + FLAG * AIMED if q != none and kind in (INSULT, THREAT) else x, 1.0, q)]

    return transducer(3, _AFTER_NEGATION, step, [promised, none], {none})


def threat_transducer(weights: dict[tuple[int, int], float]) -> Transducer:
    """Aimed threats become matches, other threats nothing."""

    def step(q: int, x: int) -> list[Arc]:
        kind, flags = x % FLAG, x // FLAG
        if kind != THREAT:
            return [(x, 1.0, 0)]
        return [(MATCH_THREAT + FLAG * flags, THREAT_WEIGHT * weights[MATCH_THREAT, flags], 0)] if flags & AIMED else [(OTHER, 1.0, 0)]

    return transducer(1, _AFTER_TARGET, step, [0], {0})


def insult_transducer(weights: dict[tuple[int, int], float]) -> Transducer:
    """Insults become matches; of all else only matches and clause ends remain."""

    def step(q: int, x: int) -> list[Arc]:
        kind, flags = x % FLAG, x // FLAG
        if kind == INSULT:
            return [(MATCH_INSULT + FLAG * flags, weights[MATCH_INSULT, flags], 0)]
        return [(x if kind in (MATCH_THREAT, END, BREAK) else OTHER, 1.0, 0)]

    return transducer(1, _AFTER_THREAT, step, [0], {0})


def grammar_parts(weights: dict[tuple[int, int], float]) -> list[Transducer]:
    return [reported_transducer(), negation_transducer(), target_transducer(), threat_transducer(weights), insult_transducer(weights)]


def clause_matches(machine: Transducer, symbols: list[tuple[int, float]]) -> list[list[tuple[int, float]]]:
    """For each clause with any, its matches (match with flags, lexical weight times that of the path's arc), along the
    best path of the machine over (symbol, lexical weight); symbols must end a clause last."""
    out: list[list[tuple[int, float]]] = []
    paths: dict[int, tuple[float, list[tuple[int, float]]]] = {q: (1.0, []) for q in machine.starts}
    for x, lexical in symbols:
        following: dict[int, tuple[float, list[tuple[int, float]]]] = {}
        for q, (before, found) in paths.items():
            for y, w, nxt in machine.arcs[q].get(x, ()):
                weight = before * w
                if nxt not in following or weight > following[nxt][0]:
                    following[nxt] = (weight, [*found, (y, lexical * w)] if y % FLAG in (MATCH_INSULT, MATCH_THREAT) else found)
        paths = following
        if x in (END, BREAK):
            found = max(paths.values(), key=lambda p: p[0])[1]
            if found:
                out.append(found)
            paths = {q: (1.0, []) for q in paths}
    return out


@dataclass
class Grammar:
    """words and stems: weight (share of toxic documents) of each insult; weights: how far each pattern counts."""

    words: dict[str, float]
    stems: dict[str, float]
    base: float = 0.05
    weights: dict[tuple[int, int], float] = field(default_factory=lambda: dict(PRIOR))
    memory: dict[str, tuple[int, float]] = field(default_factory=dict)

    @cached_property
    def machine(self) -> Transducer:
        return reduce(compose, grammar_parts(self.weights))

    def symbol(self, token: str) -> tuple[int, float]:
        """The lexicon: token to (symbol, weight)."""
        got = self.memory.get(token)
        if got is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            got = self.memory[token] = self._symbol(token)
        return got

    def _symbol(self, token: str) -> tuple[int, float]:
        if token == "\n":
            return BREAK, 1.0
        if token in _ENDS:
            return END, 1.0
        if token in _QUOTES:
            return QUOTE, 1.0
        if token in _FIXED:
            return _FIXED[token], 1.0
        weight = max([self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in STEMS if len(token) >= n)])
        return (INSULT, weight) if weight else (OTHER, 1.0)

    def matches(self, text: str | None) -> list[list[tuple[int, float]]]:
        """The matches of each matched clause of a text."""
        symbols = [self.symbol(t) for t in _TOKEN.findall((text or "").lower())]
        if not any(x == INSULT or x == THREAT for x, _ in symbols):
            return []  # the machine makes matches of these only
        return clause_matches(self.machine, [*symbols, (BREAK, 1.0)])


_FIXED = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}


def text_score(text: str | None, grammar: Grammar) -> float:
    """1 minus the product over matched clauses of (1 - weight of the heaviest match), at least the base rate."""
    clean = 1.0 - grammar.base
    for found in grammar.matches(text):
        clean *= 1.0 - min(0.995, max(w for _, w in found))
    return 1.0 - clean


def _share(toxic, plain, base: float, strength: float = 1.0):
    """Share of toxic documents, drawn towards the base rate as if by `strength` documents."""
    return (toxic + strength * base) / (toxic + plain + strength)


def _term_set(text: str | None) -> set[str]:
    words = {w for w in _TOKEN.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _terms(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """Each distinct word and stem of a text (of those in `among`, if given), with the least hash of its three-word shingles:
    copies of a text mostly share it, many near copies have few of them between them, and other texts have others."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms: list[str] = []
            alike: list[int] = []
            for text in pdf["text"].tolist():
                found = _term_set(text)
                tokens = (text or "").lower().split()
                like = min((zlib.crc32(" ".join(tokens[k : k + 3]).encode()) for k in range(max(1, len(tokens) - 2))), default=0)
                found = found if shared.value is None else found & shared.value
                terms += found
                alike += [like] * len(found)
            if terms:  # Arrow refuses an empty column of strings
                yield pd.DataFrame({"term": terms, "alike": alike})

    return texts.select("text").mapInPandas(run, "term string, alike long")


def learn_grammar(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Lexicon and context weights from at most `rows` labelled texts; docs and labels hold what may be learned from.

    Terms are counted by Spark; at most CANDIDATES that pass LEAST_DOCS come to the driver, and at most LEXICON that also
    pass LEAST_SHARE are kept. The sampled labels are broadcast; their number is bounded. Of labels that repeat a doc_id the
    largest holds; null labels and doc_ids are left out; without toxic labels the lexicon is empty and threats alone score.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    toxic_rate = sample.agg(F.avg("toxic").alias("p")).first()["p"]
    if not toxic_rate:
        return Grammar({}, {}, base=0.05)
    # Toxic texts first: few. On both sides copies of a text count once, lest they make its chance words look like insults or clean.
    held = _terms(texts.where("toxic = 1")).distinct().groupBy("term").agg(F.count("*").alias("t")).where(F.col("t") >= LEAST_DOCS)
    toxic = {r["term"]: r["t"] for r in held.orderBy(F.desc("t"), "term").limit(CANDIDATES).collect()}
    plain = {r["term"]: r["n"] for r in _terms(texts.where("toxic = 0"), set(toxic)).distinct().groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most CANDIDATES
    ranked = sorted(((_share(t, plain.get(term, 0), toxic_rate), t, term) for term, t in toxic.items()), reverse=True)
    entries = [{"term": term, "w": w} for w, _, term in ranked[:LEXICON] if w >= LEAST_SHARE]
    words = {r["term"]: r["w"] for r in entries if not r["term"].endswith("*")}
    stems = {r["term"][:-1]: r["w"] for r in entries if r["term"].endswith("*")}
    shared = docs.sparkSession.sparkContext.broadcast(Grammar(words, stems, weights={k: 1.0 for k in PRIOR}))

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [(int(m), int(t)) for text, t in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), strict=True) for m in {m for found in shared.value.matches(text) for m, _ in found}]
            yield pd.DataFrame(seen, columns=["pattern", "toxic"])

    weights = dict(PRIOR)
    for r in texts.mapInPandas(patterns, "pattern int, toxic int").groupBy("pattern").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect():  # sixteen patterns
        key = (r["pattern"] % FLAG, r["pattern"] // FLAG)
        weights[key] = (r["t"] + PRIOR_DOCS * PRIOR[key]) / (r["n"] + PRIOR_DOCS)
    return Grammar(words, stems, base=0.05, weights=weights)


SCORE = "doc_id long, score double"


def toxicity_scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text); null and empty texts get the base rate.

    Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = np.array([text_score(t, shared.value) for t in pdf["text"].tolist()], np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, SCORE)
