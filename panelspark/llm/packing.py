"""Best-fit packing planned on a histogram of lengths.

Texts become token pieces of at most `capacity`. Only the histogram of piece lengths (at most
`capacity` rows) reaches the driver, where best-fit decreasing runs over counts: many equal
pieces are placed into many equally filled sequences in one step. The plan is a short list of
runs (length, first rank, number, first sequence, offset), and pieces take their places by
their rank within their length. Ranks come from counts per (length, salt); frequent lengths have more salts.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 4096
#: Least number of salts of a length, and pieces for each salt where that gives more.
SALTS, ROWS_PER_SALT = 64, 1 << 18
END_ID = 1
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks whose ids a task remembers in each of two generations: a full one becomes the older, and what is met again
#: moves back. Chunks of up to LONGEST characters are remembered, from the second time they are met (by a table of DOORS
#: hashes), so a generation takes at most some 20 MB.
REMEMBERED = 100_000
LONGEST = 48
DOORS = 1 << 21
#: Letters and signs whose lower case, composition and splitting are plain: words, digits and runs of signs are tokenised apart.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~ \t\n\r]*")
#: What a tokenizer must do to a text for its ids to be those of its chunks between blanks.
CHUNKED_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CHUNKED_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_WORD = re.compile(rf"[{_LETTERS}]+")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")
#: A stop or comma that belongs to a run of signs.
_RUN = re.compile(rf"[^{_LETTERS}0-9\s][.,](?:\s|$)")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def works_by_chunks(tokenizer) -> bool:
    """Whether the tokenizer's normaliser, pre-tokeniser and merges are those that ChunkTokenizer takes apart."""
    state = lambda part: json.loads(part.__getstate__()) if part is not None else None
    model = state(tokenizer.model)
    return (
        state(tokenizer.normalizer) == CHUNKED_NORMALIZER
        and state(tokenizer.pre_tokenizer) == CHUNKED_SPLIT
        and model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and tokenizer.truncation is None
        and tokenizer.padding is None
    )


class ChunkTokenizer:
    """Ids of texts under a lower-casing byte-level tokenizer that drops white space, put together from remembered ids.

    Any other tokenizer (works_by_chunks says which) encodes each text whole.

    A blank ends every token of such a vocabulary, so a text's ids are the ids of its chunks between blanks one after
    the other. In plain texts stops and commas are set apart first, which changes nothing, and words, digits and runs
    of signs go straight to the merges; all other chunks, and texts that hold the string of an added token, go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunks = works_by_chunks(self.tokenizer)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.forget()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def forget(self) -> None:
        """Empty the memory; workers live on from task to task, and later stages need the room."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.doors = bytearray(DOORS)

    def _part(self, part: str) -> list[int]:
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(word)]

    def _ids(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):
            ids = self._part(chunk.lower())
        elif _PLAIN.fullmatch(chunk):
            ids = [i for part in _PARTS.findall(chunk.lower()) for i in self._part(part)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.by_chunks or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if _PLAIN.fullmatch(text):
            text = text.lower()
            if not _RUN.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
            text = text.replace("\n", " ")
        chunks = text.split(" ")
        if len(self.young) > REMEMBERED:
            self.old, self.young, self.doors = self.young, {}, bytearray(DOORS)
        young, old, doors, once = self.young, self.old, self.doors, []
        for chunk in set(chunks).difference(young):
            ids = old.get(chunk)
            if ids is None:
                ids, door = self._ids(chunk), hash(chunk) % DOORS
                if not doors[door] or len(chunk) > LONGEST:
                    doors[door] = 1
                    once.append(chunk)
            young[chunk] = ids
        out = np.frombuffer(b"".join(map(young.__getitem__, chunks)), dtype=np.uint32)
        for chunk in once:
            del young[chunk]
        return out


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One per worker process, kept from task to task."""
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; null text is empty and still ends with END_ID."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer_of(tokenizer_path)
        for pdf in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for name, value in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        rows[name].append(value)
            yield pd.DataFrame(rows).astype({"doc_id": "Int64"})
        encoder.forget()

    return docs.select("doc_id", "text").mapInPandas(run, PIECE_SCHEMA)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place every piece of the histogram.

    Best-fit decreasing over counts. `room` maps free space to runs of sequences with that much left.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def keep(space: int, first: int, number: int) -> None:
        if space > 0:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        freed: list[tuple[int, int, int]] = []
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, number = room[space].pop()
                each, take = 1, min(number, left)
                if take < number:
                    room[space].append((first + take, number - take))
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            else:  # open sequences, each with as many pieces of this length as fit
                space, first = capacity, sequences
                each = min(capacity // length, left)
                take = max(1, left // each)
                sequences += take
            for j in range(each):
                plan.append((length, rank, take, first, capacity - space + j * length))
                rank += take
            left -= each * take
            rest = space - each * length
            if rest >= length:
                keep(rest, first, take)
            else:
                freed.append((rest, first, take))
        for rest, first, take in freed:
            keep(rest, first, take)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """pieces with sequence_id and offset: every sequence is filled gaplessly from 0 up to capacity at most.

    Rows with equal lengths are ranked by (hash of doc_id, doc_id, piece), ties by their other columns, so repeated rows
    take places of their own. An empty table gives an empty result.
    """
    pieces = staged(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    crowded = {length: -(-n // ROWS_PER_SALT) for length, n in histogram.items() if n > salts * ROWS_PER_SALT}
    several = reduce(lambda c, kv: c.when(F.col("length") == kv[0], F.lit(kv[1])), crowded.items(), F.when(F.lit(False), F.lit(salts))).otherwise(F.lit(salts))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), several).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    plan = best_fit_plan(histogram, capacity)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    runs = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    for length in histogram:
        mine = runs[runs[:, 0] == length]
        by_length[length] = (mine[:, 1], mine[:, 3], mine[:, 4])
    places = pieces.sparkSession.sparkContext.broadcast(by_length)

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    mine = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(mine) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_at") + F.col("_in"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(part):
                    firsts, sequences, offsets = places.value[int(lengths[part[0]])]
                    at = np.searchsorted(firsts, ranks[part], side="right") - 1
                    sequence[part] = sequences[at] + ranks[part] - firsts[at]
                    offset[part] = offsets[at]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places (see token_pieces and pack)."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
