"""Fill-in-middle by in-place block rotation.

A task holds one text at a time as a bytearray: the ends of its units are scanned, the three sentinels inserted
at the cuts, and segments exchanged by rotations, each of three reversals that swap blocks from both ends. The same
rotations, inverted, restore the text. UTF-8 needs no decoding: white space and sentinels are ASCII, and cuts stand
only before or after such bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal moves at once.
BLOCK = 1 << 16
#: Bytes of texts after which a batch goes back to Spark.
FLUSH_BYTES = 8 << 20


def unit_ends(text: bytes) -> np.ndarray:
    """Offset after each unit: white space with the word after it, or the white space at the end."""
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    last = np.ones(len(b), bool)
    last[:-1] = ~space[:-1] & space[1:]
    return np.flatnonzero(last) + 1


def code_points(text: bytes) -> int:
    """Bytes that do not continue a UTF-8 sequence."""
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse view[lo:hi] in place, swapping blocks from both ends."""
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        head = view[lo : lo + k].copy()
        view[lo : lo + k] = view[hi - k : hi][::-1]
        view[hi - k : hi] = head[::-1]
        lo, hi = lo + k, hi - k


def rotate(view: np.ndarray, lo: int, mid: int, hi: int) -> None:
    """Exchange view[lo:mid] and view[mid:hi] in place."""
    reverse(view, lo, mid)
    reverse(view, mid, hi)
    reverse(view, lo, hi)


def arrange(text: bytes, a: int, b: int, form: str) -> bytearray:
    """text cut at byte offsets a <= b, with sentinels, in the order of form (psm or spm)."""
    buffer = bytearray(text)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    view = np.frombuffer(buffer, np.uint8)
    m, s, end = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b, len(view)
    rotate(view, m, s, end)  # prefix, suffix, middle
    if form == "spm":
        rotate(view, 0, m, m + end - s)
    return buffer


def restore(output: bytes, form: str) -> bytearray:
    """The text that arrange() was given, from its output and form."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    p, s, m = (buffer.index(mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    view, end = np.frombuffer(buffer, np.uint8), len(buffer)
    if form == "spm":
        rotate(view, s, p, m)
        s = m - p
    rotate(view, s, m, end)
    del view
    m, s = s, s + end - m
    for at, mark in ((s, SUFFIX), (m, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(mark)]
    return buffer


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """rows as record batches of about FLUSH_BYTES in column `weight`."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[weight])
        if size >= FLUSH_BYTES or len(kept) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    Cuts, form and order come from SHA-256 of `seed:doc_id`, so rows repeated with one doc_id are treated alike and no
    row depends on another. A null or empty text stays as it is (plain, n = 0); so does a text that contains a sentinel.
    A null doc_id hashes as `seed:`. Of texts of white space only the one unit is all of it. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = pa.schema([("name", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def one(name: str, text: bytes) -> tuple:
        h = [int(x, 16) for x in (lambda s: (s[0:8], s[8:16], s[16:24], s[24:32]))(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest())]
        ends = unit_ends(text)
        n = len(ends)
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= percent:
            return name, n, "plain", None, None, text
        a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        return name, n, form, code_points(text[:a]), code_points(text[a:b]), bytes(arrange(text, a, b, form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids pass as text: any identifier type comes back by one cast
        yield from _batches((one(i.as_py(), t.as_py()) for batch in batches for i, t in zip(batch["name"], batch["text"], strict=True)), out, 5)

    kind = rows.schema["doc_id"].dataType.simpleString()
    done = rows.select("name", "text").mapInArrow(run, "name string, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.select(F.when(F.col("name") != "", F.col("name")).cast(kind).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored_texts(formatted: DataFrame) -> DataFrame:
    """All columns of fill_in_middle's result and `text`, rebuilt from output and form alone."""
    kept = [c for c in formatted.columns if c != "output"]
    schema = formatted.select(*kept).schema.add("output", "binary").add("text", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([bytes(restore(o.as_py(), f.as_py())) for o, f in zip(batch["output"], batch["form"], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    rows = formatted.select(*kept, F.col("output").cast("binary").alias("output")).mapInArrow(run, schema)
    return rows.withColumns({"output": F.col("output").cast("string"), "text": F.col("text").cast("string")})
