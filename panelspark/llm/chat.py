"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string. Nothing is assumed of its markup: the operator renders
successive turn prefixes and compares consecutive outputs. What an output has that the one before has not is the turn's
span: at the end, or before a trailer that both share. Where an earlier output is not kept whole around that span, the
template rewrites history; such templates are reported, and their turns are measured on the last output only. Inside a
turn's span the text is what changes between two renderings of the turn with probe texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, staged

Message = dict[str, str]
Template = Callable[[list[Message]], str]

#: A text may not open a marker: these characters get a backslash, and the backslash itself too.
_CONTROL = re.compile(r"[\\<\[|]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PROBES = ("a", "b")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def instruct_template(messages: list[Message]) -> str:
    """<s>, then each turn as [ROLE]role[/ROLE]text</turn>; roles and texts are escaped."""
    return "<s>" + "".join(f"[ROLE]{escape(m['role'])}[/ROLE]{escape(m['text'])}</turn>" for m in messages)


_TURN = re.compile(r"\[ROLE\]((?:[^\\\[<|]|\\.)*)\[/ROLE\]((?:[^\\\[<|]|\\.)*)</turn>", re.S)


def read_back(formatted: str, whole: bool = True) -> list[Message]:
    """The messages of an output of instruct_template, or of a later part of one."""
    head = "<s>" if whole else ""
    found, at = [], len(head)
    for m in _TURN.finditer(formatted, at):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        found.append({"role": unescape(m[1]), "text": unescape(m[2])})
        at = m.end()
    if not formatted.startswith(head) or at != len(formatted):
        raise ValueError("not an output of this template")
    return found


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _shared_end(a: str, b: str, most: int) -> int:
    """Length of the longest common suffix, at most `most`."""
    return _shared(a[len(a) - most :][::-1], b[len(b) - most :][::-1]) if most else 0


def added(before: str, after: str) -> tuple[int, int, bool]:
    """(start, end) of what `after` has and `before`, the output of one turn less, has not, and whether more than that changed."""
    start = _shared(before, after)
    tail = _shared_end(before, after, min(len(before), len(after)) - start)
    return start, len(after) - tail, start + tail < len(before)


def _changing(a: str, b: str) -> tuple[int, int]:
    """Lengths of what two renderings that differ in one text share before and after it."""
    before = _shared(a, b)
    return before, _shared_end(a, b, min(len(a), len(b)) - before)


def render_turns(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The whole output, (start, end) of each turn and of each turn's text in it, and whether the template rewrote history.

    A text that lies outside its turn's span, as far as consecutive outputs tell it, or a turn in front of an earlier
    text, counts as rewritten history too.
    """
    last, rewrites = template([]), False
    turns: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    for k, message in enumerate(messages):
        out = template(messages[: k + 1])
        start, end, changed = added(last, out)
        before, after = _changing(*[template([*messages[:k], {**message, "text": p}]) for p in _PROBES])
        rewrites |= changed or before < start or len(out) - after > end or (bool(texts) and start < texts[-1][1])
        turns.append((start, end))
        texts.append((before, len(out) - after))
        last = out
    if rewrites:  # earlier outputs no longer tell where a turn stands: each is left out of and probed in the whole
        turns, texts = [], []
        for k, message in enumerate(messages):
            start, end, _ = added(template([*messages[:k], *messages[k + 1 :]]), last)
            before, after = _changing(*[template([*messages[:k], {**message, "text": p}, *messages[k + 1 :]]) for p in _PROBES])
            texts.append((before, len(last) - after))
            turns.append((min(start, before), max(end, len(last) - after)))
    return last, turns, texts, rewrites


def render_spans(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole output, (start, end) of each turn's text in it, and whether the template rewrote history."""
    whole, _, texts, rewrites = render_turns(messages, template)
    return whole, texts, rewrites


def render_part(context: list[Message], own: list[Message], following: list[Message], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """What the own turns add to the output of a conversation of which `context` goes before and `following`, one turn or none, after.

    As render_turns, with places counted from the start of the part. Parts of one conversation, put one after the other,
    are its whole output, if the template does not rewrite history: both sides of a cut take the place from the two same
    turns, where the output of one turn more begins to differ.
    """
    if not context and not following:
        return render_turns(own, template)
    last, rewrites = template(context), False
    turns: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    for k, message in enumerate(own):
        before_it = context + own[:k]
        out = template([*before_it, message])
        start, end, changed = added(last, out)
        before, after = _changing(*[template([*before_it, {**message, "text": p}]) for p in _PROBES])
        rewrites |= changed or before < start or len(out) - after > end or (bool(texts) and start < texts[-1][1])
        turns.append((start, end))
        texts.append((before, len(out) - after))
        last = out
    cut = len(last)
    if following:
        cut, _, changed = added(last, template([*context, *own, *following]))
        rewrites |= changed
    first = turns[0][0] if context else 0
    move = lambda spans: [(s - first, e - first) for s, e in spans]
    return last[first:cut], move(turns), move(texts), rewrites


SPANS = "array<struct<start:long,end:long>>"
SCHEMA = f"conv_id long, n_turns long, formatted string, loss_spans {SPANS}, turn_spans {SPANS}, rewrites_history boolean"
PART_SCHEMA = f"conv_id long, place long, n_turns long, formatted string, loss_spans {SPANS}, turn_spans {SPANS}, rewrites_history boolean"

#: Rows that one task renders together, and turns before them that it renders along for what a template looks back to.
BLOCK, CONTEXT = 64, 8


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "end": e} for s, e in spans]


def _loss(messages: list[Message], texts: list[tuple[int, int]], role: str) -> list[dict[str, int]]:
    return _spans([span for m, span in zip(messages, texts, strict=True) if m["role"] == role])


def _conv(value: object) -> object:
    return None if pd.isna(value) else value


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [field.split()[0] for field in schema.replace(SPANS, "spans").split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def _whole_conversations(ordered: DataFrame, template: Template, loss_role: str) -> DataFrame:
    """Conversations rendered whole, one after the other; ordered (conv_id, role, text) holds each in one partition, in order."""

    def one(conv: object, messages: list[Message]) -> tuple:
        whole, turns, texts, rewrites = render_turns(messages, template)
        return conv, 0, len(messages), whole, _loss(messages, texts, loss_role), _spans(turns), rewrites

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: list[Message] = []
        conv: object = None
        for pdf in batches:
            done = []
            for c, role, text in zip(pdf["conv_id"].astype("Int64").tolist(), pdf["role"].tolist(), pdf["text"].tolist(), strict=True):
                c = _conv(c)
                if current and c != conv:
                    done.append(one(conv, current))
                    current = []
                conv = c
                current.append({"role": role, "text": text})
            if done:
                yield _frame(done, PART_SCHEMA)
        if current:
            yield _frame([one(conv, current)], PART_SCHEMA)

    return ordered.mapInPandas(run, PART_SCHEMA)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and place, the row's number in the order of conv_id, turn, role and text over the whole table.

    Rows are sorted by ranges, so a conversation of any length lies on as many tasks as it needs; only the ranges' row
    counts come to the driver. Rows alike in all but what follows the first 63 characters of the role, or 255 of the
    text, share a range.
    """
    spark = conversations.sparkSession
    short = F.length("role") < 64
    head = F.when(short, F.left("text", F.lit(256)))
    tie = F.when(short & (F.length("text") < 256), F.monotonically_increasing_id())  # equal rows may go anywhere
    rows = _rows(conversations).repartitionByRange(shuffle_width(spark), "conv_id", "turn", F.left("role", F.lit(64)), head, tie)
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = staged(ordered.select("conv_id", "role", "text", F.spark_partition_id().alias("range"), within.alias("within")))
    counts = sorted((r["range"], r["count"]) for r in stored.groupBy("range").count().collect())  # one row a range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "range int, before long")
    return stored.join(F.broadcast(offsets), "range").select("conv_id", "role", "text", (F.col("before") + F.col("within")).alias("place"))


def _block_parts(numbered: DataFrame, template: Template, loss_role: str, block: int, context: int) -> DataFrame:
    """PART_SCHEMA and settled: false where the part alone does not tell that it fits into the whole conversation's output."""
    own, within = F.floor(F.col("place") / block), F.col("place") % block
    seen_by = F.array_compact(F.array(own, F.when(within >= block - context - 1, own + 1), F.when((within == 0) & (own > 0), own - 1)))
    rows = numbered.select("conv_id", "role", "text", "place", F.explode(seen_by).alias("block"))
    schema = PART_SCHEMA + ", settled boolean"

    def part(conv: object, rows: list[tuple[int, Message]], number: int) -> tuple | None:
        before = [m for at, m in rows if at < number * block]
        mine = [m for at, m in rows if number * block <= at < (number + 1) * block]
        after = [m for at, m in rows if at >= (number + 1) * block]
        if not mine:
            return None
        place = next(at for at, _ in rows if at >= number * block)
        if len(before) <= context:  # the conversation begins within sight
            text, turns, texts, rewrites = render_part(before, mine, after, template)
            settled = not rewrites or not (before or after)
        else:
            try:
                text, turns, texts, rewrites = render_part(before, mine, after, template)
                settled = not rewrites and text == _part_text(before[1:], mine, after, template)
            except Exception:  # noqa: BLE001  a template may refuse a conversation without its beginning; the whole tells
                text, turns, texts, rewrites, settled = "", [], [(0, 0)] * len(mine), False, False
        return conv, place, len(mine), text, _loss(mine, texts, loss_role), _spans(turns), rewrites, settled

    def block_of(number: int, rows: list[tuple[object, int, Message]]) -> list[tuple]:
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            found = part(rows[at][0], [(place, m) for _, place, m in rows[at:end]], number)
            out += [found] if found else []
            at = end
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: list[tuple[object, int, Message]] = []
        number: int | None = None
        for pdf in batches:
            for c, role, text, place, n in zip(pdf["conv_id"].astype("Int64").tolist(), pdf["role"].tolist(), pdf["text"].tolist(), pdf["place"].tolist(), pdf["block"].tolist(), strict=True):
                if current and n != number:
                    done, current = block_of(number, current), []
                    if done:
                        yield _frame(done, schema)
                number = n
                current.append((_conv(c), place, {"role": role, "text": text}))
        if current and (done := block_of(number, current)):
            yield _frame(done, schema)

    return rows.repartition("block").sortWithinPartitions("block", "place").mapInPandas(run, schema)


def _part_text(context: list[Message], own: list[Message], following: list[Message], template: Template) -> str:
    """The text of render_part."""
    first = added(template(context), template([*context, own[0]]))[0]
    out = template([*context, *own])
    return out[first : added(out, template([*context, *own, *following]))[0] if following else len(out)]


def format_parts(conversations: DataFrame, template: Template = instruct_template, loss_role: str = "assistant", block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """The output of each conversation in parts: conv_id, place, n_turns, formatted, loss_spans, turn_spans, rewrites_history.

    A conversation's parts in the order of place, one after the other, are its output; spans count from their part's
    start. Where no conversation has over `block` turns, each is one part. Otherwise all rows, numbered in their order,
    are dealt to tasks in blocks of `block`, each with context + 1 rows before it and one after. A part whose
    conversation begins within sight is rendered from there. Any other is rendered behind context + 1 turns and behind
    one turn less: if both give the same, the template looks back no further. Where they differ, the template refuses, or
    history is rewritten, the conversation is rendered whole, in one task. A template that only looks back further than
    that beyond `context` turns needs a larger context. Order and nulls are those of format_chats.
    """
    longest = conversations.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if longest <= block:
        ordered = _rows(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        return _whole_conversations(ordered.select("conv_id", "role", "text"), template, loss_role)
    numbered = numbered_turns(conversations)
    parts = staged(_block_parts(numbered, template, loss_role, block, context))
    open_ones = parts.where(~F.col("settled")).select(F.col("conv_id").alias("open_id")).distinct()
    parts = parts.drop("settled")
    if open_ones.isEmpty():
        return parts
    is_open = F.col("conv_id").eqNullSafe(F.col("open_id"))
    ordered = numbered.join(open_ones, is_open, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    whole = _whole_conversations(ordered.select("conv_id", "role", "text"), template, loss_role)
    return parts.join(open_ones, is_open, "left_anti").unionByName(whole)


def _in_order(parts: DataFrame, *columns: str) -> DataFrame:
    """Parts of a conversation in one partition, one after the other."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", *columns)


def format_chats(conversations: DataFrame, template: Template = instruct_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, turn_spans, rewrites_history.

    Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have a
    defined order and all are kept; null roles and texts are empty; rows with a null conv_id form one
    conversation. loss_spans cover the texts of loss_role in the formatted string. Long conversations are
    rendered in parts by many tasks (format_parts); here each must fit into one row.
    """
    columns = ["n_turns", "formatted", "loss_spans", "turn_spans", "rewrites_history"]

    def one(conv: object, parts: list[tuple]) -> tuple:
        loss: list[dict[str, int]] = []
        turns: list[dict[str, int]] = []
        at = 0
        for _, text, some, spans, _ in parts:
            loss += _spans([(s["start"] + at, s["end"] + at) for s in some])
            turns += _spans([(s["start"] + at, s["end"] + at) for s in spans])
            at += len(text)
        return conv, sum(p[0] for p in parts), "".join(p[1] for p in parts), loss, turns, any(p[4] for p in parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: list[tuple] = []
        conv: object = None
        for pdf in batches:
            done = []
            for c, *part in zip(pdf["conv_id"].astype("Int64").tolist(), *[pdf[x].tolist() for x in columns], strict=True):
                c = _conv(c)
                if current and c != conv:
                    done.append(one(conv, current))
                    current = []
                conv = c
                current.append(tuple(part))
            if done:
                yield _frame(done, SCHEMA)
        if current:
            yield _frame([one(conv, current)], SCHEMA)

    return _in_order(format_parts(conversations, template, loss_role), *columns).mapInPandas(run, SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """Figures of one conversation, fed part by part, so that memory does not grow with its length."""

    def __init__(self) -> None:
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[dict[str, int]]) -> None:
        for m in read_back(text, whole=self.chars == 0):
            self.said.update(f"{m['role']}\n{m['text']}\n".encode())
            self.turns += 1
        for s in spans:
            learned = unescape(text[s["start"] : s["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(text)

    def row(self, conv: object) -> tuple:
        return conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """Figures read back from outputs of instruct_template, whole (format_chats) or in parts (format_parts).

    A digest takes its text from the first character to the last, so each conversation's parts go through one task, but
    one part at a time.
    """
    ordered = _in_order(formatted, "formatted", "loss_spans") if "place" in formatted.columns else formatted.select("conv_id", "formatted", "loss_spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest: _Digest | None = None
        conv: object = None
        for pdf in batches:
            done = []
            for c, text, spans in zip(pdf["conv_id"].astype("Int64").tolist(), pdf["formatted"].tolist(), pdf["loss_spans"].tolist(), strict=True):
                c = _conv(c)
                if digest is not None and c != conv:
                    done.append(digest.row(conv))
                    digest = None
                digest, conv = digest or _Digest(), c
                digest.feed(text, spans)
            if done:
                yield _frame(done, DIGEST_SCHEMA)
        if digest is not None:
            yield _frame([digest.row(conv)], DIGEST_SCHEMA)

    return ordered.mapInPandas(run, DIGEST_SCHEMA)
