"""How filters interact: what each removes at each step of every order, and its share over all orders.

Every document gets the mask of filters it fails; only counts per part and mask go on. The subsets of filters form a
lattice whose paths from the empty set to the full one are the orders. Counting the paths that reach a state (forward)
and that leave it (backward) weights each edge, so a filter's removals summed over all orders need one sum over the
edges of the lattice instead of one pass an order; the steps of a given order are read from the same edges.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAPS = r"[\x20\x09-\x0D]+"
#: n filters have n! orders of n rows each for every part.
MOST_FILTERS = 7


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone; words: its words, split at white space."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAPS), lambda w: w != "")


def mask_of(conditions: list[Column]) -> Column:
    """Bit i is set if condition i holds; an unknown condition does not."""
    out = F.lit(0)
    for i, failed in enumerate(conditions):
        out = out + F.when(failed, 1 << i).otherwise(0)
    return out


def lattice(n: int) -> tuple[list[int], list[int]]:
    """Paths from the empty set to each subset of n filters, and from each subset to the full set."""
    states = range(1 << n)
    reach, leave = [0] * len(states), [0] * len(states)
    reach[0] = leave[-1] = 1
    for s in states:
        for i in range(n):
            if s >> i & 1:
                reach[s] += reach[s ^ 1 << i]
    for s in reversed(states):
        for i in range(n):
            if not s >> i & 1:
                leave[s] += leave[s | 1 << i]
    return reach, leave


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents per part and failing mask (bits A to E): part, mask, n, good, toxic.

    E, a copy of a smaller doc_id's text, is decided without bringing copies together: rows are counted per text and
    part first, and the smallest identifier of a text travels with its count. Rows that repeat the smallest doc_id of
    their text pass E; so does a null doc_id, which has no labels either. Of repeated labels one that is 1 counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    worded = whole.withColumn("words", words_of(F.col("text")))
    alone = text_filters(F.col("text"), F.col("words"))
    rows = worded.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask_of(list(alone.values())).alias("mask"))
    per = rows.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("c"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("salt", F.lit(0))
    # Null identifiers meet no label; the salt keeps them out of one task.
    salted = per.withColumn("salt", F.when(F.col("id").isNull(), F.abs(F.xxhash64("sha")) % 4096 + 1).otherwise(0).cast("int"))
    known = salted.join(marks, ["id", "salt"], "left").select("id", "part", "sha", "mask", "c", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kinds = known.groupBy("sha", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first"))
    # At most four rows a part for each text, however many copies it has.
    smallest = F.min("first.id").over(Window.partitionBy("sha"))
    judged = kinds.withColumn("pass", F.col("unnamed") + F.when(F.col("first.id") == smallest, F.col("first.c")).otherwise(0))
    copies = 1 << len(alone)
    split = judged.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("pass").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - F.col("pass")).alias("n")))).alias("e"))
    n = F.col("e.n")
    return split.groupBy("part", F.col("e.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def order_effects(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    counts: part, mask, n, good, toxic (masks may repeat or be missing); names: one letter a filter, at most
    MOST_FILTERS of them. A part without rows gives no rows.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or len(set(names)) != k:
        raise ValueError(f"between 1 and {MOST_FILTERS} distinct filter names, not {names!r}")
    left = lambda value, s: F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(value)).otherwise(0))
    states = range(1 << k)
    per = counts.groupBy("part").agg(
        *[F.array(*[left(v, s) for s in states]).alias(f"_{v}") for v in ("n", "good", "toxic")],
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]).alias("_unique"),
    )
    reach, leave = lattice(k)
    edge = lambda s, i: F.get("_n", F.lit(s)) - F.get("_n", F.lit(s | 1 << i))
    share = [sum((F.lit(reach[s] * leave[s | 1 << i]) * edge(s, i) for s in states if not s >> i & 1), F.lit(0)) for i in range(k)]
    steps, bit = [], {name: i for i, name in enumerate(names)}
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, bit[name], before, before | 1 << bit[name]))
            before |= 1 << bit[name]
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int,after:int>>"
    path = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before", "after"), s, strict=True)) for s in steps])), kind)
    walked = per.withColumn("_share", F.array(*share)).select("*", F.explode(path).alias("e")).select("*", "e.*")
    lost = lambda v: F.get(v, F.col("before")) - F.get(v, F.col("after"))
    return walked.select(
        "part",
        "filter_order",
        "step",
        F.get("_n", F.col("after")).alias("kept"),
        lost("_n").alias("removed"),
        (F.get("_n", F.lit(0)) - F.get("_n", F.expr("shiftleft(1, bit)")) - lost("_n")).alias("redundant"),
        F.get("_unique", F.col("bit")).alias("unique_fails"),
        lost("_good").alias("good_lost"),
        lost("_toxic").alias("toxic_lost"),
        F.get("_share", F.col("bit")).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for filters A to E.

    Null texts count as empty, null parts as the empty part. An empty table of documents gives no rows; columns of
    other names are ignored. See failure_counts for repeated and null identifiers.
    """
    return order_effects(failure_counts(docs, labels))
