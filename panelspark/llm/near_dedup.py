"""Near-duplicate detection with a MinHash LSH forest.

Texts with the same shingle set become one class first. Each class has one signature, and TREES sorted orders of it: tree t
reads the signature in its own permutation, and its order sorts the classes by those values. Sampled splitters deal each
order out to buckets, a bucket is sorted, and the longest common prefix of every row and the next tells where regions end:
a region of depth d is a run in which neighbours share d values at least. Candidates are texts that share a region. A
region starts at the shallowest depth of LEVELS and deepens where it holds more than BLOCKS * BLOCK texts, or where a
splitter cuts it (adaptive depth). A region of several blocks is worked off as pairs of blocks, so every two of its texts
meet although no task holds more than two blocks. Texts that still share a larger region at the greatest depth, where they
agree almost everywhere, meet their neighbours in the order, block by block. Where signatures in a region agree enough, the full
shingle sets of those texts meet, all their pairs are confirmed by exact counts, and a spanning forest of the confirmed
links goes on to the components. This goes in two rounds, as only components count: in the first FIRST_TREES orders each text
meets its own block, and then all pairs of blocks of all orders meet, but only texts that are still in different components.

Deepening and blocks keep some texts of a crowded region apart. So all texts of regions that were crowded at
the first depth meet once more, by an exact prefix filter: two linked sets share one of their rarest shingles. Only
texts that the first links left in different components are compared there. Of the texts with one such shingle those
outside its largest component meet all others, as pairs of blocks: work grows with texts times outsiders.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, shuffle_width, spread_join, staged
from .components import components

SHINGLE = 5
SIGNATURE = 128
TREES = 24
LEVELS = (3, 4, 5, 8, 11, 15, 20)
#: Highest probability that a pair at the threshold shares no region at the first depth.
LEAST_MISS = 1e-6
#: Most texts of a block; a region holds BLOCKS * BLOCK at most. Blocks of long texts have fewer, so that they hold about MASS
#: shingles, but LEAST_BLOCK at least.
BLOCK, BLOCKS, MASS, LEAST_BLOCK = 512, 4, 1_280_000, 64
#: Shared shingles that a region counts at once.
COLUMNS = 4096
#: Links: percent * union <= 100 * intersection. The contract of op1.
PERCENT = 85
#: Shingles are called rare by counts of so many classes of them.
BUCKETS = 1 << 18
#: Rarer shingles that a text remembers, lest it meet another again.
EARLIER = 24
#: Word hashes that a task remembers.
REMEMBERED = 100_000
#: Orders in which texts meet their own block before anything else.
FIRST_TREES = 4
#: Buckets of the sorted orders for each shuffle partition, and sampled rows for each bucket.
BUCKETS_PER_PARTITION, PER_BUCKET = 4, 32

_RNG = np.random.default_rng(20240229)
_LOW = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_HIGH = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LENGTHS = _RNG.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
_ORDERS = np.stack([_RNG.permutation(SIGNATURE)[: LEVELS[-1]] for _ in range(TREES)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def first_level(percent: int) -> int:
    """The deepest level at which pairs at the threshold miss every tree with probability below LEAST_MISS."""
    fits = [k for k, d in enumerate(LEVELS) if (1 - (percent / 100) ** d) ** TREES < LEAST_MISS]
    if not fits:
        raise ValueError(f"{TREES} trees do not reach a similarity of {percent} %")
    return fits[-1]


def least_equal(percent: int) -> int:
    """How many values of two signatures must agree: a pair at the threshold has fewer with a probability (exact binomial
    tail) no higher than that of sharing no region of the forest."""
    t = percent / 100
    left, k = (1 - t ** LEVELS[first_level(percent)]) ** TREES, 0
    while (left := left - math.comb(SIGNATURE, k) * t**k * (1 - t) ** (SIGNATURE - k)) >= 0:
        k += 1
    return k


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, memory: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles (of the whole sequence, if shorter; empty without words).

    A-Z are lower-cased; words end at space, tab, LF, VT, FF and CR only, which is how bytes split.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((WordHashes() if memory is None else memory).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    s = np.full(n, _LENGTHS[min(len(words), SHINGLE)], np.uint64)
    for j in range(min(SHINGLE, len(words))):
        s += h[j : j + n] * _PLACES[j]
    s ^= s >> np.uint64(32)
    s *= _MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 8192):
        low, high = shingles[k : k + 8192].astype(np.uint32), (shingles[k : k + 8192] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (low[None, :] * _LOW[:, None] + high[None, :] * _HIGH[:, None]).min(axis=1), out=out)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        for pdf in batches:
            sizes, prints, signs = [], [], []
            for text in pdf["text"].tolist():
                s = shingle_set(text, memory)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": sizes, "fingerprint": prints, "signature": signs})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, fingerprint binary, signature binary")


#: A row's place in the sorted orders: tree, LEVELS[-1] values of 16 bits, and a hash of the class, which parts equal ones.
_PLACE_TYPE = np.dtype([("tree", ">u2"), ("values", ">u2", LEVELS[-1]), ("tie", ">u8")])


def _places(reps: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """The places of classes in all orders, class by class; their bytes sort as the orders do."""
    signs = np.frombuffer(b"".join(signatures), np.uint32).reshape(len(reps), SIGNATURE)
    out = np.zeros((len(reps), TREES), _PLACE_TYPE)
    out["tree"] = np.arange(TREES)
    out["values"] = signs[:, _ORDERS] & np.uint32(0xFFFF)
    x = reps.astype(np.uint64) * _MIX
    out["tie"] = ((x ^ (x >> np.uint64(31))) * _MIX)[:, None]
    return out.reshape(-1)


def _order_splitters(classes: DataFrame, first: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places at which the orders are cut, and the depth of each cut.

    A cut falls between two regions of the first level, unless one of these holds more than a bucket's share of the
    sample: then between two regions of the next level that parts them, and at last between equal values.
    """
    rows = sampled(classes.select("rep", "signature"), buckets * PER_BUCKET // TREES + 1).collect()  # bounded by the number of buckets
    if not rows:
        return np.zeros(0, _PLACE_TYPE), np.zeros(0, np.int64)
    size = _PLACE_TYPE.itemsize
    places = _places(np.array([r["rep"] for r in rows], np.int64), [r["signature"] for r in rows])
    raw = np.sort(np.frombuffer(places.tobytes(), f"S{size}"))
    depths = [*LEVELS[first:], size]
    cuts: dict[bytes, int] = {}
    before = b""
    for k in range(1, buckets):
        place = bytes(raw[len(raw) * k // buckets]).ljust(size, b"\0")
        for depth in depths:
            head = place if depth == size else place[: 2 + 2 * depth]
            if before[: len(head)] != head:
                cuts.setdefault(head.ljust(size, b"\0"), min(depth, LEVELS[-1] + 1))
                break
        before = place
    ordered = sorted(cuts)
    return np.frombuffer(b"".join(ordered), _PLACE_TYPE), np.array([cuts[c] for c in ordered], np.int64)


def _bucket_regions(places: np.ndarray, reps: np.ndarray, weights: np.ndarray, first: int, block: int, low: tuple | None, high: tuple | None) -> dict[str, np.ndarray]:
    """Regions of one sorted bucket: rep, tree, region, blocks, mine and crowded; region is null (0 blocks) where a crowded
    class stands alone. weights are the classes' shingles, low and high the bucket's cuts (place, depth)."""
    n = len(places)
    tree, values = places["tree"].astype(np.int64), places["values"]
    same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
    prefix = np.r_[-1, np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)]  # longest common prefix with the row before
    region, blocks, mine = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
    left, crowded = np.ones(n, bool), np.zeros(n, bool)
    seed = np.frombuffer(b"".join(hashlib.blake2b(p.tobytes(), digest_size=8).digest() for p in places[:1]), np.int64)
    for level in range(first, len(LEVELS)):
        depth = LEVELS[level]
        starts = np.flatnonzero(prefix < depth)
        sizes = np.diff(np.r_[starts, n])
        run = np.repeat(np.arange(len(starts)), sizes)
        cut = np.zeros(len(starts), bool)
        for at, side, cuts in ((0, 0, low), (-1, n - 1, high)):
            if cuts is not None and cuts[1] > depth and cuts[0]["tree"] == tree[side] and (cuts[0]["values"][:depth] == values[side, :depth]).all():
                cut[at] = True
        fits = left & ((sizes <= BLOCKS * block) & ~cut)[run]
        some = fits & (sizes > 1)[run]
        at = np.arange(n) - starts[run]
        region[some] = _name(seed, level, starts[run][some])
        each = np.clip(MASS // np.maximum.reduceat(weights, starts), min(LEAST_BLOCK, block), block)[run]
        blocks[some] = -(-sizes[run][some] // each[some])
        mine[some] = at[some] // each[some]
        left &= ~fits
        if level == first:
            crowded = left.copy()
        if not left.any():
            break
    lots, each = np.flatnonzero(left), min(LEAST_BLOCK, block)  # more than fit agree in all values: neighbours meet
    region[lots], blocks[lots] = _name(seed, len(LEVELS), lots // each), 1
    out = np.flatnonzero((blocks > 0) | crowded)
    return {"rep": reps[out], "tree": tree[out].astype(np.int32), "region": region[out], "blocks": blocks[out], "mine": mine[out], "crowded": crowded[out]}


def _name(seed: np.ndarray, level: int, start: np.ndarray) -> np.ndarray:
    """64-bit names of the regions of a bucket, from the bucket's first place, the level and where the region starts."""
    x = (start.astype(np.uint64) * np.uint64(16) + np.uint64(level) + seed.view(np.uint64)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _regions(classes: DataFrame, block: int, percent: int) -> DataFrame:
    """rep, tree, region, blocks, mine, crowded: the region of each class in each tree, how many blocks it has and which is
    the class's, without classes that stand alone; of classes whose region at the first depth is crowded, all rows."""
    first = first_level(percent)
    buckets = BUCKETS_PER_PARTITION * shuffle_width(classes.sparkSession)
    shared = classes.sparkSession.sparkContext.broadcast(_order_splitters(classes, first, buckets))
    size = _PLACE_TYPE.itemsize

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = np.frombuffer(shared.value[0].tobytes(), f"S{size}")
        for pdf in batches:
            for k in range(0, len(pdf), 4096):
                reps = pdf["rep"].to_numpy()[k : k + 4096]
                raw = _places(reps, pdf["signature"].tolist()[k : k + 4096]).tobytes()
                yield pd.DataFrame({"bucket": np.searchsorted(cuts, np.frombuffer(raw, f"S{size}"), side="right").astype(np.int32), "place": [raw[i : i + size] for i in range(0, len(raw), size)], "rep": np.repeat(reps, TREES), "weight": np.repeat(pdf["n_shingles"].to_numpy()[k : k + 4096], TREES)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, depths = shared.value
        for pdf in _by_key(batches, "bucket"):
            bucket = pdf["bucket"].to_numpy()
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            places, reps, weights = np.frombuffer(b"".join(pdf["place"]), _PLACE_TYPE), pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                b = int(bucket[lo])
                low = (cuts[b - 1], depths[b - 1]) if b else None
                high = (cuts[b], depths[b]) if b < len(cuts) else None
                yield pd.DataFrame(_bucket_regions(places[lo:hi], reps[lo:hi], weights[lo:hi], first, block, low, high))

    dealt = classes.select("rep", "signature", "n_shingles").mapInPandas(deal, "bucket int, place binary, rep long, weight long")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "place").mapInPandas(find, "rep long, tree int, region long, blocks int, mine int, crowded boolean")


def _needed(region: np.ndarray, tree: np.ndarray, size: np.ndarray, signs: np.ndarray, seen: np.ndarray, component: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which rows, sorted by region, look like another of their region that is in another component and that they did not
    meet in an earlier tree's region."""
    least = least_equal(percent)
    out = np.zeros(len(region), bool)
    for step in range(1, len(region)):
        i = np.flatnonzero(region[:-step] == region[step:])
        if not len(i):
            break
        i = i[component[i] != component[i + step]]
        j = i + step
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        fits = (signs[i] == signs[j]).sum(axis=1) >= least
        i, j = i[fits], j[fits]
        met = ((seen[i] == seen[j]) & (seen[i] != 0) & (np.arange(TREES)[None, :] < tree[i][:, None])).any(axis=1)
        out[i[~met]] = out[j[~met]] = True
    return out


def _by_key(batches: Iterator[pd.DataFrame], key: str = "region") -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by the key, cut anew so that no key's rows are split."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = pdf[key].to_numpy() == pdf[key].iloc[-1] if len(pdf) else np.zeros(0, bool)
        held = pdf[last].reset_index(drop=True)
        if not last.all():
            yield pdf[~last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _block_pair(region: int, a: int, b: int) -> int:
    """Key of two blocks of a region, as a signed 64-bit number."""
    x = (region ^ (min(a, b) * 0x9E3779B97F4A7C15 + max(a, b) * 0xC2B2AE3D27D4EB4F)) & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def candidates(placed: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """region, rep: the classes (rep, n_shingles, signature, component) whose sets must meet in a region of placed (rep, tree,
    region, blocks, mine)."""
    where = placed.groupBy("rep").agg(F.collect_list(F.struct("tree", "region", "blocks", "mine")).alias("regions"))  # at most TREES each

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in ("region", "tree", "rep", "component", "n_shingles", "signs", "seen")}
            for rep, component, n, sign, regions in zip(*(pdf[k].tolist() for k in ("rep", "component", "n_shingles", "signature", "regions")), strict=True):
                seen = np.zeros(TREES, np.int64)
                for r in regions:
                    seen[r["tree"]] = r["region"]
                signs = (np.frombuffer(sign, np.uint32) & 255).astype(np.uint8).tobytes()
                for r in regions:
                    for other in range(r["blocks"]):
                        for name, value in zip(out, (_block_pair(r["region"], r["mine"], other), r["tree"], rep, component, n, signs, seen.tobytes()), strict=True):
                            out[name].append(value)
            yield pd.DataFrame(out)

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(batches):
            signs = np.frombuffer(b"".join(pdf["signs"]), np.uint8).reshape(len(pdf), SIGNATURE)
            seen = np.frombuffer(b"".join(pdf["seen"]), np.int64).reshape(len(pdf), TREES)
            yield pdf.loc[_needed(pdf["region"].to_numpy(), pdf["tree"].to_numpy(), pdf["n_shingles"].to_numpy(), signs, seen, pdf["component"].to_numpy(), percent), ["region", "rep"]]

    met = classes.join(where, "rep").mapInPandas(spread, "region long, tree int, rep long, component long, n_shingles long, signs binary, seen binary")
    return met.repartition("region").sortWithinPartitions("region", "rep").mapInPandas(needed, "region long, rep long")


def _named(classes: DataFrame, found: DataFrame | None) -> DataFrame:
    """classes with the component (id, component) found so far, their own rep without any."""
    if found is None:
        return classes.withColumn("component", F.col("rep"))
    return classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _links_of(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """rep, shingle, earlier: the shingles of the prefix filter for texts (rep, text), with up to EARLIER ones that are rarer.

    Any one order of all shingles is right; here it is by counts of BUCKETS classes of them, a table of fixed size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, memory = np.zeros(BUCKETS, np.int64), WordHashes()
        for pdf in batches:
            for text in pdf["text"].tolist():
                n += np.bincount((shingle_set(text, memory) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.flatnonzero(n), "n": n[n > 0]})

    counts = np.zeros(BUCKETS, np.int64)
    found = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        for pdf in batches:
            out: dict[str, list] = {"rep": [], "shingle": [], "earlier": []}
            for rep, text in zip(pdf["rep"].tolist(), pdf["text"].tolist(), strict=True):
                s = shingle_set(text, memory)
                times = shared.value[(s % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((s, times))[: len(s) - -(-percent * len(s) // 100) + 1]
                prefix = s[order[times[order] > 1]].view(np.int64)  # what only one text has is shared with none
                out["rep"] += [rep] * len(prefix)
                out["shingle"] += prefix.tolist()
                out["earlier"] += [prefix[max(0, k - EARLIER) : k].tobytes() for k in range(len(prefix))]
            yield pd.DataFrame(out)

    return texts.select("rep", "text").mapInPandas(pick, "rep long, shingle long, earlier binary")


def _apart(unit: np.ndarray, out: np.ndarray, component: np.ndarray, size: np.ndarray, signs: np.ndarray, earlier: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows, sorted by unit, look like a row of another component in their unit, one of the two being an outsider;
    without pairs that share an earlier shingle and so meet there."""
    least = least_equal(percent)
    found = np.zeros(len(unit), bool)
    cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        members = lo + np.flatnonzero(~out[lo:hi])
        for i in lo + np.flatnonzero(out[lo:hi]):
            j = members[component[members] != component[i]]
            j = j[100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])]
            j = j[(signs[i] == signs[j]).sum(axis=1) >= least]
            mine = set(earlier[i].tolist())
            j = [k for k in j.tolist() if mine.isdisjoint(earlier[k].tolist())]
            found[j] = True
            found[i] |= bool(j)
    return found


def candidates_apart(classes: DataFrame, crowded: DataFrame, components_so_far: DataFrame, docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """region, rep: the crowded classes whose sets must still meet, as they share a rare shingle and are in different
    components (id, component) so far."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(crowded, "rep", "left_semi").dropDuplicates(["rep", "text"])
    named = _named(crowded, components_so_far)
    rare = staged(_rare_shingles(texts, percent).join(named, "rep"))
    parts = rare.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    shingles = parts.groupBy("shingle").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    shingles = shingles.select("shingle", "n", F.col("most.component").alias("largest"), F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("outer"))
    # n of all rows with the shingle: one that thousands of near copies share is dealt over all tasks.
    rows = spread_join(rare, shingles, "shingle", rare.count()).join(classes.select("rep", "n_shingles", "signature"), "rep")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(1)), "outer"))
    own = ("rep", "component", "n_shingles", "signature", "earlier")
    outsiders = rows.where("component <> largest").select("shingle", *own, F.lit(True).alias("out"), "lot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"))
    members = rows.select("shingle", *own, F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("lot"), "mine")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(batches):
            signs = (np.frombuffer(b"".join(pdf["signature"]), np.uint32) & 255).astype(np.uint8).reshape(len(pdf), SIGNATURE)
            earlier = [np.frombuffer(b, np.int64) for b in pdf["earlier"]]
            found = _apart(pdf["region"].to_numpy(), pdf["out"].to_numpy(bool), pdf["component"].to_numpy(), pdf["n_shingles"].to_numpy(), signs, earlier, percent)
            yield pdf.loc[found, ["region", "rep"]].drop_duplicates()

    met = outsiders.unionByName(members).select(F.xxhash64("shingle", "lot", "mine").alias("region"), *own, "out")
    return met.repartition("region").sortWithinPartitions("region", "rep").mapInPandas(apart, "region long, rep long")


def links_within(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, from exact sizes of all intersections."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    both = np.zeros((n, n), np.float32)  # exact up to 2^24 shingles
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for k in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        block = np.zeros((n, min(COLUMNS, len(shared) - k)), np.float32)
        block[owner[lo:hi], column[lo:hi] - k] = 1
        both += block @ block.T
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = 100.0 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    out, left = [], np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            front += new.tolist()
    return out


def confirmed(wanted: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links among documents that must meet (region, rep), confirmed on their full shingle sets."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["doc_id"], "shingles": [shingle_set(t, memory).tobytes() for t in pdf["text"].tolist()]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(batches):
            region, reps, raws = pdf["region"].to_numpy(), pdf["rep"].to_numpy(), pdf["shingles"].tolist()
            cuts = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
            found = [(reps[lo + i], reps[lo + j]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1 for i, j in links_within([np.frombuffer(r, np.uint64) for r in raws[lo:hi]], percent)]
            yield pd.DataFrame(found, columns=["a", "b"])

    own = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(sets, "rep long, shingles binary")
    met = wanted.join(own, "rep").select("region", "rep", "shingles")
    return met.repartition("region").sortWithinPartitions("region").mapInPandas(check, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row of docs (doc_id, text), by links at percent / 100 or more.

    Null texts and texts without words have no shingles and are linked with nothing. A row without doc_id is linked
    with nothing either: its component_id is null and it is kept. Rows repeated with one doc_id share a component. An
    empty table gives an empty result; other columns are ignored. class_id is the smallest doc_id with the same set.
    """
    signed = staged(_signed(docs))
    linked = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = staged(linked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count("*").alias("n")))
    signs = classes.select("rep", "n_shingles", "signature")
    every = staged(_regions(signs, block, percent))
    placed = every.where("blocks > 0").drop("crowded")
    own = placed.where(F.col("tree") < FIRST_TREES).select("rep", "tree", F.xxhash64("region", "mine").alias("region"), F.lit(1).alias("blocks"), F.lit(0).alias("mine"))
    found = components(confirmed(staged(candidates(own, _named(signs, None), percent)), docs, percent))
    named = staged(_named(signs, found))
    mixed = placed.join(named.select("rep", "component"), "rep").groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("region")
    rest = candidates(placed.join(mixed, "region", "left_semi"), named, percent)
    found = components(_links_of(found).unionByName(confirmed(staged(rest), docs, percent)))
    crowded = every.where("crowded").select("rep").distinct()
    if not crowded.isEmpty():
        apart = staged(candidates_apart(signs, staged(crowded), found, docs, block, percent))
        found = components(_links_of(found).unionByName(confirmed(apart, docs, percent)))
    named = classes.select("fingerprint", "rep", "n").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fingerprint", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("fingerprint")).alias("fingerprint"))
    alone = rows.where("fingerprint IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    together = spread_join(rows.where("fingerprint IS NOT NULL"), named, "fingerprint", signed.count()).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "class_id")
    return together.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the smallest doc_id of each component only; rows without doc_id stay."""
    extra = near_duplicates(docs, percent=percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
