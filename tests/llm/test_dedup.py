"""Exact and near duplicates, components and sharding against brute force, with awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import near_dedup
from panelspark.llm.components import components
from panelspark.llm.exact_dedup import drop_exact_copies, exact_dedup
from panelspark.llm.near_dedup import drop_near_copies, links_within, near_duplicates, shingle_set
from panelspark.llm.sharding import hilbert_index, hilbert_shards, quantile_cuts, shard_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def hot_rows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60)]
    rows = [(i, texts[i % 60]) for i in range(0, 300)]
    rows += [(1000 + i, "the\thot  text" if i % 2 else "the hot text") for i in range(200)]
    return [*rows, (5000, None), (5001, ""), (5002, " "), (5003, "x" * 50_000), (5004, "x" * 50_000 + "y")]


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_exact_dedup_brute_force(spark, buckets):
    rows = hot_rows()
    got = {r.doc_id: r for r in exact_dedup(frame(spark, rows), buckets=buckets).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("buckets", [1, 64])
def test_drop_exact_copies_keeps_columns(spark, buckets):
    rows = hot_rows()
    out = drop_exact_copies(frame(spark, rows), buckets=buckets)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {}
    for i, t in rows:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t) for i, t in rows if first[norm(t)] == i}


def test_exact_dedup_ties_nulls_and_empty(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "b")]
    got = exact_dedup(frame(spark, rows), buckets=3).collect()
    assert Counter(r.kept for r in got) == {True: 2, False: 3}
    assert {(r.keep_id, r.group_size) for r in got} == {(None, 3), (2, 2)}
    assert exact_dedup(frame(spark, []), buckets=3).count() == 0
    odd = frame(spark, rows).selectExpr("doc_id", "text", "lang AS _bucket", "source AS `_norm`", "n_chars AS `a.b`")
    assert drop_exact_copies(odd, buckets=3).columns == odd.columns and drop_exact_copies(odd, buckets=3).count() == 2
    assert drop_near_copies(odd).columns == odd.columns
    clash = frame(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "_bucket2")
    assert exact_dedup(clash, buckets=3).count() == 5


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = random.Random(7)
    rows, vocabulary = [], [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    for i in range(150):  # one large group, edited at random places
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    for i in range(150, 260):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 80))]
        rows.append((i, " ".join(text)))
        rows.append((i + 1000, " ".join(text[:-1] + ["tail"])))
    return [*rows, (9001, None), (9002, ""), (9003, "  \n"), (9004, "one"), (9005, "ONE"), (9006, "One two"), (9007, "É one"), (9008, "é one")]


@pytest.mark.parametrize("block", [128, 16])
def test_near_duplicates_brute_force(spark, block):
    rows = near_rows()
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), block).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def crowded_rows():
    """4,101 near copies that link with each other, and 100 texts that link with one of them only (0.88; 0.82 or less with others)."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(160)]
    rows, places = [(0, " ".join(base))], []
    for i in range(1, 4101):
        text, at = list(base), rng.randrange(5, 155)
        text[at] = f"e{i}"
        places.append((at, text))
        rows.append((i, " ".join(text)))
    for i in range(100):
        at, text = places[i * 40]
        text, free = list(text), [k for k in range(5, 155) if abs(k - at) > 5]
        first = rng.choice(free)
        for k in (first, rng.choice([k for k in free if abs(k - first) > 5])):
            text[k] = f"o{i}_{k}"
        rows.append((10_000 + i, " ".join(text)))
    return rows


def test_crowded_region_loses_no_link(spark):
    rows = crowded_rows()
    sets = {i: shingles(t) for i, t in rows}
    links = [sum(100 * len(sets[i] & s) >= 85 * len(sets[i] | s) for j, s in sets.items() if j != i) for i in range(10_000, 10_100)]
    assert set(links) == {1}
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_pipeline_drops_copies_at_80_percent(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(124)]
    for edits, share in (([20, 60], 110 / 130), ([20, 40, 60], 105 / 135)):
        text = [f"e{k}" if k in edits else w for k, w in enumerate(base)]
        a, b = shingles(" ".join(base)), shingles(" ".join(text))
        assert len(a & b) / len(a | b) == share
        docs = frame(spark, [(1, " ".join(base)), (2, " ".join(text))])
        kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
        assert kept == ({1} if share >= 0.8 else {1, 2})
        assert near_duplicates(docs).where("kept").count() == 2  # the contract of op1 stays


def test_drop_near_copies(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (None, "a b c d e f"), (4, None)]
    out = drop_near_copies(frame(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    assert near_duplicates(frame(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12))
def test_links_within_spans_all_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}

    def classes(edges):
        parent = list(range(len(sets)))
        for a, b in edges:
            pa, pb = parent[a], parent[b]
            parent = [pb if p == pa else p for p in parent]
        return [tuple(p == q for q in parent) for p in parent]

    forest = links_within(arrays)
    assert classes(forest) == classes(linked) and len(forest) < len(sets)


def test_shingles_follow_the_contract():
    assert len(shingle_set("A b C d e f")) == 2 and np.array_equal(shingle_set("A b C d e"), shingle_set("a B c D E"))
    assert not np.array_equal(shingle_set("É a b c d"), shingle_set("é a b c d"))
    assert len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0
    assert near_dedup.TREES * (1 - (1 - 0.85**5) ** near_dedup.TREES) > 23.999


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_signature_filter_loses_less_than_the_forest(t):
    percent = round(100 * t)
    few = near_dedup.least_equal(percent)
    lost = sum(math.comb(128, k) * t**k * (1 - t) ** (128 - k) for k in range(math.ceil(few)))
    assert lost <= (1 - t ** near_dedup.LEVELS[near_dedup.first_level(percent)]) ** near_dedup.TREES < 1e-6


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 100)] + [(500, 501 + k) for k in range(50)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 100 and all(got[501 + k] == 500 for k in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = [tuple(c >> (bits * d) & ((1 << bits) - 1) for d in range(dims)) for c in range(1 << (bits * dims))]
    path = sorted(cells, key=lambda p: hilbert_index(p, bits))
    assert sorted(hilbert_index(p, bits) for p in cells) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_sharding(spark):
    rows = [(i % 90, "x" * (i % 37), None if i % 11 == 0 else f"l{i % 3}", f"s{i % 7}", 1) for i in range(101)] + [(500, None, "l0", None, 0), (None, "é", "l1", "s1", 1)]
    got = shard_documents(spark.createDataFrame(rows, DOCS), 16).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert len(got) == 103 and set(shards) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (500, None)} == {(1, 0), (3, zlib.crc32("é".encode()))}
    assert shard_documents(spark.createDataFrame([], DOCS), 16).count() == 0


def test_sharding_prunes(spark):
    df = spark.range(4000).selectExpr("id", "id % 64 AS a", "(id div 64) AS b")
    got = hilbert_shards(df, "id", ["a", "b"], 16).groupBy("shard").agg({"a": "max", "b": "max"}).collect()
    lows = hilbert_shards(df, "id", ["a", "b"], 16).groupBy("shard").agg({"a": "min", "b": "min"}).collect()
    spans = [(h["max(a)"] - lo["min(a)"]) * (h["max(b)"] - lo["min(b)"]) for h in got for lo in lows if h.shard == lo.shard]
    assert sum(spans) / len(spans) < 64 * 64 / 6


def test_sharding_cuts_at_exact_quantiles(spark):
    """More rows than any sample had: with one dimension each of the 16 shards is one run of 1,000 values."""
    df = spark.range(16_000).selectExpr("id", "(id * 7919) % 16000 AS a").repartition(3)
    got = hilbert_shards(df, "id", ["a"], 16).groupBy("shard").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("n")).collect()
    assert sorted((r.lo, r.hi, r.n) for r in got) == [(1000 * k, 1000 * k + 999, 1000) for k in range(16)]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_quantile_cuts(spark, kind):
    rng = np.random.default_rng(5)
    for values in ([None] * 40 + (rng.integers(0, 30, 500) ** 2).tolist() + [7] * 200, [3], [None], [1, 2], []):
        df = spark.createDataFrame([(v,) for v in values], "a bigint").select(F.col("a").cast(kind)).repartition(3)
        rows = sorted((r.a for r in df.collect()), key=lambda v: (v is not None, v))
        want = {rows[len(rows) * i // 16] for i in range(1, 16)} if rows else set()
        assert quantile_cuts(df, "a", 16) == [[v] for v in sorted(want, key=lambda v: (v is not None, v))]


@pytest.mark.parametrize("block", [1, 4])
def test_bucket_regions_are_runs_of_long_common_prefixes(block):
    """Regions of one sorted bucket against prefixes compared pair by pair, with crowded ones and with cuts."""
    rng = np.random.default_rng(block)
    n, levels = 400, near_dedup.LEVELS
    places = np.zeros(n, near_dedup._PLACE_TYPE)
    places["tree"] = rng.integers(0, 2, n)
    places["values"] = rng.integers(0, 2, (n, levels[-1])) * (rng.random((n, 1)) < 0.7)
    places["tie"] = rng.permutation(n)
    raw = np.sort(np.frombuffer(places.tobytes(), f"S{places.itemsize}"))
    places = np.frombuffer(b"".join(bytes(r).ljust(places.itemsize, b"\0") for r in raw), near_dedup._PLACE_TYPE)
    heads = {d: [(int(p["tree"]), *p["values"][:d].tolist()) for p in places] for d in levels}
    limit = near_dedup.BLOCKS * block
    for cuts in (None, (places[0], 6)):
        got = near_dedup._bucket_regions(places, np.arange(n), np.full(n, 50), 0, block, cuts, None)
        rows = {int(r): (int(g), int(b), int(m), bool(c)) for r, g, b, m, c in zip(*(got[k] for k in ("rep", "region", "blocks", "mine", "crowded")), strict=True)}
        assert got["tree"].tolist() == places["tree"][got["rep"]].tolist()
        met = {}
        for i in range(n):
            depth = next((d for d in levels if heads[d].count(heads[d][i]) <= limit and not (cuts and d < 6 and heads[d][i] == heads[d][0])), None)
            crowded = depth != levels[0]
            if depth is None:
                assert rows[i][3]
            elif heads[depth].count(heads[depth][i]) == 1:
                assert (i in rows) == crowded and (not crowded or rows[i][1] == 0)
            else:
                assert rows[i][3] == crowded and rows[i][1] == -(-heads[depth].count(heads[depth][i]) // block)
                met.setdefault((depth, heads[depth][i]), set()).add(rows[i][0])
        assert all(len(names) == 1 for names in met.values()) and len({next(iter(x)) for x in met.values()}) == len(met)


def test_spread_join_is_a_join(spark):
    """Crowded keys go by broadcast, the others by shuffle; together they are the inner join, and only crowded ones are broadcast."""
    from pyspark.sql import functions as F

    from panelspark.llm.common import spread_join

    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).when(F.col("id") < 404, None).otherwise(F.col("id") % 90).alias("k"), F.col("id").alias("v"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).where("k IS NULL OR k <> 5").withColumn("x", F.col("k") * 10)
    got = sorted(tuple(r) for r in spread_join(rows, lookup, "k", 1000, most=10).select("k", "v", "x").collect())
    assert got == sorted((k, v, k * 10) for k, v in ((0 if i < 400 else None if i < 404 else i % 90, i) for i in range(1000)) if k is not None and k != 5)
    assert spread_join(rows.limit(0), lookup.limit(0), "k", 0).count() == 0
