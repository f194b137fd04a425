"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to a few bits each at exact quantiles of all rows, a cell's place on the
Hilbert curve comes from a generated table, and equal runs of the curve become shards, so that
each shard spans a small box of the metadata and files can be pruned on any of its dimensions.
Row ranks come from counts per (cell, salt), never from one global sort; crowded cells have more salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_width, staged

BITS = 4
#: Least number of salts of a cell, and rows for each salt where that gives more.
SALTS, ROWS_PER_SALT = 64, 1 << 18


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a grid point on the Hilbert curve (Skilling's transpose form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell; a cell's number has dimension 0 in its highest bits."""
    mask = (1 << bits) - 1
    return [hilbert_index(tuple(c >> (bits * (dims - 1 - d)) & mask for d in range(dims)), bits) for c in range(1 << (bits * dims))]


def quantile_cuts(rows: DataFrame, dim: str, parts: int) -> list[list]:
    """The distinct values at places n * i // parts of the n sorted rows, nulls first: exact, from counts per value.

    Values are dealt out by ranges and places added up within each, so no task meets all of them.
    """
    up = F.col("v").asc_nulls_first()
    counts = rows.groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    counts = staged(counts.repartitionByRange(shuffle_width(rows.sparkSession), up).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("_part").agg(F.sum("n").alias("n"))  # one row a task
    starts = totals.select("_part", earlier(Window.orderBy("_part")).alias("_start"), F.sum("n").over(Window.partitionBy()).alias("_total"))
    placed = counts.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + earlier(Window.partitionBy("_part").orderBy(up)))
    wanted = F.expr(f"exists(sequence(1, {parts - 1}), i -> (_total * i) div {parts} >= _at AND (_total * i) div {parts} < _at + n)")
    cuts = [r["v"] for r in placed.where(wanted).select("v").collect()] if parts > 1 else []  # fewer than parts
    return [[v] for v in sorted(cuts, key=lambda v: (v is not None, v))]


def hilbert_shards(rows: DataFrame, id_col: str, dims: list[str], shards: int, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """rows with shard (0 .. shards-1) and slot (gapless from 0 within a shard); counts differ by one at most.

    Null dimensions sort before all values, rows of one cell are ordered by a hash of their identifier
    and then by it; repeated rows take slots of their own. An empty table stays empty. rows should be narrow: they are
    staged, and again with their cells.
    """
    rows = staged(rows)
    cell = F.lit(0)
    for d in dims:
        kind = rows.schema[d].dataType.simpleString()
        cuts = quantile_cuts(rows, d, 1 << bits)
        cell = cell * (1 << bits) + bucket_of(F.struct(F.col(d).alias("v")), f"struct<v:{kind}>", cuts)
    curve = F.expr(f"array({', '.join(map(str, hilbert_table(len(dims), bits)))})")
    placed = staged(rows.withColumn("_cell", F.get(curve, cell)))
    # At most 2^(dims * bits) cells, whatever the size of the table.
    everything = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    several = F.greatest(F.lit(salts), F.ceil(F.col("_cell_n") / ROWS_PER_SALT)).cast("int")
    cells = placed.groupBy("_cell").agg(F.count("*").alias("_cell_n")).select("_cell", several.alias("_salts"), F.coalesce(F.sum("_cell_n").over(everything), F.lit(0)).alias("_cell_at"), F.sum("_cell_n").over(Window.partitionBy()).alias("_total"))
    salted = placed.join(F.broadcast(cells), "_cell").withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.col("_salts")).cast("int"))
    before = Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("_cell", "_salt").agg(F.count("*").alias("_n"), F.first("_cell_at").alias("_cell_at"))
    starts = counts.select("_cell", "_salt", (F.col("_cell_at") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_at"))
    mine = Window.partitionBy("_cell", "_salt").orderBy(id_col, *[c for c in rows.columns if c != id_col])
    ranked = salted.drop("_cell_at").withColumn("_in", F.row_number().over(mine) - 1).join(starts, ["_cell", "_salt"]).withColumn("_rank", F.col("_at") + F.col("_in"))
    shard = F.expr(f"cast((_rank * {shards}) div _total as int)")
    return ranked.withColumn("shard", shard).withColumn("slot", F.expr(f"_rank - ((shard * _total + {shards - 1}) div {shards})")).select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's size, checksum and place: doc_id, lang, source, size, text_crc32, shard, slot."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return hilbert_shards(rows, "doc_id", ["lang", "source", "size"], shards)
