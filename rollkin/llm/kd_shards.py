"""Shards by k-d tree: recursive splits at distributed weighted medians.

A node is split along the metadata dimension in which its bytes spread widest, so that
both sides hold their share of the bytes, until leaves have the target size. A median
is found by a histogram of weights over the node's range, refined around the crossing;
a histogram has a bounded number of bins, whatever the number of documents.

All dimensions run from 0 to 1, so that spreads compare: the logarithm of the size
between that of the smallest and of the largest text, and for source and language the
place of the value when values are laid side by side by their share of the bytes, from
the smallest to the largest. A dimension of many even values spreads wide, one that a
single value dominates hardly. Spread is the standard deviation, weighted by bytes.

Equal texts stay together. All copies of a text are one unit of the tree; units that
are large beside a shard are few (their number is bounded by the number of shards) and
are dealt to the sides first, the heavier first, and the small ones are cut so as to
level the sides. Only a text whose copies outweigh half a shard is split.

The driver holds a row for each node, and for each large unit, of which a shard has
``1 / LARGE`` at most: right for up to ``MOST_SHARDS`` shards, beyond which it raises.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import broadcast_if_small, discard, written

DIMS = ("x_size", "x_source", "x_lang")
NONE = "\x00none"
SPAN = 1 << 32
#: A unit of over this part of a shard is dealt by itself.
LARGE = 1 / 64
#: A cut may be off by this part of a shard.
CLOSE = 1 / 500
ROWS_A_BLOCK = 20_000
SMALL_OFFSETS = 2_000_000
SMALL_VALUES = 200_000
#: Rows from the driver up to which they are broadcast.
SMALL_ROWS = 1_000_000
MOST_SHARDS = 100_000


@dataclass
class Node:
    """A node of the tree: ``shards`` leaves from ``first`` on."""

    number: int
    first: int
    shards: int
    dim: str = DIMS[0]
    weight: int = 0
    small: int = 0
    large: list = field(default_factory=list)


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, broadcast if there are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= SMALL_ROWS else df


def _places(thin: DataFrame, value: str) -> DataFrame:
    """(value, place): the middle of a value's stretch when values are laid side by side by weight, scaled to ``SPAN``.

    Values are dealt to cells of about equal weight first, of which there are at most
    64 x 256, so that no window holds more than a cell's values or all cells.
    """
    sums = thin.groupBy(value).agg(F.sum("size").alias("w")).withColumns({"c": F.floor(F.log2("w")).cast("int"), "b": F.pmod(F.xxhash64(value), F.lit(256))})
    sums = written(sums, "values")
    cells = sums.groupBy("c", "b").agg(F.sum("w").alias("cw")).withColumn("first", F.sum("cw").over(Window.orderBy("c", "b")) - F.col("cw"))
    total = F.sum("cw").over(Window.partitionBy())
    cells = cells.withColumn("total", total).select("c", "b", "first", "total")
    inside = F.sum("w").over(Window.partitionBy("c", "b").orderBy("w", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w") / 2
    return sums.withColumn("inside", inside).join(F.broadcast(cells), ["c", "b"]).select(value, F.floor((F.col("first") + F.col("inside")) / F.col("total") * (SPAN - 1)).cast("long").alias(f"x_{value}"))


def _thin(docs: DataFrame) -> DataFrame:
    text, named = F.coalesce("text", F.lit("")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), named("source"), named("lang"),
    )


def _placed(thin: DataFrame) -> DataFrame:
    """``thin`` with its coordinates ``x_size``, ``x_source`` and ``x_lang``."""
    ends = thin.agg(F.log2(F.min("size")).alias("low"), F.log2(F.max("size")).alias("high")).first()
    low, high = ends["low"] or 0.0, ends["high"] or 0.0
    out = thin.withColumn("x_size", F.floor((F.log2("size") - low) / max(high - low, 1e-9) * (SPAN - 1)).cast("long"))
    for value in ("source", "lang"):
        out = out.join(broadcast_if_small(written(_places(thin, value), "places"), SMALL_VALUES), value)
    return out.drop("source", "lang")


def _units(thin: DataFrame, target: float) -> DataFrame:
    """(text_hash, size, block, weight, key, x_*): copies of a text, in blocks where they outweigh half a shard."""
    same = thin.groupBy("text_hash", "size").agg(
        F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in DIMS]
    )
    blocks = F.when(F.col("weight") > target / 2, F.ceil(F.col("weight") / (target / 8))).otherwise(1).cast("long")
    return same.withColumn("blocks", blocks)


def _cut_key(dim: str | Column) -> Column:
    """Order of a node's units along a dimension: its value, ties by text hash; below 2 ** 62."""
    value = F.col(dim) if isinstance(dim, str) else dim
    return value * (1 << 30) + F.shiftrightunsigned(F.col("text_hash"), 34)


def _spread(dim: str) -> Column:
    """Standard deviation along a dimension, weighted by bytes."""
    w, x = F.col("weight"), F.col(dim) / SPAN
    mean = F.sum(w * x) / F.sum(w)
    return F.sqrt(F.greatest(F.sum(w * x * x) / F.sum(w) - mean * mean, F.lit(0.0))).alias(dim)


def _crossings(units: DataFrame, wanted: dict[int, float], close: float) -> dict[int, int]:
    """By node, the key below which its small units weigh ``wanted``, to within ``close``.

    ``units``: (node, key, weight). One pass over them refines the range of every node.
    """
    spark = units.sparkSession
    ranges = {n: (0, 1 << 62, 0.0) for n in wanted}  # low, high, weight below low
    found: dict[int, int] = {}
    while ranges:
        bins = max(16, min(4096, (1 << 20) // len(ranges)))
        rows = [(n, low, max(1, -(-(high - low) // bins))) for n, (low, high, _) in ranges.items()]
        at = _rows(spark, rows, "node long, low long, width long")
        histogram = (
            units.join(at, "node").where("key >= low AND key < low + width * %d" % bins)
            .groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("weight").alias("weight")).orderBy("node", "bin").collect()
        )
        by_node: dict[int, list[tuple[int, int]]] = {}
        for r in histogram:
            by_node.setdefault(r["node"], []).append((r["bin"], r["weight"]))
        for n, low, width in rows:
            below, goal, (_, high, base) = ranges[n][2], wanted[n], ranges[n]
            cut, cut_weight = low, base
            crossing = None
            for b, w in by_node.get(n, []):
                if below + w > goal:
                    crossing = b
                    break
                below += w
                cut, cut_weight = low + (b + 1) * width, below
            if crossing is None:
                found[n] = high
                del ranges[n]
                continue
            w = dict(by_node[n])[crossing]
            start = low + crossing * width
            if goal - below <= close or width == 1:
                found[n] = start if goal - below <= w / 2 else start + width
                del ranges[n]
            elif below + w - goal <= close:
                found[n] = start + width
                del ranges[n]
            else:
                ranges[n] = (start, min(high, start + width), below)
    return found


def shard_units(units: DataFrame, n_shards: int, total: int) -> DataFrame:
    """``units`` (unit, text_hash, weight, coordinates) with ``shard``: the leaf of the k-d tree that each unit falls into."""
    if n_shards > MOST_SHARDS:
        raise ValueError(f"{n_shards} shards: shard in two steps, {MOST_SHARDS} at most in one")
    target = total / n_shards
    spark = units.sparkSession
    nodes = [Node(1, 0, n_shards)]
    placed = units.withColumn("node", F.lit(1).cast("long")).withColumn("shard", F.lit(0 if n_shards == 1 else None).cast("int"))
    while open_nodes := [n for n in nodes if n.shards > 1]:
        stats = placed.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("weight") <= target * LARGE, F.col("weight"))).alias("small"), *[_spread(d) for d in DIMS]).collect()
        large = placed.where(F.col("weight") > target * LARGE).select("node", "unit", "weight").orderBy(F.desc("weight"), "unit").collect()
        by_number = {n.number: n for n in nodes}
        for r in stats:
            n = by_number[r["node"]]
            n.weight, n.small = r["weight"], r["small"] or 0
            n.dim = max(DIMS, key=lambda d: r[d] or 0.0)
        for r in large:
            by_number[r["node"]].large.append((r["unit"], r["weight"]))
        wanted, sides = {}, []
        for n in open_nodes:
            share = n.weight * (n.shards // 2) / n.shards
            room = [share, n.weight - share]
            for unit, w in n.large:
                side = 0 if room[0] >= room[1] else 1
                room[side] -= w
                sides.append((unit, side))
            wanted[n.number] = min(max(room[0], 0), n.small)
        dims = _rows(spark, [(n.number, n.dim) for n in open_nodes], "node long, dim string")
        value = reduce(lambda e, d: e.when(F.col("dim") == d, F.col(d)), DIMS[1:], F.when(F.col("dim") == DIMS[0], F.col(DIMS[0])))
        keyed = placed.join(dims, "node", "left").withColumn("key", _cut_key(value)).drop("dim")
        cuts = _crossings(keyed.where((F.col("weight") <= target * LARGE) & F.col("key").isNotNull()).select("node", "key", "weight"), wanted, target * CLOSE)
        cut_rows = _rows(spark, list(cuts.items()), "node long, cut long")
        side_rows = _rows(spark, sides, "unit string, side int")
        side = F.coalesce("side", (F.col("key") >= F.col("cut")).cast("int"))
        last = placed
        placed = written(
            keyed.join(cut_rows, "node", "left").join(side_rows, "unit", "left")
            .withColumn("node", F.when(F.col("cut").isNotNull(), F.col("node") * 2 + side).otherwise(F.col("node"))).drop("cut", "side", "key"),
            "placed",
        )
        discard(last)
        nodes = [n for n in nodes if n.shards == 1] + [
            m for n in open_nodes
            for m in (Node(2 * n.number, n.first, n.shards // 2), Node(2 * n.number + 1, n.first + n.shards // 2, n.shards - n.shards // 2))
        ]
    leaves = _rows(spark, [(n.number, n.first) for n in nodes], "node long, leaf int")
    return placed.join(leaves, "node").withColumn("shard", F.col("leaf")).drop("leaf", "node")


def assign_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Give the number of shards, or the bytes that a shard should have at most. ``size``
    is the text's UTF-8 bytes plus 1. Slots number a shard's rows from 0 without gaps.

    A null text has size 1 and CRC 0, as an empty one; null lang or source is a value
    of its own; a null id gets a slot as others do. Repeated rows are equal texts and
    stay together, each with its own slot. An empty table gives an empty result. Other
    columns aren't read.
    """
    thin = written(_thin(docs), "thin")
    sums = thin.agg(F.sum("size").alias("total"), F.count("*").alias("rows")).first()
    total = sums["total"] or 1
    n = n_shards or max(1, -(-total // (target_bytes or total)))
    units = written(_units(_placed(thin), total / n), "copies")
    blocks = written(units.select("text_hash", "size", "blocks").where("blocks > 1"), "split")  # at most two a shard
    each = units.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "unit", F.concat_ws("-", F.hex("text_hash"), F.col("size"), F.col("block"))
    ).withColumn("weight", (F.col("weight") / F.col("blocks")).cast("long"))
    placed = shard_units(written(each.drop("blocks"), "units"), n, total).select("text_hash", "size", "block", "shard")
    in_block = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1).cast("long")))
    rows = thin.join(broadcast_if_small(blocks, SMALL_ROWS), ["text_hash", "size"], "left").withColumn("block", in_block).drop("blocks")
    found = written(
        rows.join(placed, ["text_hash", "size", "block"]).select("doc_id", "size", "text_crc32", "text_hash", "shard")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(max(1, sums["rows"] // n // ROWS_A_BLOCK)))),
        "sharded",
    )
    in_order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(in_order), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_hash"))
    return found.join(broadcast_if_small(before, SMALL_OFFSETS), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (place + F.col("before") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
