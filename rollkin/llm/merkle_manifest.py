"""Merkle manifest of a table by butterfly exchange.

Every row is a leaf, every source a tree of fanout 16, and the trees' roots are the leaves
of one more tree. The leaves of a source are dealt out in aligned blocks of ``16 ** LEVELS``,
and a block's task hashes the subtree over its own leaves. Then, round by round, aligned
groups of 16 blocks swap the roots of their subtrees: block b meets those whose number
differs from b in one base-16 digit only. Each of them hashes the common ancestor for
itself, and what it was sent are its siblings on that level. After the last round every
block holds its source's root and the proof from its own subtree up to there, so nothing
has to be sent down the tree again.

Where the last subtree of a group has fewer blocks than the others, its blocks stand in
for the missing ones and send their root to several partners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import broadcast_if_small, discard, written

FANOUT = 16
#: Levels of the subtree that one block hashes: 256 leaves.
LEVELS = 2
#: Sources and runs of leaves up to which they are broadcast.
SMALL_SOURCES, SMALL_RUNS = 20_000, 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """``text`` in ASCII lower case where 5 divides the CRC-32 of the id, else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.translate(text, upper, upper.lower()))


def node(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place of each row in its group by ``order``, from 0, and the group's size ``n``.

    Rows are ranged over tasks, so a large group is many tasks' work; what is added up
    afterwards are the row counts of each task and group.
    """
    runs = written(
        df.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
        .withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "runs",
    )
    sizes = written(runs.groupBy(group, "run").agg(F.count("*").alias("rows"), F.min("at").alias("first")), "run_sizes")
    earlier = Window.partitionBy(group).orderBy("run")
    starts = sizes.select(
        group, "run", (F.sum("rows").over(earlier) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(group)).alias("n")
    )
    joined = runs.join(broadcast_if_small(written(starts, "run_starts"), SMALL_RUNS), [group, "run"])
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """All levels above ``nodes``, with them as the first. It ends early at a single node, as the tree does."""
    out = [nodes]
    while len(out) <= levels and len(out[-1]) > 1:
        out.append([node(out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def whole_levels(nodes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """``climb`` for a block. If it isn't ``alone`` in its source, a single node is hashed on up to the block's level."""
    out = climb(nodes, levels)
    while not alone and len(out) <= levels:
        out.append([node(out[-1])])
    return out


def with_roots(blocks: DataFrame, levels: int) -> DataFrame:
    """(source_key, block, n_blocks, node): the root of each block's subtree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("leaves").to_pylist(), batch.column("n_blocks").to_pylist())
            roots = [whole_levels([x.hex() for x in leaves], levels, n == 1)[-1][0] for leaves, n in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_key", "block", "n_blocks")), pa.array(roots, pa.string())], names=["source_key", "block", "n_blocks", "node"])

    return blocks.select("source_key", "block", "n_blocks", F.col("members.leaf").alias("leaves")).mapInArrow(work, "source_key string, block long, n_blocks long, node string")


def butterfly(blocks: DataFrame) -> DataFrame:
    """``blocks`` (source_key, block, n_blocks, node) with the root of its source as ``node`` and ``proof``.

    ``proof`` has the siblings on each level above the block, lowest first: their digests
    as one text on the left, and one on the right. Blocks of a source are numbered from 0.
    """
    state = written(blocks.withColumn("proof", F.array().cast("array<struct<left:string,right:string>>")), "round")
    most = state.agg(F.max("n_blocks")).first()[0] or 1
    size = 1  # blocks of a subtree
    while size < most:
        tree = F.floor(F.col("block") / size)
        n_trees = F.ceil(F.col("n_blocks") / size)
        low = F.col("block") % size
        of_last = F.col("n_blocks") - (n_trees - 1) * size
        short = (tree == n_trees - 1) & (of_last < size)
        lows = F.when(short, F.sequence(low, F.lit(size - 1).cast("long"), F.greatest(of_last, F.lit(1)))).otherwise(F.array(low))
        sent = (
            state.where(n_trees > 1)
            .select("source_key", "block", "n_blocks", "node", "proof", low.alias("own"), (tree % FANOUT).alias("digit"), F.floor(tree / FANOUT).alias("family"), F.explode(lows).alias("low"))
            .select("source_key", "family", "low", F.struct("digit", "node", "block", "n_blocks", F.when(F.col("own") == F.col("low"), F.col("proof")).alias("proof")).alias("one"))
        )
        met = sent.groupBy("source_key", "family", "low").agg(F.sort_array(F.collect_list("one")).alias("all"))
        joined = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["node"]), "")
        siblings = F.struct(joined(lambda x: x["digit"] < F.col("one.digit")).alias("left"), joined(lambda x: x["digit"] > F.col("one.digit")).alias("right"))
        up = (
            met.select("source_key", "all", F.explode("all").alias("one")).where("one.proof IS NOT NULL")
            .select("source_key", "one.block", "one.n_blocks", F.sha2(F.array_join("all.node", ""), 256).alias("node"), F.concat("one.proof", F.array(siblings)).alias("proof"))
        )
        next_state = written(up.unionByName(state.where(n_trees <= 1)), "round")
        discard(state)
        state, size = next_state, size * FANOUT
    return state


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is recomputed from the tampered leaf, or the leaf itself where the row
    isn't tampered with, and its siblings; ``verified`` tells whether it is the root. Nulls
    are a value of their own; the null source is a source, before all others. Null ids
    come first in their source and are never tampered with; rows that share an id are
    ordered by leaf; repeated rows are leaves of their own. Texts are hashed whole.
    Other columns aren't read. An empty table gives an empty result.
    """
    changed = tampered_text(F.col("doc_id"), F.col("text"))
    source_key = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-"))  # sorts as sources do, null first
    leaves = written(
        docs.select(source_key.alias("source_key"), "doc_id", F.unhex(leaf_of(F.col("text"))).alias("leaf"), F.when(changed.isNotNull(), F.unhex(leaf_of(changed))).alias("forged")), "leaves"
    )
    ranked = placed(leaves, "source_key", ["doc_id", "leaf"])
    per_block = FANOUT**levels
    members = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "forged"))).alias("members")
    blocks = written(
        ranked.groupBy("source_key", F.floor(F.col("pos") / per_block).alias("block"), F.ceil(F.col("n") / per_block).alias("n_blocks")).agg(members), "blocks"
    )
    sides = butterfly(with_roots(blocks, levels))
    tops = _source_tree(sides)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(_proved(row, levels), (batch.schema.field("ids").type.value_type, *[pa.string()] * 5, pa.bool_()))], names=names
                )

    whole = (
        blocks.join(sides.select("source_key", "block", F.col("node").alias("subroot"), "proof"), ["source_key", "block"])
        .join(broadcast_if_small(tops, SMALL_SOURCES), "source_key")
        .select("n_blocks", F.col("members.doc_id").alias("ids"), F.col("members.leaf").alias("leaves"), F.col("members.forged").alias("forged"), "subroot", "proof", "root", "top_proof")
    )
    return whole.mapInArrow(work, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _source_tree(sides: DataFrame) -> DataFrame:
    """(source_key, root, top_proof): the tree over the sources' roots, each a block by itself."""
    roots = placed(sides.where("block = 0").select("source_key", "node", F.lit("all").alias("every")), "every", ["source_key"])
    numbered = written(roots.select("source_key", F.col("pos").alias("block"), F.col("n").alias("n_blocks"), "node"), "sources")
    up = butterfly(numbered.select(F.lit("all").alias("source_key"), "block", "n_blocks", "node"))
    return written(numbered.select("source_key", "block").join(up.select("block", F.col("node").alias("root"), F.col("proof").alias("top_proof")), "block").drop("block"), "source_proofs")


def _proved(row: dict, levels: int) -> tuple[list, ...]:
    """The columns of the result for the leaves of one block."""
    leaves = [x.hex() for x in row["leaves"]]
    tree = whole_levels(leaves, levels, row["n_blocks"] == 1)
    above = [(p["left"], p["right"]) for p in row["proof"] + row["top_proof"]]
    rest = "".join(left + right for left, right in above).encode()
    proofs, folded = [], []
    for i, own in enumerate(leaves):
        sides, at = [], i
        for level in tree[:-1]:
            first = at - at % FANOUT
            sides.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
            at //= FANOUT
        proofs.append(hashlib.sha256("".join(a + b for a, b in sides).encode() + rest).hexdigest())
        up = own if row["forged"][i] is None else row["forged"][i].hex()
        for a, b in sides + above:
            up = node([a, up, b])
        folded.append(up)
    n = len(leaves)
    return row["ids"], leaves, [row["subroot"]] * n, [row["root"]] * n, proofs, folded, [x == row["root"] for x in folded]


def oracle_sql(depth: int = 4, source_depth: int = 2) -> str:
    """DuckDB SQL for ``manifest`` over ``documents`` with unique ids, up to 16 ** depth rows a source and 16 ** source_depth sources."""
    value = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(value(text if c == 'text' else c) for c in FIELDS)})"
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
    parts = [f"""
WITH crcs AS (SELECT {table} AS crc_table),
l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM documents, crcs),
n0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, leaf AS h FROM l),
w0 AS (SELECT doc_id, source, leaf, coalesce(forged, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM l)"""]
    last = 0

    def climb_by(group: str, steps: int) -> None:
        nonlocal last
        for _ in range(steps):
            k, last = last, last + 1
            parts.append(f"""c{k} AS (SELECT {group} AS g, count(*) AS n FROM n{k} GROUP BY ALL),
n{last} AS (SELECT source, CASE WHEN n = 1 THEN pos ELSE pos // 16 END AS pos, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY n{k}.pos)) END AS h
  FROM n{k} JOIN c{k} ON {group} IS NOT DISTINCT FROM g GROUP BY source, CASE WHEN n = 1 THEN pos ELSE pos // 16 END, n),
s{k} AS (SELECT doc_id, any_value(w.leaf) AS leaf, any_value(w.source) AS source, any_value(CASE WHEN n = 1 THEN w.pos ELSE w.pos // 16 END) AS pos,
  any_value(w.proof) || coalesce(string_agg(h, '' ORDER BY o.pos) FILTER (o.pos <> w.pos), '') AS proof,
  CASE WHEN any_value(n) = 1 THEN any_value(w.f) ELSE sha256(string_agg(CASE WHEN o.pos = w.pos THEN w.f ELSE h END, '' ORDER BY o.pos)) END AS f
  FROM w{k} w JOIN c{k} ON {group.replace('source', 'w.source')} IS NOT DISTINCT FROM g JOIN n{k} o ON {group.replace('source', 'w.source')} IS NOT DISTINCT FROM {group.replace('source', 'o.source')} AND o.pos // 16 = w.pos // 16 GROUP BY doc_id),
w{last} AS (SELECT doc_id, source, leaf, f, proof, pos FROM s{k})""")

    climb_by("source", depth)
    k, last = last, last + 1
    parts.append(f"""subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM n{k}),
n{last} AS (SELECT 0 AS source, pos, h FROM subroots),
w{last} AS (SELECT doc_id, 0 AS source, leaf, f, proof, s.pos FROM w{k} w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source)""")
    climb_by("source", source_depth)
    return ",\n".join(parts) + f"""
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
FROM l JOIN w{last} w USING (doc_id) JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN n{last} t ON true
"""
