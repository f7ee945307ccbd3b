"""Hard negatives by a multiway hyperplane tree (GNAT) over integer vectors.

Scores are inner products, so every row gets one more coordinate that brings all rows to
one length; a query has 0 there. Distances then fall as scores rise, and a window of
scores is an annulus around the query.

Split points come from a bounded sample, every row is dealt to the nearest one on each
level. For any two split points i and j of a node the tree keeps how near and how far the
rows below j are to i, over all rows. A query that knows its distance to i leaves out the
subtree of j if that range misses every distance from i at which a row in the query's
annulus can be. Leaves are searched exactly, with integer scores.

Each search has two rounds: the query's own leaf first, which bounds how low a score can
still matter, then all other leaves that this bound doesn't leave out. Leaves are cut into
chunks of rows and their queries into blocks, so that no leaf, however many rows are alike,
is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import written

FANOUT, DEPTH = 8, 3
#: Rows, and bytes, of the sample that split points are taken from.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
#: Nodes aren't split that stand for fewer rows, or hold fewer of the sample: small leaves cost more in visits than they save.
LEAF_ROWS, LEAF_SAMPLE = 1024, 48
#: Rows of a leaf and queries of a leaf that meet in one group.
CHUNK_ROWS, BLOCK_QUERIES = 8192, 1024


class Node(NamedTuple):
    """Split points of one node; ``children`` are numbers of nodes, or -1 - number of a leaf."""

    points: np.ndarray
    children: np.ndarray


class Tree(NamedTuple):
    nodes: list[Node]
    n_leaves: int
    square: float  # of the length that all rows are brought to
    low: dict[int, np.ndarray]  # by node: [i, j] least distance of rows below j to point i
    high: dict[int, np.ndarray]

    @property
    def slack(self) -> float:
        """More than rounding can change a distance by."""
        return 1e-4 * float(np.sqrt(self.square + 1))


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    """``vectors`` with the coordinate that brings their squared length to ``square``."""
    return np.c_[vectors, np.sqrt(np.maximum(0.0, square - (vectors * vectors).sum(1)))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def planted(sample: np.ndarray, square: float, fanout: int = FANOUT, depth: int = DEPTH, least: int = LEAF_SAMPLE) -> Tree:
    """A tree over ``sample`` (vectors in random order), without ranges yet."""
    nodes, leaves = [], 0

    def grow(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        points = rows[:1]
        if level < depth and len(rows) > least:
            among = rows[: 3 * fanout]
            away = distances(among, points)[:, 0]
            while len(points) < fanout and away.max() > 1e-3 * np.sqrt(square + 1):  # the farthest from those chosen
                points = np.r_[points, among[away.argmax()][None]]
                away = np.minimum(away, distances(among, points[-1:])[:, 0])
        if len(points) < 2:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        near = distances(rows, points).argmin(1)
        nodes[at] = Node(points, np.array([grow(rows[near == j], level + 1) for j in range(len(points))]))
        return at

    grow(lifted(sample, square), 0)
    return Tree(nodes, leaves, square, {}, {})


def route(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The leaf of each row (lifted), and by node the least and largest distances from points to the rows below each child."""
    leaf, ranges = np.zeros(len(rows), dtype=np.int64), {}
    if not tree.nodes or not len(rows):
        return leaf, ranges
    waiting = [(0, np.arange(len(rows)))]
    while waiting:
        at, mine = waiting.pop()
        away = distances(rows[mine], tree.nodes[at].points)
        near, k = away.argmin(1), away.shape[1]
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for j, child in enumerate(tree.nodes[at].children):
            below = near == j
            if not below.any():
                continue
            low[:, j], high[:, j] = away[below].min(0), away[below].max(0)
            if child < 0:
                leaf[mine[below]] = -1 - child
            else:
                waiting.append((int(child), mine[below]))
        ranges[at] = low, high
    return leaf, ranges


def reached(tree: Tree, queries: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs: leaves that may have rows from ``nearest`` to ``farthest`` of each query (not lifted)."""
    if not tree.nodes:
        q = np.flatnonzero(nearest <= farthest)
        return q, np.zeros(len(q), dtype=np.int64)
    rows = np.c_[queries, np.zeros(len(queries))]
    found, waiting = [], [(0, np.flatnonzero(nearest <= farthest))]
    while waiting:
        at, mine = waiting.pop()
        away = distances(rows[mine], tree.nodes[at].points)[:, :, None]
        most, least = farthest[mine][:, None, None] + tree.slack, nearest[mine][:, None, None] - tree.slack
        hit = ((tree.low[at] <= away + most) & (tree.high[at] >= np.maximum(away - most, least - away))).all(1)
        for j, child in enumerate(tree.nodes[at].children):
            into = mine[hit[:, j]]
            if not len(into):
                continue
            if child < 0:
                found.append((into, np.full(len(into), -1 - child, dtype=np.int64)))
            else:
                waiting.append((int(child), into))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): one row an id, integer components, labels shifted where 7 divides the id."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")


class Index(NamedTuple):
    tree: Tree
    rows: DataFrame  # vec_id, label, v, leaf
    counts: dict[int, int]  # rows of each leaf, at most FANOUT ** DEPTH of them
    dim: int


def index(rows: DataFrame) -> Index:
    """The tree and every row's leaf. ``rows``: (vec_id, label, v)."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")).first()
    dim, square = max(1, size["dim"] or 1), float(size["square"] or 0)
    if square * (1 + 1e-9) >= 2**53:
        raise ValueError("vectors too long for exact scores: the largest squared length is 2 ** 53 or more")
    even = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    n_sample = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
    sample = even.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_sample).select("v").toArrow()
    least = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) // max(1, size["n"]))
    tree = planted(_matrix(sample["v"], dim), square, least=least) if len(sample) else Tree([], 1, square, {}, {})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = route(tree, lifted(_matrix(batch.column("v"), dim), square))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = written(even.mapInArrow(place, "vec_id long, label long, v array<long>, leaf long"), "placed")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distances of all rows of a task, kept by node."""
        low = {i: np.full((len(n.points),) * 2, np.inf) for i, n in enumerate(tree.nodes)}
        high = {i: -x for i, x in low.items()}
        for batch in batches:
            for at, (a, b) in route(tree, lifted(_matrix(batch.column("v"), dim), square))[1].items():
                low[at], high[at] = np.minimum(low[at], a), np.maximum(high[at], b)
        for at in low:
            i, j = np.nonzero(high[at] >= low[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), at)), pa.array(i), pa.array(j), pa.array(low[at][i, j]), pa.array(high[at][i, j])], names=["node", "i", "j", "low", "high"])

    low = {i: np.full((len(n.points),) * 2, np.inf) for i, n in enumerate(tree.nodes)}
    high = {i: -x for i, x in low.items()}
    # At most FANOUT ** 2 rows a node of the tree.
    for r in placed.select("v").mapInArrow(spans, "node long, i long, j long, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["node"]][r["i"], r["j"]], high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    return Index(tree._replace(low=low, high=high), placed, counts, dim)


def _meet(ix: Index, queries: DataFrame, search, schema: str) -> DataFrame:
    """``search(queries, rows)`` for each block of queries of a leaf and each chunk of its rows. ``queries`` has a row for each leaf that a query visits."""
    visits = {r["leaf"]: r["count"] for r in queries.groupBy("leaf").count().collect()}  # at most one row a leaf
    shape = [(leaf, -(-ix.counts[leaf] // CHUNK_ROWS), -(-n // BLOCK_QUERIES)) for leaf, n in visits.items() if leaf in ix.counts]

    def spread(df: DataFrame, one: str, other: str) -> DataFrame:
        plan = F.broadcast(df.sparkSession.createDataFrame(shape, "leaf long, n_chunks long, n_blocks long"))
        dealt = df.join(plan, "leaf").withColumn(one, F.pmod(F.xxhash64("vec_id"), F.col(f"n_{one}s")))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}s") - 1))).drop("n_chunks", "n_blocks")

    key = ["leaf", "chunk", "block"]
    return spread(queries, "block", "chunk").groupBy(*key).cogroup(spread(ix.rows, "chunk", "block").groupBy(*key)).applyInArrow(search, schema)


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group by falling score, then id, as ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


FOUND = "anchor_id long, other_id long, score long"


def _top(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the first ``n`` allowed rows of each query. ``ids`` ascend."""
    query, row = np.nonzero(ok)
    order = np.lexsort((ids[row], -scores[query, row], query))
    query, row = query[order], row[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < n], row[place < n]


def _scored(queries: pa.Table, rows: pa.Table, dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Queries in runs of 64 with their integer scores against ``rows``, exact as no sum reaches 2 ** 53."""
    right = _matrix(rows["v"], dim)
    for low in range(0, len(queries), 64):
        some = queries.slice(low, 64)
        yield some, np.rint(_matrix(some["v"], dim) @ right.T).astype(np.int64)


def positives(ix: Index, anchors: DataFrame, n: int) -> DataFrame:
    """(anchor_id, other_id, score, rank): the first ``n`` other rows of an anchor's label."""
    dim, tree = ix.dim, ix.tree

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(rows):
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for some, scores in _scored(queries, rows, dim):
                own = some["vec_id"].to_numpy()
                q, r = _top(scores, ids, (some["label"].to_numpy()[:, None] == labels) & (own[:, None] != ids), n)
                out.append((own[q], ids[r], scores[q, r]))
        return pa.table([pa.array(np.concatenate(x) if out else [], pa.int64()) for x in (zip(*out) if out else ((), (), ()))], names=["anchor_id", "other_id", "score"])

    near = written(_first(_meet(ix, anchors, search, FOUND), ["anchor_id"], n), "near")
    bound = near.where(F.col("rank") == n).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("least"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            farthest = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, (v * v).sum(1) + tree.square - 2 * np.nan_to_num(least))))
            q, leaf = reached(tree, v, np.zeros(len(v)), farthest)
            other = leaf != batch.column("leaf").to_numpy()[q]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(q[other])) for c in ("vec_id", "label", "v")] + [pa.array(leaf[other])], names=["vec_id", "label", "v", "leaf"])

    more = written(anchors.join(bound, "vec_id", "left").mapInArrow(visit, "vec_id long, label long, v array<long>, leaf long"), "visits")
    return written(_first(near.drop("rank").unionByName(_meet(ix, more, search, FOUND)), ["anchor_id"], n), "positives")


def negatives(ix: Index, anchors: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(anchor_id, positive_id, other_id, score, rank): rows of other labels with 80 to 100 per cent of the positive's score, the first ``n``."""
    dim, tree = ix.dim, ix.tree
    chosen = found.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("other_id", "score"))).alias("chosen"))
    asked = written(anchors.join(chosen, "vec_id"), "asked")
    schema = "anchor_id long, positive_id long, other_id long, score long"

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(rows):
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for some, scores in _scored(queries, rows, dim):
                own, chosen = some["vec_id"].to_numpy(), some["chosen"].to_pylist()
                apart = some["label"].to_numpy()[:, None] != labels
                for k in range(max(len(c) for c in chosen)):
                    has = np.array([len(c) > k for c in chosen])
                    score = np.array([c[k]["score"] if len(c) > k else 0 for c in chosen])
                    other = np.array([c[k]["other_id"] if len(c) > k else 0 for c in chosen])
                    floor = np.array([(c[k].get("floor") if len(c) > k else None) or 0 for c in chosen])
                    ok = apart & has[:, None] & (80 * score[:, None] <= 100 * scores) & (scores <= score[:, None]) & (scores >= floor[:, None])
                    q, r = _top(scores, ids, ok, n)
                    out.append((own[q], other[q], ids[r], scores[q, r]))
        return pa.table([pa.array(np.concatenate(x) if out else [], pa.int64()) for x in (zip(*out) if out else ((),) * 4)], names=["anchor_id", "positive_id", "other_id", "score"])

    by = ["anchor_id", "positive_id"]
    near = written(_first(_meet(ix, asked, search, schema), by, n), "near_negatives")
    floors = near.where(F.col("rank") == n).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "score"))).alias("floors"))
    with_floor = F.transform("chosen", lambda c: F.struct(c["other_id"].alias("other_id"), c["score"].alias("score"), F.col("floors")[c["other_id"]].alias("floor")))
    bounded = asked.join(floors, "vec_id", "left").withColumn("chosen", with_floor).drop("floors")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            whole = (v * v).sum(1) + tree.square
            pairs = []
            chosen = batch.column("chosen").to_pylist()
            for k in range(max((len(c) for c in chosen), default=0)):  # an annulus for each positive
                has = np.array([len(c) > k for c in chosen])
                high = np.array([c[k]["score"] if len(c) > k else 0 for c in chosen], dtype=np.float64)
                low = np.array([max(0.8 * c[k]["score"], c[k]["floor"] or 0) if len(c) > k else 0 for c in chosen], dtype=np.float64)
                nearest, farthest = (np.sqrt(np.maximum(0.0, whole - 2 * s)) for s in (high, low))
                pairs.append(np.c_[reached(tree, v, np.where(has, nearest, np.inf), np.where(has, farthest, -np.inf))])
            q, leaf = np.unique(np.concatenate(pairs), axis=0).T if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            other = leaf != batch.column("leaf").to_numpy()[q]
            names = ["vec_id", "label", "v", "chosen"]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(q[other])) for c in names] + [pa.array(leaf[other])], names=[*names, "leaf"])

    kind = "array<struct<other_id:bigint,score:bigint,floor:bigint>>"
    more = written(bounded.select("vec_id", "label", "v", "chosen", "leaf").mapInArrow(visit, f"vec_id long, label long, v array<long>, chosen {kind}, leaf long"), "negative_visits")
    return _first(near.drop("rank").unionByName(_meet(ix, more, search, schema)), by, n)


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors in ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose id ``every`` divides. Rows with a null id, label or vector,
    or with a null or non-finite component take no part; of rows that share an id the one
    with the smallest label, then vector, does. Shorter vectors are filled up with zeros;
    ties go by id. A positive with a negative score has no negatives. Other columns aren't
    read; an empty table gives an empty result. Vectors whose squared length reaches
    2 ** 53 raise an error.
    """
    ix = index(written(usable_rows(vectors), "vectors"))
    anchors = written(ix.rows.where(F.col("vec_id") % every == 0), "anchors")
    found = positives(ix, anchors, n_positives)
    against = negatives(ix, anchors, found, n_negatives)
    scores = found.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return against.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: DuckDB SQL for ``hard_negatives`` over ``embeddings`` with unique ids and vectors of one length.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 5
"""
