"""Hard negatives by the tree against a search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkin.llm import hyperplane_tree as ht

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i in (i for i in kept if i % 100 == 0):
        label, v = kept[i]
        scored = sorted((-score(v, w), j, other == label) for j, (other, w) in kept.items() if j != i)
        for p, j, _ in [x for x in scored if x[2]][:5]:
            fit = [(s, k) for s, k, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return out


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    found = [tuple(r) for r in ht.hard_negatives(df).collect()]
    assert sorted(found) == sorted(plain(rows))
    return found


def clusters(seed, n, dim=12, groups=9):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(groups, size=n)] + 0.4 * r.normal(size=(n, dim))
    return [(i, (v / np.linalg.norm(v) * r.uniform(0.5, 1)).tolist(), int(r.integers(4))) for i, v in enumerate(x)]


def test_all_pairs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ht, "CHUNK_ROWS", 40)
    monkeypatch.setattr(ht, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(ht, "LEAF_SAMPLE", 10)
    monkeypatch.setattr(ht, "LEAF_ROWS", 10)
    assert len(compared(spark, [(i * 10, v, label) for i, v, label in clusters(1, 500)])) > 500


def test_odd_rows(spark):
    same = [0.25, -0.5, 0.75]
    compared(spark, [(100 * i, same, i % 2) for i in range(30)] + [(None, same, 1), (1, None, 1), (2, same, None), (3, [0.1, None, 0.2], 1), (4, [float("nan"), 0.0, 0.0], 1),
                     (5, [float("inf"), 0.0, 0.0], 2), (6, [], 1), (7, [0.5], 0), (8, [-0.5, 0.5, -0.75], 1), (100, same, 1), (300, [1.0, 1.0, 1.0], 0), (-200, [0.9, -0.9, 0.9], 1)])
    assert compared(spark, [(100, same, 1)]) == []


def test_empty_table(spark):
    assert ht.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_too_long_for_exact_scores(spark):
    with pytest.raises(ValueError, match="too long"):
        ht.hard_negatives(spark.createDataFrame([(0, [1e9], 1)], SCHEMA))


def test_leaves_left_out_have_no_row_in_the_annulus():
    r = np.random.default_rng(4)
    rows = np.array([v for _, v, _ in clusters(2, 3000)]) * 256
    square = (rows * rows).sum(1).max()
    tree = ht.planted(rows[:1000], square)
    leaf, ranges = ht.route(tree, ht.lifted(rows, square))
    tree = tree._replace(low={i: np.full((len(n.points),) * 2, np.inf) for i, n in enumerate(tree.nodes)} | {i: a for i, (a, _) in ranges.items()}, high={i: np.full((len(n.points),) * 2, -np.inf) for i, n in enumerate(tree.nodes)} | {i: b for i, (_, b) in ranges.items()})
    queries = rows[r.choice(3000, 60)]
    away = ht.distances(np.c_[queries, np.zeros(60)], ht.lifted(rows, square))
    nearest = np.quantile(away, 0.001, axis=1)
    farthest = np.quantile(away, 0.004, axis=1)
    q, at = ht.reached(tree, queries, nearest, farthest)
    visited = set(zip(q.tolist(), at.tolist()))
    inside = (away >= nearest[:, None]) & (away <= farthest[:, None])
    assert all((int(a), int(leaf[b])) in visited for a, b in zip(*np.nonzero(inside)))
    assert len(visited) < 0.7 * 60 * tree.n_leaves
