"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rollkin.llm import merkle_manifest

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text))


def tree_of(nodes):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = tree_of([leaf_of(*r) for r in by[s]])
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            proof = siblings(trees[s], i) + siblings(top, j)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(*r[:4], text)
            for left, right in proof:
                node = digest([*left, node, *right])
            out.append((r[0], leaf_of(*r), trees[s][-1][0], top[-1][0], digest(x for a, b in proof for x in a + b), node, node == top[-1][0]))
    return out


def compared(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("node", F.lit(1)).withColumn("block", F.lit("x")).repartition(3)
    found = [tuple(r) for r in merkle_manifest.manifest(df, **kw).select(*NAMES).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(plain(rows), key=key)
    return found


@pytest.mark.parametrize(("levels", "n"), [(0, 300), (1, 16), (1, 17), (1, 4200), (2, 257), (2, 5000)])
def test_one_large_source_and_small_ones(spark, levels, n):
    rows = [(i * 3, "big", "en", i, f"Text {i} OF a" if i % 3 else "lower only") for i in range(n)] + [(100_001, "Small", None, None, "One Leaf"), (100_002, None, "de", 4, None)]
    found = compared(spark, rows, levels=levels)
    assert {r[-1] for r in found} == {True, False} or n < 20


def test_many_sources_make_a_tree_of_their_own(spark):
    compared(spark, [(i, f"é{i % 290}" if i % 41 else None, "en", i, "A b") for i in range(700)])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", 0, ""), (2, "a", "en", 3, "É x" * 50_000), (2, "a", "en", 3, "other"), (7, "a", None, None, "SAME"), (7, "a", None, None, "SAME"), (-5, "a", "en", 1, "X")]
    compared(spark, rows)
    compared(spark, rows[:1])


def test_empty_table(spark):
    df = merkle_manifest.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"))
    assert df.columns == NAMES and df.count() == 0


def test_untampered_leaves_are_folded_up_as_well():
    """A root that leaf and siblings don't lead to must show."""
    leaves = [bytes([i]) * 32 for i in range(20)]
    row = {"ids": list(range(20)), "leaves": leaves, "forged": [None] * 20, "n_blocks": 1, "proof": [], "top_proof": [], "subroot": "0" * 64, "root": "0" * 64}
    *_, folded, verified = merkle_manifest._proved(row, 2)
    assert len(set(folded)) == 1 and folded[0] != "0" * 64 and not any(verified)
