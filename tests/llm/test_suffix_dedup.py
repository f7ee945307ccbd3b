"""Removal of repeated 50-byte strings against a plain search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkin.llm import suffix_dedup


def plain(rows):
    """rows: (doc_id, text). The first document of every window, then the bytes that a later one loses."""
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49) if i is not None else ():
            w = data[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 49) if i is not None else ():
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def compared(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("k1", F.lit("x")).repartition(3)
    found = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)
    return found


def noise(seed, n, letters="abcdefgh "):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


def rows_with_repeats(n):
    r = np.random.default_rng(n)
    shared = [noise(1000 + k, int(r.integers(49, 200))) for k in range(12)]
    rows = []
    for i in range(n):
        text = "".join(noise(i * 50 + j, int(r.integers(0, 120))) + (shared[r.integers(12)] if r.random() < 0.7 else "é漢") for j in range(6))
        rows.append((int(i * 7 % n), text))
    return rows


def test_shared_passages_equal_a_plain_search(spark):
    found = compared(spark, rows_with_repeats(120))
    assert sum(r[2] > 0 for r in found) > 60


@pytest.mark.parametrize("hot", [0, 3])
def test_windows_of_frequent_anchors_are_sent_one_by_one(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD", 700)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_KEYS", 500)
    compared(spark, rows_with_repeats(90))


def test_odd_rows(spark):
    a, b = noise(1, 400), noise(2, 300)
    compared(spark, [
        (1, None), (2, ""), (3, a), (4, a), (4, a), (5, a[:49]), (6, a[:50]), (7, b + a[100:149]), (7, b + a[100:150]), (8, b[:80] + a[50:180] + b[80:]), (None, a), (None, None), (0, b[10:120]),
        (9, "x" * 5000), (10, "x" * 3000 + a), (-3, a[200:260] + b[200:260]), (11, "ab" * 400), (12, "ba" * 300), (13, "\0" * 120), (14, "q" + "\0" * 90), (15, b + b), (16, "é" * 60), (17, "é" * 30 + "z"),
    ])


def test_long_text_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    a = noise(5, 30_000)
    compared(spark, [(1, a), (2, a[500:9000] + noise(6, 500) + a[100:2000]), (3, noise(7, 20_000))])


def test_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    compared(spark, rows)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string, part string")).count() == 0


def test_merged_intervals_equal_sorting():
    """Intervals from merged transforms are those of all windows sorted together."""
    r = np.random.default_rng(3)
    strings = [r.integers(97, 99, size=60).astype(np.uint8) for _ in range(30)]
    strings += [strings[k].copy() for k in (1, 5)] + [np.r_[strings[2][5:], strings[3][:5]]]
    texts = [np.concatenate(strings[:20]), np.concatenate(strings[20:])]
    ends = [np.concatenate([60 * i + 50 + np.arange(11) for i in range(n)]) for n in (20, 13)]
    docs = [np.repeat(np.arange(20), 11).astype(np.int32), np.repeat(np.arange(20, 33), 11).astype(np.int32)]
    first = {}
    windows = [(d, s[o : o + 50].tobytes()) for d, s in enumerate(strings) for o in range(11)]
    for d, w in windows:
        first.setdefault(w, d)
    several = {w for d, w in windows if first[w] != d}
    found = {int(i): int(d) for part in suffix_dedup.merged_intervals(texts, ends, docs) for i, d in zip(*part)}
    assert found == {i: first[w] for i, (_, w) in enumerate(windows) if w in several}
