"""Cross-entropy difference of two matched n-gram models.

A target model (texts known to be good) and a background model (all texts) are
interpolated bigram models over all words of the corpus, and a begin symbol. Both grow
with the corpus, so neither is ever held in one place. Texts are cut into slices of some
megabytes; each slice counts its own distinct words and bigrams, sends each key with its
counts once to the bucket its hash lies in, and gets the totals of the corpus back in
the order it sent them. However common a word is, a slice sends it once, so no bucket
outweighs another. Words and bigrams are told apart by 48-bit hashes.

A text is scored by what the other texts hold: its own counts are left out of either
model that it is part of. So a labelled text isn't scored by a model that has seen it,
and a text that stands in the corpus twice has a low background loss.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.llm.arrow_text import hashes, mix, slices, split_words, starts_of, texts_of
from rollkin.sources.scratch import broadcast_if_small, written

#: Hashes of the symbols that aren't words, and what sets the two kinds of keys apart.
UNKNOWN, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAIR, WORD = np.uint64(0x165667B19E3779F9), np.uint64(0x85EBCA77C2B2AE63)
KEY_BITS = 48
SMALL_LABELS = 2_000_000
SLICE_BYTES = 8 << 20
BUCKET_WORDS = 1 << 19


@dataclass(frozen=True)
class Settings:
    """``vocabulary``: numbers of symbols, the unknown and the begin symbol included; None: all words.

    ``pull``: the unigram estimate weighs as much in a bigram's as so many more
    occurrences of its context would.
    ``uniform_share``: weight of the uniform distribution in the unigram estimate, so that
    no probability is 0; it is the same in both models, whatever their sizes, so that a
    word that neither knows speaks for neither.
    """

    vocabulary: int | None = None
    pull: float = 20.0
    uniform_share: float = 0.02


def word_totals(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; A-Z folded. Counted per batch, then summed by word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 24 << 20):
                words = split_words(texts_of(part, "text"), lower=True)
                n = np.bincount(words.codes, minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, size: int) -> list[str]:
    """The ``size`` - 2 most frequent words of ``docs``; of equally frequent ones the first by code point."""
    top = word_totals(docs).orderBy(F.desc("n"), "word").limit(size - 2)
    return [r["word"] for r in top.collect()]


def pack(values: np.ndarray) -> bytes:
    """64-bit values, the bytes of equal weight side by side, compressed."""
    return zstandard.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel()


class Slice:
    """Keys of a slice's bigrams and words, from its word codes.

    ``codes``: number of each word; ``symbols``: hash of each number; ``counts``: words
    of each text. ``order`` sorts the keys, which is how they are sent and come back.
    A bigram's key has its count; a word's has its count, and how often it has a word
    behind it.
    """

    def __init__(self, codes: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        codes, symbols = codes.astype(np.int64), np.append(symbols, BEGIN)
        size = len(symbols)
        before = np.empty_like(codes)
        if len(codes):
            before[1:] = codes[:-1]
            before[starts_of(counts)[:-1][counts > 0]] = size - 1
        pairs, self.at = np.unique(before * size + codes, return_inverse=True)
        self.at = self.at.astype(np.int32)
        self.before, self.word, self.size = pairs // size, pairs % size, size
        self.text = np.repeat(np.arange(len(counts)), counts)
        one, spare = np.uint64(1), np.uint64(64 - KEY_BITS)
        self.keys = np.concatenate([mix(mix(symbols[self.before] + PAIR) + symbols[self.word]) >> spare & ~one, mix(symbols ^ WORD) >> spare | one])
        self.order = np.argsort(self.keys, kind="stable")

    def parts(self, pair_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all keys, count and count with a word behind, from the counts of the bigrams."""
        total = lambda of: np.bincount(of, weights=pair_values, minlength=self.size).astype(np.int64)
        return np.concatenate([pair_values, total(self.word)]), np.concatenate([np.zeros(len(pair_values), dtype=np.int64), total(self.before)])

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of the slice, how often its own text has its bigram, its context and itself."""
        found = []
        for key, n in ((self.at, len(self.before)), (self.before[self.at], self.size), (self.word[self.at], self.size)):
            _, at, times = np.unique(self.text * n + key, return_inverse=True, return_counts=True)
            found.append(times.astype(np.int32)[at])
        return tuple(found)

    def losses(self, count: np.ndarray, context: np.ndarray, own: tuple[np.ndarray, ...], n_words: np.ndarray, n_symbols: int, settings: Settings) -> np.ndarray:
        """-log2 probability of each of the slice's words, from the corpus' totals of the keys less ``own``.

        ``n_words``: words of the corpus, without the own text's where these are left out.
        """
        n, share = len(self.before), settings.uniform_share
        pair = count[:n][self.at] - own[0]
        held = context[n:][self.before[self.at]] - own[1]
        word = count[n:][self.word[self.at]] - own[2]
        unigram = (1 - share) * word / np.maximum(n_words, 1) + np.where(n_words > 0, share, 1.0) / n_symbols
        return -np.log2((pair + settings.pull * unigram) / (held + settings.pull))


def slices_of(docs: DataFrame, words: list[str] | None) -> DataFrame:
    """A row for each slice of ``docs`` (doc_id, text, is_target): its ids, and its words as numbers."""
    known = None if words is None else pa.array(words, pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = split_words(texts_of(part, "text"), lower=True)
                symbols, codes = hashes(found.dictionary) >> np.uint64(64 - KEY_BITS), found.codes
                if known is not None:
                    symbols = np.where(pc.is_in(found.dictionary, value_set=known).to_numpy(zero_copy_only=False), symbols, UNKNOWN)
                    symbols, at = np.unique(symbols, return_inverse=True)
                    codes = at[codes]
                good = part.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int.from_bytes(os.urandom(7))], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        *(pa.array([pack(x)], pa.binary()) for x in (found.counts, good, codes, symbols)),
                        pa.array([len(codes)], pa.int64()), pa.array([int(found.counts[good].sum())], pa.int64()),
                    ],
                    names=["slice", "doc_ids", "counts", "good", "codes", "symbols", "n_background", "n_target"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"slice long, doc_ids array<{kind}>, counts binary, good binary, codes binary, symbols binary, n_background long, n_target long")


def _counted(row: dict) -> tuple[Slice, np.ndarray]:
    """The slice in ``row``, and the words of its texts."""
    counts = unpack(row["counts"]).astype(np.int64)
    return Slice(unpack(row["codes"]), unpack(row["symbols"]), counts), counts


def distinct_words(cut: DataFrame) -> int:
    """Number of distinct words in all slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("symbols").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(data).view(np.int64), pa.int64())], names=["symbol"])

    return cut.select("symbols").mapInArrow(work, "symbol long").agg(F.count_distinct("symbol")).first()[0]


VALUES = ("target", "target_context", "background", "background_context")


def corpus_totals(cut: DataFrame, n_buckets: int) -> DataFrame:
    """(slice, bucket, VALUES): the corpus' totals of a slice's keys of a bucket, in key order."""
    kinds = ", ".join(f"{v} binary" for v in VALUES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own, counts = _counted(row)
                good = np.repeat(unpack(row["good"]) > 0, counts)
                n = len(own.before)
                values = [v[own.order] for at in (own.at[good], own.at) for v in own.parts(np.bincount(at, minlength=n).astype(np.int64))]
                keys = own.keys[own.order]
                bucket = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    x = slice(ends[b], ends[b + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["slice"]], pa.int64()), pa.array([b], pa.int64()), *(pa.array([pack(v)], pa.binary()) for v in (np.diff(keys[x], prepend=np.uint64(0)), *(v[x] for v in values)))],
                        names=["slice", "bucket", "keys", *VALUES],
                    )

    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slice")
        parts = [np.cumsum(unpack(k), dtype=np.uint64) for k in rows["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        ends = starts_of(np.array([len(p) for p in parts]))
        replies = []
        for name in VALUES:
            sent = np.concatenate([unpack(v) for v in rows[name].to_pylist()]).astype(np.float64)
            total = np.bincount(at, weights=sent, minlength=len(keys)).astype(np.int64)[at]
            replies.append(pa.array([pack(total[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
        return pa.table([rows["slice"], rows["bucket"], *replies], names=["slice", "bucket", *VALUES])

    sent = cut.select("slice", "counts", "good", "codes", "symbols").mapInArrow(send, f"slice long, bucket long, keys binary, {kinds}")
    return sent.groupBy("bucket").applyInArrow(add_up, f"slice long, bucket long, {kinds}")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, target_loss, background_loss and score.

    ``targets``: the ids (doc_id) of the documents that make up the target corpus.
    Losses are bits a word; score = target_loss - background_loss, so the lower the
    more like the target corpus. Each row is scored by models of all other rows. A null
    text, or one without words, has 0 words and null losses and score. Null ids are in
    no target corpus. Repeated rows give a row each, count as often in the models, and
    are other rows to each other. Other columns aren't read; an empty table gives an
    empty result. With no other text in a model, that model is the uniform one.
    """
    texts = docs.select("doc_id", "text")
    words = None if settings.vocabulary is None else vocabulary_of(texts, settings.vocabulary)
    good = written(targets.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True)), "targets")
    marked = texts.join(broadcast_if_small(good, SMALL_LABELS), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    cut = written(slices_of(marked, words), "slices")
    n = cut.agg(F.coalesce(F.sum("n_target"), F.lit(0)).alias("target"), F.coalesce(F.sum("n_background"), F.lit(0)).alias("background")).first()
    totals = corpus_totals(cut, 1 + n["background"] // BUCKET_WORDS)
    n_symbols = 1 + (distinct_words(cut) if words is None else len(words))
    n_words = {"target": n["target"], "background": n["background"]}

    def score(rows: pa.Table, replies: pa.Table) -> pa.Table:
        row = rows.select(["counts", "good", "codes", "symbols"]).to_pylist()[0]
        whole, counts = _counted(row)
        replies, own = replies.sort_by("bucket"), whole.own()
        none, mean = counts == 0, []
        for name, part_of in (("target", unpack(row["good"]) > 0), ("background", np.ones(len(counts), dtype=bool))):
            found = []
            for values in (name, f"{name}_context"):
                back = [unpack(v) for v in replies[values].to_pylist()]
                found.append(np.zeros(len(whole.keys), dtype=np.int64))
                found[-1][whole.order] = np.concatenate(back) if back else 0
            inside = part_of[whole.text]
            others = n_words[name] - np.where(part_of, counts, 0)
            loss = whole.losses(*found, [np.where(inside, x, 0) for x in own], others[whole.text], n_symbols, settings)
            mean.append(np.bincount(whole.text, weights=loss, minlength=len(counts)) / np.maximum(counts, 1))
        return pa.table(
            [pc.list_flatten(rows["doc_ids"]), pa.array(counts, pa.int64()), *(pa.array(np.round(x, 6), pa.float64(), mask=none) for x in (*mean, mean[0] - mean[1]))],
            names=["doc_id", "n_words", "target_loss", "background_loss", "score"],
        )

    kind = texts.schema["doc_id"].dataType.simpleString()
    both = cut.select("slice", "doc_ids", "counts", "good", "codes", "symbols").groupBy("slice").cogroup(totals.groupBy("slice"))
    return both.applyInArrow(score, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")
