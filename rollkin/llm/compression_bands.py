"""Quality rules with compression bands.

A text that zstandard shrinks far more than prose of its length repeats itself; one
that it hardly shrinks is random or encoded data. Whole documents are held against
limits for their length, and so are fixed chunks, each against the limits for its own
length, which shows a document of which only the larger part is junk.

The lower limits follow from what encoded data is. The upper ones are fitted, where
there are labels: how well good texts of each length compress depends on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.llm.arrow_text import mix, slices, split_words, starts_of, texts_of
from rollkin.sources.scratch import broadcast_if_small, discard, written


#: The fewest labelled texts that upper limits are fitted on.
ENOUGH = 100
#: Ids that are broadcast at most, and the logarithm of the length about which the fit's sums are taken.
SMALL_IDS, MIDDLE = 500_000, 11.0


@dataclass(frozen=True)
class Bands:
    """Limits on size / compressed size.

    ``limits``: (bytes, lowest ratio, highest ratio) in rising order; between two
    lengths the limits are interpolated by the logarithm of the length, beyond the last
    they stay. Texts shorter than the first length are not judged. Ordinary prose has
    about 1.5 at 400 bytes, 2 at 2,000 and 2.5 to 3 at 100,000; the upper limits given
    here leave a quarter or more above that. Base64 can't have more than 8/6, random
    letters and digits in words little more (1.4 at any length); the lower limits from
    1,200 bytes on lie above both and below prose. Under that, where the two come
    close, they lie below prose and catch most such texts.

    ``chunk``: bytes of a chunk; a rest that is too short to be judged belongs to the
    last chunk. A document goes if more than ``chunk_share`` of its bytes are in chunks
    above the limits for their length, or more than that in chunks below them.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (200, 1.1, 2.4), (300, 1.17, 2.4), (400, 1.25, 2.5), (550, 1.32, 2.5), (800, 1.35, 2.5), (1200, 1.45, 2.8), (2500, 1.6, 3.0), (5000, 1.6, 3.2), (20000, 1.6, 3.6), (100000, 1.6, 4.5),
    )
    chunk: int = 4096
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest ratio of texts of these sizes."""
        at, low, high = (np.array(x, dtype=float) for x in zip(*self.limits))
        x = np.log2(np.maximum(sizes, 1))
        return np.interp(x, np.log2(at), low), np.interp(x, np.log2(at), high)


SCHEMA = (
    "doc_id {id_type}, n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_ratios array<double>, reason string"
)


def repeated_window_words(text: np.ndarray, codes: np.ndarray, starts: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words that lie in a ``width``-word window which the text holds twice or more."""
    n_texts, n = len(starts) - 1, len(codes)
    if n < width:
        return np.zeros(n_texts, dtype=np.int64)
    first = np.arange(n - width + 1)
    first = first[text[first] == text[first + width - 1]]
    key = mix(text[first].astype(np.uint64) + np.uint64(1))
    for i in range(width):
        key = mix(key + codes[first + i].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(first), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(width):
        covered[first[again] + i] = True
    return np.bincount(text[covered], minlength=n_texts)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    lines = flat.filter(full).dictionary_encode()
    text = parent.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.unique(text * max(1, len(lines.dictionary)) + lines.indices.to_numpy(zero_copy_only=False))
    return np.bincount(text, minlength=len(texts)) - np.bincount(keys // max(1, len(lines.dictionary)), minlength=len(texts))


def chunk_ends(size: int, bands: Bands) -> list[int]:
    """Where the chunks of a text of ``size`` bytes end; none if it is one chunk."""
    ends = [*range(bands.chunk, size, bands.chunk), size]
    if len(ends) > 1 and size - ends[-2] < bands.limits[0][0]:
        del ends[-2]
    return ends if len(ends) > 1 else []


def band_verdict(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, list[float], str | None]:
    """Ratio of the whole text (null if too short to judge), ratios of its chunks, reason to reject it."""
    size = len(data)
    if size < bands.limits[0][0]:
        return None, [], None
    ends = [0, *chunk_ends(size, bands)]
    parts = [data, *(data[a:b] for a, b in zip(ends, ends[1:]))]
    sizes = np.array([len(p) for p in parts])
    ratios = sizes / np.array([len(packer.compress(p)) for p in parts])
    low, high = bands.of(sizes)
    above, below = ratios > high, ratios < low
    share = lambda outside: sizes[1:][outside[1:]].sum() > bands.chunk_share * size
    reason = (
        "repetitive" if above[0] else "incompressible" if below[0] else "repetitive chunks" if share(above) else "incompressible chunks" if share(below) else None
    )
    return float(ratios[0]), ratios[1:].tolist(), reason


def fitted(docs: DataFrame, good: DataFrame, bands: Bands = Bands(), sample: int | None = None, tail: float = 0.002, margin: float = 0.02) -> Bands:
    """``bands`` with upper limits that follow the ratios of good texts of each length.

    ``good``: ids (doc_id) of documents labelled as good; all their rows are used, or, with
    ``sample``, so many of them, the first by a hash. A parabola in the logarithm of the
    length is fitted to their ratios by least squares; the limits lie above it by what all
    but ``tail`` of the texts of about that length need, to three digits, and by ``margin``.
    Above the longest text they rise on as the parabola does at its end, and a tenth an
    octave more. With fewer than ``ENOUGH`` good texts that pass the base rules, ``bands``
    comes back unchanged. The driver gets sums and a row for each octave of lengths.
    """
    ids = good.select("doc_id").where("doc_id IS NOT NULL").distinct()
    if sample is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = judge(docs.select("doc_id", "text").join(broadcast_if_small(ids, SMALL_IDS), "doc_id", "left_semi"), bands).where("NOT base_failed AND ratio IS NOT NULL")
    if sample is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "n_bytes").limit(sample)
    rows = written(known.select(F.log2("n_bytes").alias("x"), F.col("ratio").alias("y")), "good_ratios")
    x, y = F.col("x") - MIDDLE, F.col("y")
    sums = rows.agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
        *[F.sum(F.pow(x, F.lit(k))).alias(f"x{k}") for k in range(5)], *[F.sum(y * F.pow(x, F.lit(k))).alias(f"y{k}") for k in range(3)],
    ).first()
    if sums["n"] < ENOUGH:
        discard(rows)
        return bands
    ends = sums["low"], sums["high"]
    degree = 2 if ends[1] - ends[0] > 3 else 0
    moments = np.array([[sums[f"x{i + k}"] for k in range(degree + 1)] for i in range(degree + 1)])
    # sums over partitions differ in their last digits from run to run
    about = np.round(np.linalg.solve(moments, [sums[f"y{k}"] for k in range(degree + 1)]), 9)
    curve = np.poly1d(about[::-1])(np.poly1d([1.0, -MIDDLE])).coeffs if degree else about
    off = F.round(y - sum(float(c) * F.pow(x, F.lit(k)) for k, c in enumerate(about)), 3)
    by_octave = rows.select(F.floor("x").alias("octave"), off.alias("off")).groupBy("octave").agg(F.count("*").alias("n"), F.percentile("off", F.lit(1 - tail)).alias("most"))
    needed = [(r["octave"] + 0.5, r["most"]) for r in by_octave.orderBy("octave").collect() if r["n"] >= ENOUGH // 2]
    mids, most = zip(*needed) if needed else ((sums["low"],), (rows.agg(F.percentile(off, F.lit(1 - tail))).first()[0],))
    discard(rows)
    at = np.arange(ends[0], ends[1] + 0.5, 0.5).clip(max=ends[1])
    high = np.polyval(curve, at) + np.interp(at, mids, most) + margin
    slope = max(0.0, np.polyval(np.polyder(curve), ends[1])) + 0.1
    at, high = np.append(at, ends[1] + 10), np.append(high, high[-1] + 10 * slope)
    sizes = np.unique(np.concatenate([2.0**at, [s for s, _, _ in bands.limits]]))
    return replace(bands, limits=tuple(zip(sizes.tolist(), bands.of(sizes)[0].tolist(), np.interp(np.log2(sizes), at, high).tolist())))


def judge(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts, compression ratios and the verdict.

    Only ``id_col`` and ``text_col`` are read, so other columns, whatever their names,
    don't matter. A null text counts as empty: all counts 0, ``base_failed``, not kept.
    A null id stays null; repeated rows are judged alike, each on its own. A text of
    any length is taken whole. An empty table gives an empty result.
    """
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _judged(part, bands, packer)

    return source.mapInArrow(work, SCHEMA.format(id_type=source.schema["doc_id"].dataType.simpleString()))


def _judged(part: pa.RecordBatch, bands: Bands, packer: zstandard.ZstdCompressor) -> pa.RecordBatch:
    texts = texts_of(part, "text")
    words = split_words(texts)
    n_words = words.counts
    lengths = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)
    chars = np.bincount(words.text, weights=lengths[words.codes] if len(lengths) else None, minlength=len(texts)).astype(np.int64)
    symbols = pc.count_substring_regex(texts, "[#*$%&|<>]")
    repeats = repeated_window_words(words.text, words.codes, starts_of(n_words))
    failed = (n_words < bands.min_words) | (100 * repeats > bands.max_repeat_percent * n_words)
    verdicts = [band_verdict(t.as_buffer().to_pybytes(), bands, packer) for t in texts]
    reasons = ["base" if bad else v[2] for bad, v in zip(failed, verdicts)]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()), symbols.cast(pa.int64()),
            pa.array(repeated_lines(texts), pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed),
            pa.array([r is None for r in reasons]), pa.array([v[0] for v in verdicts], pa.float64()),
            pa.array([v[1] for v in verdicts], pa.list_(pa.float64())), pa.array(reasons, pa.string()),
        ],
        names=["doc_id", "n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_ratios", "reason"],
    )


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others, kept) that pass.

    The verdict depends on the text alone, so it is computed beside the row and no
    join is needed. Nulls, repeats and empty tables: as in ``judge``.
    """
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _judged(part.select(["doc_id", "text"]), bands, packer)
                yield part.filter(found.column("kept"))

    return docs.mapInArrow(work, schema)
