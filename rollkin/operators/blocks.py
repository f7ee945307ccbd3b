"""All pairs of records inside blocks, scored in pieces of bounded size.

A block is quadratic in its size whatever is done, so its pairs are neither stored nor
joined with anything. Both sides of a block are dealt into pieces of about
``SIDE_ROWS`` records by a hash of the id; each two pieces meet in one group, whose pairs
are scored as matrices over the distinct texts there. Only pairs that are found leave it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.sources.scratch import sorted_join

SIDE_ROWS = 1000


#: Sides of a record in a group: it stands on the first, the second or both.
FIRST, SECOND = 1, 2


def _dealt(records: DataFrame, key: str, columns: list[str], years: int | None, side_rows: int) -> DataFrame:
    """(year, key, band, piece_a, piece_b, side, id, age, columns): a row for each group that a record is in.

    With ``years`` a block falls into bands of ages, where the second side also stands in
    both neighbouring bands; without, it is one band.
    """
    age = F.coalesce("age", F.lit(0))
    band, block = (F.lit(0) if years is None else F.floor(age / (years + 1))).cast("int"), ["year", "key", "band"]
    rows = records.select("id", "year", F.col(key).alias("key"), age.alias("age"), *columns, band.alias("band"))
    near = lambda df: df if years is None else df.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"))
    dealt = lambda n: F.ceil(F.sum("n") / side_rows).cast("int")
    pieces = sizes.groupBy(*block).agg(dealt("n").alias("n_a")).join(sorted_join(near(sizes).groupBy(*block).agg(dealt("n").alias("n_b"))), block)
    own, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = F.lit(years is None) & (F.col("n_a") == 1)  # both sides of such a block are the same records
    sides = [
        side.join(sorted_join(pieces), block).where(kept).withColumn("piece_a", at_a).withColumn("piece_b", at_b).select(*block, "piece_a", "piece_b", place.cast("int").alias("side"), "id", "age", *columns)
        for side, kept, at_a, at_b, place in (
            (rows, F.lit(True), own("n_a"), every("n_b"), F.when(whole, FIRST | SECOND).otherwise(FIRST)), (near(rows), ~whole, every("n_a"), own("n_b"), F.lit(SECOND)),
        )
    ]
    return sides[0].union(sides[1])


def _sides_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the records on the first and on the second side."""
    side = group["side"].to_numpy()
    return np.flatnonzero(side & FIRST), np.flatnonzero(side & SECOND)


def scored_pairs(records: DataFrame, key: str, columns: list[str], years: int, score: Callable, kind: str, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(a, b, score, more): pairs a < b of one year with an equal ``key`` and ages within ``years`` that ``score`` keeps.

    ``score`` takes the Arrow rows of a group (id, age and ``columns``) and the places of its
    sides a and b, and gives matrices: the scores, which pairs it keeps, and a boolean
    ``more``; ``kind`` is the scores' type. Bands of ages as in ``rules.banded_pairs``.
    """
    block = ["year", "key", "band"]
    dealt = _dealt(records, key, columns, years, side_rows)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at_a, at_b = _sides_of(group)
        ids, ages = group["id"].to_numpy(), group["age"].to_numpy()
        values, kept, more = score(group, at_a, at_b)
        kept = kept & (ids[at_a][:, None] < ids[at_b]) & (np.abs(ages[at_a][:, None] - ages[at_b]) <= years)
        i, j = np.nonzero(kept)
        return pa.table({"a": ids[at_a[i]], "b": ids[at_b[j]], "score": values[i, j], "more": more[i, j]})

    return dealt.groupBy(*block, "piece_a", "piece_b").applyInArrow(compare, f"a long, b long, score {kind}, more boolean")


#: Records of a side where pairs are scored tile by tile; the sides of a tile, and pairs looked at together.
LARGE_SIDE, TILE, SLICE = 8000, (512, 2048), 200_000


def streamed_pairs(records: DataFrame, blocks: list[tuple[str, int | None]], columns: list[str], score: Callable, schema: str, side_rows: int = LARGE_SIDE) -> DataFrame:
    """What ``score`` gives over groups of records that hold all pairs of some blocks.

    ``blocks``: (key column, years) each, as for ``scored_pairs``; records whose key is null
    aren't in it. A record is sent to its groups once, sorted by group, so that small blocks
    are scored together and no group has to be held beside its matrices. ``score`` takes
    the Arrow rows of some whole groups (``group``, ``block``: the place in ``blocks``, side,
    id, age and ``columns``) and yields tables; ``tiles`` gives it the pairs.
    """
    dealt = [_dealt(records.where(F.col(key).isNotNull()), key, columns, years, side_rows).withColumn("block", F.lit(n)) for n, (key, years) in enumerate(blocks)]
    group = F.xxhash64("block", "year", "key", "band", "piece_a", "piece_b").alias("group")
    rows = reduce(DataFrame.union, dealt).select(group, "block", "side", "id", "age", *columns)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by bytes: these aren't merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            for found in score(rows):
                yield from found.to_batches()

    return rows.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], enough: int = SIDE_ROWS) -> Iterator[pa.Table]:
    """Sorted rows in runs of whole groups, ``enough`` rows at least where there are more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows and held and held[-1]["group"][-1] != batch["group"][0] and sum(b.num_rows for b in held) >= enough:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if not batch.num_rows:
            continue
        group = batch["group"].to_numpy(zero_copy_only=False)
        starts, done = np.flatnonzero(group[1:] != group[:-1]) + 1, 0
        for start in starts.tolist():
            if start - done + sum(b.num_rows for b in held) >= enough:
                yield pa.Table.from_batches([*held, batch.slice(done, start - done)]).combine_chunks()
                held, done = [], start
        held.append(batch.slice(done))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tiles(rows: pa.Table, holds: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs id_i < id_j of each group for which ``holds`` is true, some at a time; it gives a matrix over places of both sides."""
    (a, b), group, ids = _sides_of(rows), rows["group"].to_numpy(), rows["id"].to_numpy()
    for x in range(0, len(a), TILE[0]):
        for y in range(0, len(b), TILE[1]):
            p, q = a[x : x + TILE[0]], b[y : y + TILE[1]]
            kept = (group[p][:, None] == group[q]) & (ids[p][:, None] < ids[q])
            if kept.any():
                i, j = np.nonzero(kept & holds(p, q))
                for at in range(0, len(i), SLICE):
                    yield p[i[at : at + SLICE]], q[j[at : at + SLICE]]


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers; null is -1."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _counts(texts: list[str], grams: Callable[[str], list[str]]) -> np.ndarray:
    """A row for each text: how often it has each gram that occurs here. 32-bit floats hold such counts and their products exactly."""
    lists = [grams(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    number: dict[str, int] = {}
    column = np.fromiter((number.setdefault(g, len(number)) for row in lists for g in row), np.int64, int(lengths.sum()))
    place = np.repeat(np.arange(len(lists)), lengths) * max(len(number), 1) + column
    return np.bincount(place, minlength=len(lists) * max(len(number), 1)).reshape(len(lists), -1).astype(np.float32)


def over_texts(column: pa.ChunkedArray, at_a: np.ndarray, at_b: np.ndarray, grams: Callable[[str], list[str]], measure: Callable) -> np.ndarray:
    """The matrix of ``measure`` over the texts of both sides, worked out once for each two distinct texts; null counts as empty."""
    texts = column.combine_chunks().fill_null("").dictionary_encode()
    counts, place = _counts(texts.dictionary.to_pylist(), grams), texts.indices.to_numpy()
    (a, to_a), (b, to_b) = np.unique(place[at_a], return_inverse=True), np.unique(place[at_b], return_inverse=True)
    return measure(counts[a], counts[b])[to_a][:, to_b]


def word_grams(text: str) -> list[str]:
    """As ``similarity.word_grams``."""
    padded = (f"  {w} " for w in re.findall("[a-z0-9]+", text.lower()))
    return list({p[i : i + 3] for p in padded for i in range(len(p) - 2)})


def text_grams(text: str) -> list[str]:
    """As ``similarity.grams_of``."""
    padded = f"  {text} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def set_similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared over all grams of each two sets; 0 if both are empty."""
    shared = (a @ b.T).astype(np.float64)
    union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def cosine_similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return (a @ b.T).astype(np.float64) / (norm(a)[:, None] * norm(b))
