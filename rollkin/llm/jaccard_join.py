"""Jaccard self-join of word-shingle sets by PartEnum signatures, down to components.

Sets are put into bands of similar size. Within a band a similarity of at least t means
that two sets differ in at most k features. The feature domain is dealt by hash into
partitions, and each partition into n2 parts; a set's signatures for a partition are the
digests of the features it has in every n2 - k2 of these parts. If there are
floor(k / (k2 + 1)) + 1 partitions, similar sets differ in at most k2 features in one of
them, and so share the signature of the parts that these features leave untouched.

Two choices are used. In bands of small k, where a part alone tells little, k2 = 1 and
n2 = 3: half as many partitions, and of each the three pairs of parts. In bands of large
k, k2 = 0 and n2 = 1: the subset is the partition itself, the choice with the fewest
signatures.

Signatures of no features, and those that very many sets share because a passage or
line is common, would bring all those sets together. So there are e spare partitions,
which let a set leave out such signatures as long as they lie in at most e of them: of
the 1 + e partitions in which a similar set shares a signature, one is left. No such
pair is lost, since equal signatures are empty or common in both sets alike.

Sets with more common signatures than that (a passage makes up most of the text, or the
set has many near copies) leave them out too, and are enumerated once more among
themselves: of their features in the order of rarity, the first n - ceil(t n) + 1 are
signatures. Similar sets share one of these, while sets that have nothing but a passage
in common begin with features that no other set has.

Sets that share a signature are candidates if their sizes and 1024-bit parity sketches
allow the similarity (a sketch never differs in more bits than the sets in features);
those that are left are checked on their texts. Only links that can still join two
components matter: in each round every signature names a few leaders, its other sets
are checked against them, and what has become one component leaves. A group of
thousands of near copies is settled by its first leader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.llm.arrow_text import hashes, mix, slices, split_words, starts_of, texts_of
from rollkin.operators.components import connected_components
from rollkin.sources.scratch import broadcast_if_small, discard, written

SMALL_IDS = 1_000_000
LEADERS = 32
#: A signature that more sets share is common.
COMMON = 50
#: Differences up to which a partition's pairs of parts are its signatures, and the parts it has then.
ENUMERATED, PARTS = 24, 3
SKETCH = [f"q{i}" for i in range(16)]
#: Bytes of text and texts that a task works on at once.
SLICE, SLICE_ROWS = 2 << 20, 1_000
#: Cells (a power of two) that features are counted in to tell rare from common, and a salt of their signatures.
CELLS, RAREST = 1 << 20, np.uint64(0xA24BAED4963EE407)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of a shingle), distinct and sorted, over all texts.

    Words are lower-cased (A-Z); a text of fewer than ``width`` words has the whole
    sequence as its shingle, one without words none.
    """
    words = split_words(texts, lower=True)
    of_word = mix(hashes(words.dictionary)) if len(words.dictionary) else np.zeros(0, dtype=np.uint64)
    code, first = of_word[words.codes], starts_of(words.counts)[:-1]
    at = np.arange(len(code))
    last = (first + words.counts)[words.text] if len(code) else at
    full = at + width <= last
    begin = at[full | (at == first[words.text])] if len(code) else at
    key = np.zeros(len(begin), dtype=np.uint64)
    for i in range(width):
        inside = begin + i < last[begin]
        key[inside] = mix(key[inside] * np.uint64(3) + code[np.minimum(begin + i, len(code) - 1)][inside] + np.uint64(1))
    text = words.text[begin]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


class Bands:
    """Size bands for a similarity of ``percent`` / 100, each 40 % wider than the one before.

    A set belongs to the band of its size and, if it is so near to the lower end that a
    similar set can be below, to the band before. ``partitions[j]``: partitions of the
    domain in band j; ``spare[j]``: those that a set may leave signatures out of, for
    empty ones and a twelfth more; ``parts[j]``: parts of a partition.
    """

    def __init__(self, percent: int, largest: int):
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * 1.4)))
        self.low = np.array(low)
        small = self.low[1:] - 1  # largest size of a pair's smaller set
        large = small * 100 // percent
        self.reach = large
        k = (small + large) * (100 - percent) // (100 + percent)
        pairs = (k > 0) & (k <= ENUMERATED)
        self.parts = np.where(pairs, PARTS, 1)
        needed = np.where(pairs, k // 2, k) + 1
        partitions, spare = needed, np.zeros_like(k)
        for _ in range(6):
            # a signature has a partition's features, or those of two of its three parts
            share = np.where(pairs, (PARTS - 1) / PARTS, 1) / partitions
            empty = np.where(k > 0, partitions * np.where(pairs, PARTS, 1) * np.exp(-self.low[:-1] * share), 0)
            spare = np.where(k > 0, np.ceil(empty + 2 * np.sqrt(empty) + k / 12).astype(np.int64), 0)
            partitions = needed + spare
        self.partitions, self.spare = partitions, spare

    def of(self, sizes: np.ndarray) -> list[np.ndarray]:
        """The bands of each set: its own and, or else -1, the one before. Empty sets have none."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        before = np.where((own > 0) & (sizes <= self.reach[np.maximum(own - 1, 0)]), own - 1, -1)
        return [np.where(sizes > 0, own, -1), np.where(sizes > 0, before, -1)]


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent, 1 << 40)


def signatures(text: np.ndarray, key: np.ndarray, n_texts: int, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For a set's own band and the one before: (text, signature) ordered by text, and the spare partitions each text has left."""
    b = bands(percent)
    scrambled = mix(key ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for band in b.of(np.bincount(text, minlength=n_texts)):
        there = np.flatnonzero(band >= 0)
        cells, per, spare = np.zeros(n_texts, dtype=np.int64), np.ones(n_texts, dtype=np.int64), np.zeros(n_texts, dtype=np.int64)
        per[there], spare[there] = b.parts[band[there]], b.spare[band[there]]
        cells[there] = b.partitions[band[there]] * per[there]
        base = starts_of(cells)
        owner = np.repeat(np.arange(n_texts), cells)
        cell = np.arange(len(owner)) - base[owner]
        mine = band[text] >= 0
        spot = ((scrambled[mine] >> np.uint64(32)) * cells[text[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[text[mine]]
        digest, held = np.zeros(len(owner), dtype=np.uint64), np.bincount(spot, minlength=len(owner))
        np.add.at(digest, spot, scrambled[mine])
        # A cell is a part; where a partition has several, the cell's signature is the partition without it.
        several = np.flatnonzero(per[owner] > 1)
        if len(several):
            grid = several.reshape(-1, PARTS)
            digest[several] = (digest[grid].sum(axis=1, dtype=np.uint64)[:, None] - digest[grid]).ravel()
            held[several] = (held[grid].sum(axis=1)[:, None] - held[grid]).ravel()
        empty = held == 0
        left = spare - np.bincount(owner[empty], minlength=n_texts)
        sig = mix(digest + mix((band[owner].astype(np.uint64) << np.uint64(44)) + cell.astype(np.uint64) + np.uint64(1)))
        told = ~empty | (left[owner] < 0)
        out.append((owner[told], sig[told], left))
    return out


def parity_sketch(text: np.ndarray, key: np.ndarray, n_texts: int) -> np.ndarray:
    """1024 bits per text, as 16 integers: the parity of the features that hash to each."""
    bit = (mix(key) >> np.uint64(54)).astype(np.int64)
    odd = (np.bincount(text * 1024 + bit, minlength=n_texts * 1024) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_texts, 1024), axis=1).view(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sketch(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n (set size), s1 and s2 (digest of the set), parity sketch."""
    names = ["doc_id", "text_hash", "n", "s1", "s2", *SKETCH]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                text, key = shingle_sets(texts_of(part, "text"), words)
                rows = part.num_rows
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(np.bincount(text, minlength=rows), pa.int64())]
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.zeros(rows, dtype=np.uint64)
                    np.add.at(total, text, mix(key ^ np.uint64(salt)))
                    columns.append(_signed(total))
                columns += [pa.array(q, pa.int64()) for q in parity_sketch(text, key, rows).T]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, text_hash long, n long, s1 long, s2 long, " + ", ".join(f"{q} long" for q in SKETCH))


def _signature_rows(docs: DataFrame, words: int, percent: int, owners: bool) -> DataFrame:
    """(sig), or with ``owners`` (sig, doc, code), for every signature of every text.

    code = 2 * (spare partitions left + 1) + (0 for the own band, 1 for the one before);
    a set that needs more than it has gets 0 of them. Signatures are made anew from the texts
    whenever they are needed: stored, they would take as much room as the texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                text, key = shingle_sets(texts_of(part, "text"), words)
                ids = part.column("doc_id")
                for band, (owner, sig, left) in enumerate(signatures(text, key, part.num_rows, percent)):
                    if owners:
                        code = 2 * (np.maximum(left, -1) + 1) + band
                        columns = [_signed(sig), ids.take(pa.array(owner)), pa.array(code[owner], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=["sig", "doc", "code"])
                    else:
                        yield pa.RecordBatch.from_arrays([_signed(sig)], names=["sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"sig long, doc {kind}, code int" if owners else "sig long")


def _may_be_similar(percent: int) -> str:
    """SQL condition on the sizes and sketches of two sets, with suffixes _a and _b."""
    apart = " + ".join(f"bit_count({q}_a ^ {q}_b)" for q in SKETCH)
    sizes = f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a"
    return f"{sizes} AND {100 + percent} * ({apart}) <= {100 - percent} * (n_a + n_b)"


def _side(sets: DataFrame, name: str, side: str) -> DataFrame:
    return sets.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{side}") for c in ["n", *SKETCH]])


def _linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.join(broadcast_if_small(written(ids, "ids"), SMALL_IDS), "doc_id", "left_semi").select("doc_id", "text"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    ).select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a", SLICE, SLICE_ROWS):
                for part in slices(half, "text_b", SLICE):
                    text_a, key_a = shingle_sets(texts_of(part, "text_a"), words)
                    text_b, key_b = shingle_sets(texts_of(part, "text_b"), words)
                    text, key = np.concatenate([text_a, text_b]), np.concatenate([key_a, key_b])
                    order = np.lexsort((key, text))
                    text, key = text[order], key[order]
                    twice = (text[1:] == text[:-1]) & (key[1:] == key[:-1])
                    shared = np.bincount(text[1:][twice], minlength=part.num_rows)
                    union = np.bincount(text, minlength=part.num_rows) - shared
                    yield part.select(["a", "b"]).filter(pa.array(100 * shared >= percent * union))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _members(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n and component_id."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketch = written(_sketch(docs, words, percent), "sketch")
    classes = written(sketch.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(
        sketch.select("doc_id", "text_hash", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("doc_id", "text_hash", "n", "s1", "rep"), "members"
    )
    copies = broadcast_if_small(written(members.where("doc_id <> rep").select("doc_id", "text_hash").distinct(), "copies"), SMALL_IDS)
    sets = sketch.where("n > 0 AND doc_id IS NOT NULL").join(copies, ["doc_id", "text_hash"], "left_anti").select(F.col("doc_id").alias("doc"), "n", *SKETCH)
    single = docs.where("doc_id IS NOT NULL").join(copies, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text")
    open_rows = written(_shared_signatures(single, words, percent).where("doc > lead"), "followers")

    pairs = open_rows.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    checked = written(
        pairs.join(_side(sets, "a", "a"), "a").join(_side(sets, "b", "b"), "b").where(_may_be_similar(percent)).select("a", "b").distinct(), "pairs"
    )
    links = written(_linked(checked, docs, words, percent), "links")
    components = connected_components(links, "a", "b")
    open_rows = open_rows.select("sig", "doc")
    share = LEADERS
    while True:
        named = open_rows.join(components.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("comp"))
        named = written(named, "named")
        mixed = written(named.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("held")).where("c0 < c1"), "mixed")
        rows = written(
            named.join(mixed.select("sig", "held"), "sig").withColumn("leads", F.pmod(F.xxhash64("doc", "sig"), F.col("held")) < share), "open"
        )
        if rows.isEmpty():
            break
        known = rows.join(sets, "doc")
        lead = known.where("leads").select("sig", F.col("doc").alias("lead"), F.col("comp").alias("lead_comp"), *[F.col(c).alias(f"{c}_a") for c in ["n", *SKETCH]])
        other = known.select("sig", "doc", "comp", "leads", *[F.col(c).alias(f"{c}_b") for c in ["n", *SKETCH]])
        apart = (other["sig"] == lead["sig"]) & F.expr(f"comp <> lead_comp AND (NOT leads OR lead < doc) AND {_may_be_similar(percent)}")
        fresh = written(
            other.join(lead, apart).select(F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b")).distinct()
            .join(checked, ["a", "b"], "left_anti"),
            "pairs",
        )
        found = written(_linked(fresh, docs, words, percent), "links")
        if not found.isEmpty():
            links = written(links.unionByName(found), "links")
            components = connected_components(links, "a", "b")
        checked = checked.unionByName(fresh)
        open_rows = rows.where("NOT leads").select("sig", "doc")
        share *= 4
    return members.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "text_hash", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id")
    )


def _shared_signatures(single: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, doc, lead) for the signatures that several sets share; lead is the smallest of them.

    Common ones are left out; sets that have no spare partitions for all of theirs have
    their rarest features instead. Counts and leaders are written before they are joined:
    beside an aggregation in its own stage, a join can't have the rows of a hot signature
    split.
    """
    counts = written(_signature_rows(single, words, percent, owners=False).groupBy("sig").agg(F.count("*").alias("times")).where("times > 1"), "times")
    shared = written(_signature_rows(single, words, percent, owners=True).join(counts, "sig"), "shared")
    discard(counts)
    common = shared.where(F.col("times") > COMMON)
    short = written(common.groupBy("doc", "code").agg(F.count("*").alias("used")).where("used > floor(code / 2) - 1").select("doc").distinct(), "short")
    ids = short.select(F.col("doc").alias("doc_id"))
    rarest = _rarest_features(single.join(broadcast_if_small(ids, SMALL_IDS), "doc_id", "left_semi"), words, percent)
    held = written(shared.where(F.col("times") <= COMMON).select("sig", "doc").unionByName(rarest), "held")
    discard(shared)
    leads = written(held.groupBy("sig").agg(F.min("doc").alias("lead")), "leads")
    return held.join(leads, "sig")


def _rarest_features(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, doc): of each set of ``docs`` the rarest n - ceil(n percent / 100) + 1 of its n features, without those that no other set has.

    Similar sets share one of these in whatever order features come, if it is one for all
    sets. It goes by how many features have a cell of a table of ``CELLS`` cells in common,
    so that features don't have to be brought together: many in a cell hide only how rare
    they are.
    """

    def features(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for part in slices(batch, "text", SLICE, SLICE_ROWS):
            text, key = shingle_sets(texts_of(part, "text"), words)
            yield part, text, key, (mix(key) & np.uint64(CELLS - 1)).astype(np.int32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, cell in features(batch):
                held, times = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times, pa.int64())], names=["cell", "times"])

    found = docs.mapInArrow(cells, "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times")).where("times > 1").toArrow()  # at most CELLS rows
    sets = np.ones(CELLS, dtype=np.int32)
    sets[found["cell"].to_numpy()] = np.minimum(found["times"].to_numpy(), (1 << 31) - 1)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text, key, cell in features(batch):
                order = np.lexsort((key, sets[cell], text))
                text, key, cell = text[order], key[order], cell[order]
                n = np.bincount(text, minlength=part.num_rows)
                place = np.arange(len(text)) - starts_of(n)[:-1][text]
                # a feature alone in its cell is of one set and brings nobody together
                told = (place <= n[text] - (n[text] * percent + 99) // 100) & (sets[cell] > 1)
                yield pa.RecordBatch.from_arrays([_signed(mix(key[told] ^ RAREST)), part.column("doc_id").take(pa.array(text[told]))], names=["sig", "doc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rarest, f"sig long, doc {kind}")


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of ``words``-word
    shingles is ``percent`` / 100 or more; component_id is the smallest doc_id that
    links lead to. No link between different texts is lost; features are compared by
    64-bit hashes.

    A null text, or one without words, has an empty set and links with nothing: its
    component_id is its own doc_id. A row with a null id gets the component_id of the
    rows with an equal set, null if none of them has an id. Rows that repeat are equal
    sets; a doc_id with several texts is judged text by text. Other columns aren't
    read, texts are taken whole, an empty table gives an empty result.
    """
    return _members(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that with the smallest id.

    Rows without words, and groups without any id, stay as they are. Of rows that
    repeat one stays.
    """
    members = written(_members(docs, words, percent).where("component_id IS NOT NULL AND n > 0"), "kept")
    best = members.where("doc_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    keys = members.select("doc_id", "text_hash", "component_id").groupBy("doc_id", "text_hash").agg(
        F.first("component_id").alias("component_id"), F.count("*").alias("times")
    )
    fate = written(
        keys.join(best, "component_id").select(
            F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct("doc_id", "text_hash").eqNullSafe(F.col("best")).alias("_stays"), (F.col("times") > 1).alias("_again")
        ),
        "fate",
    )
    told = docs.withColumn("_text", F.xxhash64("text")).join(
        broadcast_if_small(fate, SMALL_IDS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left"
    ).where("coalesce(_stays, true)")
    once = told.where("coalesce(_again, false)").dropDuplicates(["doc_id", "_text"])
    return told.where("NOT coalesce(_again, false)").unionByName(once).select(*docs.columns)


def oracle_sql(words: int, percent: int) -> str:
    """DuckDB SQL for ``components`` over ``documents``."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle})) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
