"""Removes repeated strings of 50 bytes, by merging Burrows-Wheeler transforms of shards.

The question for each window of 50 bytes is which document is the first that has it. Only
a small part of all windows can have a second one, so the work is narrowed down without
loss and then divided by content:

1. Each window has an *anchor*, the place of the least hash of 24 bytes inside it; equal
   windows have it at the same offset. Texts are dealt to parts; each part sends the hashes
   of its anchors to buckets, which answer with those that at least two texts have.
2. Around such an anchor lie the windows it is the anchor of, as one string of 50 to 76
   bytes. Each part sends its distinct strings to buckets by the anchor's hash, so that
   equal windows meet in one bucket. Where very many texts have an anchor, its windows are
   sent one by one by their own hash, so that no hash makes a bucket large.
3. A bucket puts its distinct strings in the order of their first documents and cuts them
   into shards. For each shard the Burrows-Wheeler transform is built, with the step from a
   suffix to the one a byte longer. Then all shards are merged: the suffixes that end a
   window start as one block, interleaved by shard, and each round moves all of them two
   bytes to the left and splits every block by the symbols met there, which is a stable
   distribution by symbol and no comparison of suffixes. After h bytes a block is an
   interval of suffixes with a common prefix of h. Blocks of a single document can't
   become repeats and are left out of further rounds. What is left after 50 bytes are
   the repeated intervals, each with its first document.
4. Parts get back which stretches of their texts are repeats, and cut them out.

Texts with an exact copy of a smaller id need none of this: all their windows are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.llm.arrow_text import ragged, starts_of
from rollkin.llm.lm_scores import pack, unpack
from rollkin.sources.scratch import broadcast_if_small, written

WINDOW = 50
ANCHOR = 24
#: Places in a window at which its anchor can be.
SPAN = WINDOW - ANCHOR + 1
#: Bytes of a string around an anchor, padded to whole 64-bit words, with one for its length.
WIDTH = 80
#: Bits of an anchor's hash that are sent.
KEY_BITS = 46
#: Texts with the same anchor from which on its windows are sent one by one.
HOT = 4096
#: Window starts worked on at once; keys hold the place in their 24 low bits.
CHUNK = 1 << 16
#: Bytes of a shard whose transform is built at once.
SHARD = 1 << 19
#: Bytes of text of a part and anchors of a bucket, least and most, and bytes of all texts per bucket of strings.
PART_BYTES, PART_MOST, BUCKET_KEYS, BUCKET_MOST, BUCKET_BYTES = 4 << 20, 12 << 20, 1 << 18, 1 << 21, 6 << 20
#: Groups of a bucket's strings that are merged one after the other.
TURNS = 8
#: Texts with copies up to which they are broadcast.
SMALL_COPIES = 500_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    h ^= h >> np.uint64(29)
    h *= ODD[5]
    h ^= h >> np.uint64(32)
    return h


def _words(padded: np.ndarray, first: int, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` places on, as a little-endian number."""
    return np.ndarray((n,), np.dtype("<u8"), padded, offset=first, strides=(1,))


class Runs(NamedTuple):
    """Runs of windows with one anchor: first and last window start, and the anchor's hash."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray


def anchored_runs(padded: np.ndarray, ends: np.ndarray) -> Runs:
    """The runs of all windows of the texts that end at ``ends`` and lie one after the other in ``padded``, 64 bytes of padding last."""
    n, found = int(ends[-1]) if len(ends) else 0, []
    begins = np.r_[0, ends[:-1]]
    for low in range(0, n - WINDOW + 1, CHUNK):
        high = min(low + CHUNK, n - WINDOW + 1)
        m = high - low + SPAN - 1
        h = _words(padded, low, m) * ODD[0]
        h += _words(padded, low + 8, m) * ODD[1]
        h += _words(padded, low + 16, m) * ODD[2]
        h = _mixed(h)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        for step in (1, 2, 4, 8, SPAN - 16):
            key = np.minimum(key[:-step], key[step:])
        at = (key & np.uint64(0xFFFFFF)).astype(np.int32)
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(begins, high, side="left")
        outside = np.zeros(high - low + 1, dtype=np.int32)
        np.add.at(outside, np.clip(np.maximum(begins[a:b], ends[a:b] - WINDOW + 1) - low, 0, high - low), 1)
        np.add.at(outside, np.clip(ends[a:b] - low, 0, high - low), -1)
        inside = np.flatnonzero(np.cumsum(outside[:-1]) == 0)
        if not len(inside):
            continue
        mine = at[inside]
        new = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (np.diff(inside) != 1)])
        found.append((inside[new] + low, inside[np.r_[new[1:] - 1, len(inside) - 1]] + low, h[mine[new]] >> np.uint64(64 - KEY_BITS)))
    if not found:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def _part(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's texts in the order of id and text: ids, the texts one after the other with padding, where each ends."""
    rows = rows.select(["doc_id", "text"]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = rows["doc_id"].to_numpy().astype(np.int64)
    ends = np.cumsum(pc.binary_length(rows["text"]).to_numpy(), dtype=np.int64)
    return ids, np.frombuffer(b"".join(rows["text"].to_pylist()) + bytes(64), dtype=np.uint8), ends


def _bucket_of(key: np.ndarray, bits: int, n: int) -> np.ndarray:
    return ((key >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of the sorted ``bucket``."""
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(bucket) else np.zeros(0, np.int64)
    for low, high in zip(np.r_[0, ends[:-1]], ends):
        yield int(bucket[low]), slice(int(low), int(high))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def anchor_messages(n_buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        _, data, ends = _part(rows)
        runs = anchored_runs(data, ends)
        text = np.searchsorted(ends, runs.first, side="right")
        order = np.lexsort((text, runs.key))
        key, text = runs.key[order], text[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)]
        key, count = np.unique(key[once], return_counts=True)
        out = [(b, part, pack(np.diff(key[x], prepend=np.uint64(0))), pack(count[x])) for b, x in _cuts(_bucket_of(key, KEY_BITS, n_buckets))]
        return _table(out, ANCHORS)

    return send


ANCHORS = "bucket long, part long, keys binary, counts binary"
SHARED = "part long, bucket long, keys binary, hot binary"


def shared_anchors(rows: pa.Table) -> pa.Table:
    """For each message the anchors among its own that two texts have, and whether very many have them."""
    sent = [np.cumsum(unpack(k), dtype=np.uint64) for k in rows["keys"].to_pylist()]
    key, at = np.unique(np.concatenate(sent), return_inverse=True)
    texts = np.bincount(at, weights=np.concatenate([unpack(c) for c in rows["counts"].to_pylist()]).astype(np.float64), minlength=len(key))
    shared, out, low = texts[at] > 1, [], 0
    for part, bucket, own in zip(rows["part"].to_pylist(), rows["bucket"].to_pylist(), sent):
        x = slice(low, low := low + len(own))
        if shared[x].any():
            out.append((part, bucket, pack(np.diff(own[shared[x]], prepend=np.uint64(0))), pack(texts[at[x]][shared[x]] > HOT)))
    return _table(out, SHARED)


def _strings(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings of up to 76 bytes as rows of ``WIDTH`` bytes; the last byte is the length."""
    out = np.zeros((len(first), WIDTH), dtype=np.uint8)
    for low in range(0, len(first), 1 << 14):
        x = slice(low, low + (1 << 14))
        places = first[x, None] + np.arange(WIDTH - 1)
        rows = data[np.minimum(places, len(data) - 1)]
        rows[np.arange(WIDTH - 1) >= size[x, None]] = 0
        out[x, :-1] = rows
    out[:, -1] = size
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows, and for every row which of them it equals. Hashes group the rows; the bytes decide."""
    words = rows.view(np.uint64)
    h = np.zeros(len(rows), dtype=np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * ODD[3] + words[:, i] * ODD[i]
    _, place, of = np.unique(_mixed(h), return_index=True, return_inverse=True)
    if not (words == words[place[of]]).all():
        _, place, of = np.unique(rows.view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
    return place, of


STRINGS = "bucket long, part long, texts binary, sizes binary, turns binary, counts binary, docs binary, rows binary, places binary"


def string_messages(n_buckets: int):
    def send(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies) or not len(rows):
            return _table([], STRINGS)
        part = rows["part"][0].as_py()
        ids, data, ends = _part(rows)
        replies = replies.sort_by("bucket")
        shared = np.concatenate([np.cumsum(unpack(k), dtype=np.uint64) for k in replies["keys"].to_pylist()])
        hot = np.concatenate([unpack(k) for k in replies["hot"].to_pylist()]) > 0
        runs = anchored_runs(data, ends)
        at = np.searchsorted(shared, runs.key)
        mine = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == runs.key)
        single = hot[at[mine]]
        whole, split = mine[~single], mine[single]
        counts = runs.last[split] - runs.first[split] + 1
        windows = ragged(runs.first[split], counts)
        first = np.r_[runs.first[whole], windows]
        size = np.r_[runs.last[whole] - runs.first[whole] + WINDOW, np.full(len(windows), WINDOW)]
        key = np.r_[runs.key[whole], np.zeros(len(windows), dtype=np.uint64)]
        strings = _strings(data, first, size)
        if len(windows):
            words, h = strings[len(whole) :].view(np.uint64), np.zeros(len(windows), dtype=np.uint64)
            for i in range(words.shape[1]):
                h = (h ^ (h >> np.uint64(31))) * ODD[3] + words[:, i] * ODD[i]
            key[len(whole) :] = _mixed(h) >> np.uint64(64 - KEY_BITS)
        place, of = _distinct(strings)
        bucket = _bucket_of(key[place], KEY_BITS, n_buckets)
        turn = key[place] % np.uint64(TURNS)
        order = np.lexsort((turn, bucket))
        place, bucket, turn = place[order], bucket[order], turn[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        of = rank[of]
        text = np.searchsorted(ends, first, side="right")
        begins = np.r_[0, ends[:-1]]
        by = np.lexsort((text, of))
        counts = np.bincount(of, minlength=len(place))
        upto = starts_of(counts)
        out = []
        for b, x in _cuts(bucket):
            own, there = strings[place[x]], by[upto[x.start] : upto[x.stop]]
            flat = own[:, :-1][np.arange(WIDTH - 1) < own[:, -1:]]
            out.append((b, part, zstandard.compress(flat.tobytes(), 1), pack(own[:, -1]), pack(turn[x]), pack(counts[x]), ids[text[there]].tobytes(), pack(text[there]), pack(first[there] - begins[text[there]])))
        return _table(out, STRINGS)

    return send


def suffix_array(padded: np.ndarray, n: int, depth: int = 64) -> np.ndarray:
    """The first ``n`` places in the order of the bytes from there on, told apart by ``depth`` of them at least."""
    key, step = np.ndarray((n,), np.dtype(">u8"), padded, strides=(1,)).astype(np.uint64), 8
    while True:
        order = np.argsort(key)
        new = np.r_[True, key[order[1:]] != key[order[:-1]]]
        if step >= depth or new.all():
            return order
        rank = np.empty(n + step, dtype=np.uint64)
        rank[order], rank[n:] = np.cumsum(new), 0
        key, step = rank[:n] << np.uint64(32) | rank[step:], 2 * step


class Transform(NamedTuple):
    """The transform of a shard: for each suffix in sorted order the two bytes before it (the first one high) and the row of the suffix two bytes longer; ``row_of`` gives the row of a place."""

    before: np.ndarray
    longer: np.ndarray
    row_of: np.ndarray


def transform(text: np.ndarray) -> Transform:
    n = len(text)
    order = suffix_array(np.r_[text, np.zeros(8, np.uint8)], n)
    row_of = np.empty(n, dtype=np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    previous = (order - 1) % n
    bwt, longer = text[previous].astype(np.uint16), row_of[previous]
    return Transform(bwt[longer] << np.uint16(8) | bwt, longer[longer], row_of)


def merged_intervals(texts: list[np.ndarray], ends: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges the transforms of shards. ``ends``: for each shard the places after the windows' last bytes; ``docs``: the document of each.

    Gives, as two arrays, the numbers of windows (counted through all shards) in intervals
    that more than one document has, and the first document of their interval.
    """
    shards = [transform(t) for t in texts]
    base = starts_of(np.array([len(t) for t in texts]))
    before = np.concatenate([s.before for s in shards])
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base)]).astype(np.int32)
    row = np.concatenate([s.row_of[e % len(t)] + b for s, t, e, b in zip(shards, texts, ends, base)]).astype(np.int32)
    doc, window = np.concatenate(docs), np.arange(len(row), dtype=np.int32)
    order = np.argsort(row)  # the first interleave: by shard, and in a shard as it is sorted
    row, doc, window = row[order], doc[order], window[order]
    block = np.zeros(len(row), dtype=np.int32)
    for _ in range(WINDOW // 2):
        symbol = before[row]
        if not len(row):
            return
        order = np.argsort(symbol, kind="stable")
        symbol, block, doc, window, row = symbol[order], block[order], doc[order], window[order], longer[row[order]]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])][: len(row)]
        starts = np.flatnonzero(new)
        block = np.cumsum(new, dtype=np.int32) - 1
        least = np.minimum.reduceat(doc, starts)
        live = (least != np.maximum.reduceat(doc, starts))[block]
        if not live.all():
            block, doc, window, row = block[live], doc[live], window[live], row[live]
    if len(row):
        yield window, least[block]


RANGES = "part long, rows binary, lows binary, highs binary"


def repeated_ranges(rows: pa.Table) -> pa.Table:
    """For each part the stretches of its texts that documents of a smaller id have too."""
    sent = rows.to_pylist()
    sizes = np.concatenate([unpack(r["sizes"]).astype(np.int64) for r in sent])
    turns = np.concatenate([unpack(r["turns"]).astype(np.int64) for r in sent])
    counts = np.concatenate([unpack(r["counts"]).astype(np.int64) for r in sent])
    docs = np.frombuffer(b"".join(r["docs"] for r in sent), dtype=np.int64)
    text = np.concatenate([unpack(r["rows"]).astype(np.int64) for r in sent])
    place = np.concatenate([unpack(r["places"]).astype(np.int64) for r in sent])
    of_part = np.repeat([r["part"] for r in sent], [int(unpack(r["counts"]).sum()) for r in sent])
    flat = np.frombuffer(b"".join(zstandard.decompress(r["texts"]) for r in sent) + bytes(WIDTH), dtype=np.uint8)
    begins, upto = starts_of(sizes), starts_of(counts)
    found = []
    for turn in range(TURNS):
        mine = np.flatnonzero(turns == turn)
        if not len(mine):
            continue
        place_of, of = _distinct(strings := _strings(flat, begins[mine], sizes[mine]))
        seen = np.repeat(of, counts[mine])  # which distinct string an occurrence has
        where = ragged(upto[mine], counts[mine])
        first = np.full(len(place_of), np.iinfo(np.int64).max)
        np.minimum.at(first, seen, docs[where])
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        seen, first, strings = rank[seen], first[order], strings[place_of[order]]
        least, n_windows = _first_documents(strings, first)
        at = starts_of(n_windows)
        found += _stretches(seen, where, docs, least, at)
    if not found:
        return _table([], RANGES)
    occurrence, low, high = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(of_part[occurrence], kind="stable")
    occurrence, low, high = occurrence[order], low[order], high[order]
    out = [(p, pack(text[occurrence[x]]), pack(place[occurrence[x]] + low[x]), pack(place[occurrence[x]] + high[x])) for p, x in _cuts(of_part[occurrence])]
    return _table(out, RANGES)


def _first_documents(strings: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each window of ``strings``, which are in the order of their first documents, and the windows of each string."""
    sizes = strings[:, -1].astype(np.int64)
    n_windows = sizes - WINDOW + 1
    ids, doc = np.unique(first, return_inverse=True)
    shard = np.cumsum(sizes) // SHARD
    texts, ends, docs = [], [], []
    for _, x in _cuts(shard):
        own, n = strings[x], n_windows[x]
        texts.append(own[:, :-1][np.arange(WIDTH - 1) < own[:, -1:]])
        ends.append(ragged(starts_of(sizes[x])[:-1] + WINDOW, n))
        docs.append(np.repeat(doc[x], n).astype(np.int32))
    least = np.repeat(first, n_windows)
    for window, earliest in merged_intervals(texts, ends, docs):
        least[window] = ids[earliest]
    return least, n_windows


def _stretches(seen: np.ndarray, where: np.ndarray, docs: np.ndarray, least: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(occurrence, from, to): bytes of an occurrence's string that are in windows of an earlier document. ``at``: where a string's windows begin in ``least``."""
    for low in range(0, len(seen), 1 << 16):
        string, occurrence = seen[low : low + (1 << 16)], where[low : low + (1 << 16)]
        n = at[string + 1] - at[string]
        one = np.repeat(np.arange(len(string)), n)
        offset = ragged(np.zeros(len(n), dtype=np.int64), n)
        repeat = least[np.repeat(at[string], n) + offset] < docs[occurrence][one]
        hit = np.flatnonzero(repeat)
        if not len(hit):
            continue
        new = np.r_[True, (np.diff(hit) != 1) | (one[hit[1:]] != one[hit[:-1]])]
        start, stop = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
        yield occurrence[one[start]], offset[start], offset[stop] + WINDOW


def cut_texts(id_type: pa.DataType):
    def work(rows: pa.Table, ranges: pa.Table) -> pa.Table:
        ids, data, ends = _part(rows)
        begins, sent = np.r_[0, ends[:-1]], ranges.to_pylist()
        text, low, high = (np.concatenate([np.zeros(0, np.int64), *(unpack(r[c]).astype(np.int64) for r in sent)]) for c in ("rows", "lows", "highs"))
        order = np.lexsort((low, text))
        low, high = (x[order] + begins[text[order]] for x in (low, high))
        # In one line of all texts; stretches of different texts don't overlap, but may touch.
        text = text[order]
        reach = np.maximum.accumulate(high) if len(high) else high
        new = np.r_[True, (low[1:] > reach[:-1]) | (text[1:] != text[:-1])][: len(low)]
        start, stop = low[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(low) - 1]] if len(low) else low
        owner = text[new]
        removed = np.bincount(owner, weights=stop - start, minlength=len(ids)).astype(np.int64)
        spans = np.bincount(owner, minlength=len(ids))
        upto = starts_of(spans)
        digests = []
        for i in range(len(ids)):
            digest, at = hashlib.sha256(), begins[i]
            for j in range(upto[i], upto[i + 1]):
                digest.update(data[at : start[j]])
                at = stop[j]
            digest.update(data[at : ends[i]])
            digests.append(digest.hexdigest())
        return pa.table(
            [pa.array(ids).cast(id_type), pa.array(ends - begins), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return work


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id integer, text): n_bytes, n_removed, n_spans and kept_sha256 of its UTF-8 text.

    Bytes go that lie in a string of 50 bytes which also starts in a row of a smaller id.
    A null text is the empty text; shorter texts than 50 bytes lose nothing. A row with a
    null id neither loses bytes nor takes any from others. Rows that share an id don't
    count as earlier to each other, so repeated rows get equal results. Texts are taken
    whole; other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = docs.schema["doc_id"].dataType
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    groups = written(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("n_bytes")), "groups")
    copied = written(groups.where("copies > 1 AND first_id IS NOT NULL").select("k1", "k2", "first_id"), "copied")
    total = groups.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # Larger parts and buckets for larger inputs, so that messages don't get small as their number grows.
    n_parts = 1 + total // min(PART_MOST, max(PART_BYTES, total // 1024))
    keys = 2 * total // (SPAN + 1)
    n_keys, n_strings = 1 + keys // min(BUCKET_MOST, max(BUCKET_KEYS, keys // 1024)), 1 + total // BUCKET_BYTES
    marked = keyed.join(broadcast_if_small(copied, SMALL_COPIES), ["k1", "k2"], "left")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    plain = F.octet_length("text").cast("long")
    all_gone = later & (plain >= WINDOW)
    alone = marked.where(later | F.col("doc_id").isNull() | (plain < WINDOW)).select(
        "doc_id", plain.alias("n_bytes"), F.when(all_gone, plain).otherwise(0).cast("long").alias("n_removed"), F.when(all_gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(all_gone, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
    )
    # The three uses below share one exchange of the texts.
    texts = marked.where(~later & F.col("doc_id").isNotNull() & (plain >= WINDOW)).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    by_part = lambda df: df.groupBy("part")
    shared = by_part(texts).applyInArrow(anchor_messages(n_keys), ANCHORS).groupBy("bucket").applyInArrow(shared_anchors, SHARED)
    strings = by_part(texts).cogroup(by_part(shared)).applyInArrow(string_messages(n_strings), STRINGS)
    ranges = strings.groupBy("bucket").applyInArrow(repeated_ranges, RANGES)
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind.simpleString()]
    cut = by_part(texts).cogroup(by_part(ranges)).applyInArrow(cut_texts(arrow), f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.unionByName(alone)
