"""Token counts by rank-synchronous array merging.

The distinct words of a batch are held as one ragged array of symbol numbers. In each
round all words merge at once, every one the pair that has the lowest rank in it, and
words without a pair that merges leave with their number of symbols. Only symbol
counts are wanted, so no token list is ever built.

Words are cut first wherever no piece holds the two characters side by side, since no
merge crosses such a place. What is still long after that would need very many rounds
over all its symbols; there a round takes the lowest rank of all and looks only at the
places that have it, through links to the neighbours instead of closing gaps. Where a
merge could make a pair that goes before others of its rank, that rank's merges are done
one by one from a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rollkin.llm.arrow_text import slices, starts_of, texts_of
from rollkin.llm.piece_model import load, marked_words

NO_PAIR = np.int64(1 << 40)
#: Symbols from which on a piece of a word is merged through links.
LONG = 256


class MergeTables:
    """Symbols as numbers and a hash table from symbol pairs to (rank, merged symbol).

    A symbol is a piece of the model or, above them, a character that no piece equals.
    """

    def __init__(self, path: str):
        model = load(path)
        self.model = model
        self.known: dict[tuple[int, int], int] = {}
        self.symbols = list(model.id_of)
        self.number = {p: i for i, p in enumerate(self.symbols)}
        self.n = len(self.symbols)
        self.rank = np.array([model.rank_of[p] for p in self.symbols], dtype=np.int64)
        left, right, out = [], [], []
        for p, m in self.number.items():
            for cut in range(1, len(p)):
                a, b = self.number.get(p[:cut]), self.number.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(m)
        left, right, out = (np.array(x, dtype=np.int64) for x in (left, right, out))
        #: Merging all equal pairs of a word at once gives what one at a time gives,
        #: unless a pair with the merged symbol ranks as well as the merge itself.
        self.safe = np.ones(self.n, dtype=bool)
        self.safe[left[self.rank[out] <= self.rank[left]]] = False
        self.safe[right[self.rank[out] <= self.rank[right]]] = False
        #: Pairs of characters that stand side by side in a piece.
        self.inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.symbols for a, b in zip(p, p[1:])], dtype=np.int64))
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(out)) * 4))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        key = left * self.n + right
        slot = self._slot(key)
        waiting = np.arange(len(key))
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = waiting[self.keys[slot[waiting]] == -1]
            self.keys[slot[free]] = key[free]  # of several in a slot the last stays
            settled = self.keys[slot[waiting]] == key[waiting]
            done = waiting[settled]
            self.merged[slot[done]] = out[done]
            waiting = waiting[~settled]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, left: int, right: int) -> int:
        """``merges_to`` of one pair, remembered."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > 1 << 20:
                self.known.clear()
            found = self.known[left, right] = int(self.merges_to(np.array([left]), np.array([right]))[0])
        return found

    def merges_to(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, -1 for none."""
        out = np.full(len(left), -1, dtype=np.int64)
        todo = np.flatnonzero((left < self.n) & (right < self.n))
        key = left[todo] * self.n + right[todo]
        slot = self._slot(key)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.merged[slot[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=4)
def tables(path: str) -> MergeTables:
    return MergeTables(path)


def count_symbols(words: pa.Array, t: MergeTables) -> np.ndarray:
    """Tokens of each word. ``words``: distinct marked words, none of them empty."""
    counts = np.zeros(len(words), dtype=np.int64)
    if not len(words):
        return counts
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    distinct, at = np.unique(points, return_inverse=True)
    number = np.array([t.number.get(chr(c), t.n + i) for i, c in enumerate(distinct)], dtype=np.int64)
    cost = np.ones(t.n + len(distinct), dtype=np.int64)
    if t.model.has_bytes:
        for i, c in enumerate(distinct):
            cost[t.n + i] = len(chr(c).encode())
    symbols = number[at]
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.repeat(np.arange(len(words)), lengths)
    cut = np.r_[True, whole[1:] != whole[:-1]]
    neighbours, where = np.unique(points[:-1].astype(np.int64) << 21 | points[1:], return_inverse=True)
    cut[1:] |= ~np.isin(neighbours, t.inside)[where]
    first = np.flatnonzero(cut)
    owner, sizes = whole[first], np.diff(np.r_[first, len(symbols)])
    for i in np.flatnonzero(sizes > LONG):
        counts[owner[i]] += cost[merged_long(symbols[first[i] : first[i] + sizes[i]], t)].sum()
    short = sizes <= LONG
    symbols, word = symbols[np.repeat(short, sizes)], np.repeat(np.arange(short.sum()), sizes[short])
    per_part = _count_short(symbols, word, int(short.sum()), cost, t)
    return counts + np.bincount(owner[short], weights=per_part, minlength=len(words)).astype(np.int64)


def _count_short(symbols: np.ndarray, word: np.ndarray, n: int, cost: np.ndarray, t: MergeTables) -> np.ndarray:
    """Tokens of each of ``n`` runs of symbols; ``word`` says which run a symbol is of."""
    counts = np.zeros(n, dtype=np.int64)
    if not n:
        return counts
    pair = np.full(len(symbols), -1, dtype=np.int64)  # what a symbol and the next of its word merge to
    inner = np.flatnonzero(word[:-1] == word[1:])
    pair[inner] = t.merges_to(symbols[inner], symbols[inner + 1])
    while len(symbols):
        rank = np.where(pair >= 0, t.rank[pair], NO_PAIR)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        over = np.repeat(lowest == NO_PAIR, sizes)
        if over.any():  # words that are done leave
            np.add.at(counts, word[over], cost[symbols[over]])
            keep = ~over
            symbols, word, pair, rank = symbols[keep], word[keep], pair[keep], rank[keep]
            if not len(symbols):
                break
            live = lowest != NO_PAIR
            lowest, sizes = lowest[live], sizes[live]
            starts = starts_of(sizes)[:-1]
        hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        owner = np.cumsum(first) - 1
        target = pair[hits[first]][owner]
        # The leftmost pair of each word, and with it all equal ones where that is safe.
        chosen = first | ((pair[hits] == target) & t.safe[target])
        same_left = symbols[hits] == symbols[hits[first]][owner]
        hits = hits[chosen & same_left]
        if len(hits) > 1:  # in a run of one symbol every second pair merges
            run = np.r_[True, np.diff(hits) != 1]
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[place % 2 == 0]
        symbols[hits] = pair[hits]
        gone = np.zeros(len(symbols), dtype=bool)
        gone[hits + 1] = True
        new_at = np.cumsum(~gone) - 1
        touched = new_at[hits]
        symbols, word, pair = symbols[~gone], word[~gone], pair[~gone]
        mark = np.zeros(len(symbols), dtype=bool)
        mark[touched] = True
        mark[touched[touched > 0] - 1] = True
        pair[mark] = -1
        mark[:-1] &= word[1:] == word[:-1]
        mark[-1] = False
        stale = np.flatnonzero(mark)
        pair[stale] = t.merges_to(symbols[stale], symbols[stale + 1])
    return counts


def merged_long(symbols: np.ndarray, t: MergeTables) -> np.ndarray:
    """What is left of one long run of symbols when all merges are done."""
    symbols, n = symbols.copy(), len(symbols)
    after, ahead = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive, pair = np.ones(n, dtype=bool), np.full(n, -1, dtype=np.int64)
    places: dict[int, list[np.ndarray]] = {}  # by rank, where a pair of that rank was seen
    ranks: list[int] = []

    def offer(at: np.ndarray) -> None:
        at = at[pair[at] >= 0]
        rank = t.rank[pair[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        ends = np.flatnonzero(np.r_[rank[1:] != rank[:-1], True]) + 1 if len(at) else ()
        low = 0
        for high in ends:
            r = int(rank[low])
            if r not in places:
                heapq.heappush(ranks, r)
            places.setdefault(r, []).append(at[low:high])
            low = high

    def one_by_one(r: int, at: np.ndarray) -> None:
        """Merges of rank ``r`` at ``at`` (ascending), and all of this or a lower rank that arise, the lowest and leftmost first."""
        waiting, later = [(r, p) for p in at.tolist()], set()
        while waiting:
            rank, p = heapq.heappop(waiting)
            merged = int(pair[p])
            if merged < 0 or not alive[p] or t.rank[merged] != rank:
                continue
            gone = int(after[p])
            symbols[p], alive[gone], after[p] = merged, False, after[gone]
            if after[p] < n:
                ahead[after[p]] = p
            for q in (int(ahead[p]), p):
                if q < 0:
                    continue
                right = int(after[q])
                pair[q] = new = t.merge_of(int(symbols[q]), int(symbols[right])) if right < n else -1
                if new >= 0 and t.rank[new] <= r:
                    heapq.heappush(waiting, (int(t.rank[new]), q))
                else:
                    later.add(q)
        offer(np.array(sorted(later), dtype=np.int64))

    pair[:-1] = t.merges_to(symbols[:-1], symbols[1:])
    offer(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at] & (pair[at] >= 0)]
        at = at[t.rank[pair[at]] == r]
        if not len(at):
            continue
        if not t.safe[pair[at]].all():
            one_by_one(r, at)
            continue
        # leftmost first: in a run of neighbours every second place
        run = np.r_[True, after[at[:-1]] != at[1:]]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        hits = at[place % 2 == 0]
        gone = after[hits]
        symbols[hits], alive[gone], after[hits] = pair[hits], False, after[gone]
        linked = hits[after[hits] < n]
        ahead[after[linked]] = linked
        before = ahead[hits]
        stale = np.unique(np.concatenate([hits, before[before >= 0]]))
        pair[stale] = -1
        inner = stale[after[stale] < n]
        pair[inner] = t.merges_to(symbols[inner], symbols[after[inner]])
        offer(np.union1d(stale, at))
    return symbols[alive]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens and whether n_tokens > ``limit``.

    Counts equal those of the library for the model at ``model_path`` (SentencePiece
    BPE), without begin and end tokens; special strings in a text are ordinary text.
    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows
    each give a row; other columns aren't read; texts are taken whole whatever their
    length; an empty table gives an empty result.
    """
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                codes, words, n_words = marked_words(texts)
                per_word = count_symbols(words, t)[codes]
                text = np.repeat(np.arange(len(texts)), n_words)
                total = np.bincount(text, weights=per_word, minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.array(total > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
