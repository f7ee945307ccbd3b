"""A SentencePiece BPE model file as look-up tables, and texts cut into marked words.

Spaces become the mark U+2581, one is put before a text that isn't empty, and a marked
word is a run of marks with what follows it. No piece of a usual model holds a mark
after another character, nor a line feed, so no merge crosses such a cut; ``load``
checks this for the model at hand.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

MARK = "▁"


class PieceModel:
    """Pieces, merge ranks and byte pieces of a BPE model with identity normalisation."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        special = {i for i in ids if library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)}
        self.pieces = [library.id_to_piece(i) for i in ids]
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.unknown = library.unk_id()
        self.byte_ids = [-1] * 256
        for i in ids:
            if library.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.has_bytes = min(self.byte_ids) >= 0
        scores = {p: library.get_score(i) for p, i in self.id_of.items()}
        #: Equal scores get equal ranks; of those the leftmost pair merges first.
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank_of = {p: order[s] for p, s in scores.items()}
        self.longest = max(map(len, self.id_of), default=1)
        for p in self.id_of:
            if MARK in p.lstrip(MARK) or "\n" in p:
                raise ValueError(f"piece {p!r} crosses a cut between marked words")

    def ids_of_symbol(self, symbol: str) -> list[int]:
        """Ids that a final symbol is written as: its own, or its UTF-8 bytes, or unknown."""
        i = self.id_of.get(symbol)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in symbol.encode()] if self.has_bytes else [self.unknown]

    def merge(self, text: str) -> list[str]:
        """Symbols of a short text, by merging the best-ranked pair, leftmost first, one at a time."""
        symbols, rank = list(text), self.rank_of
        while len(symbols) > 1:
            best = min(((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))))
            if best[0] == 1 << 30:
                break
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return symbols

    def merge_long(self, text: str) -> list[str]:
        """As ``merge``, with a heap of pairs: n log n for a text of n characters."""
        symbols: list[str | None] = list(text)
        after, ahead = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (rank := self.rank_of.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = a + b, None, after[j]
            if after[j] < len(symbols):
                ahead[after[j]] = i
            if ahead[i] >= 0:
                offer(ahead[i])
            offer(i)
        return [s for s in symbols if s is not None]


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """The model at ``path``, read once in each process."""
    return PieceModel(path)


def marked_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each marked word, distinct marked words, words of each text), texts in order.

    A line feed is a word of its own. Concatenated, a text's words give the text with
    marks for spaces and one mark in front.
    """
    lone = "\x00"
    for lone in ("\x00", "\x01", "\x02", "", "", ""):
        if not pc.any(pc.match_substring(texts, lone)).as_py():
            break
    else:
        return _marked_words_slowly(texts)
    marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", MARK), pc.replace_substring(texts, " ", MARK), "")
    cut = pc.replace_substring_regex(pc.replace_substring(marked, "\n", f"{lone}\n{lone}"), f"({MARK}+)", f"{lone}\\1")
    lists = pc.split_pattern(cut, lone)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(full).dictionary_encode()
    counts = np.bincount(parent.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts))
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, counts


def _marked_words_slowly(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    import re

    cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
    lists = [cut.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts.to_pylist()]
    encoded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, np.array([len(x) for x in lists], dtype=np.int64)
