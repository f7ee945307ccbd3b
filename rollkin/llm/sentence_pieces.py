"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch are sorted, which is the depth-first order of
their trie, and walked with a stack of forward states, one for each character of the
current path. A word keeps the states of the prefix that it shares with the one before
and computes only the rest; reading the best path backwards gives its pieces.

A forward state says how the best segmentation of the prefix ends. For a unigram model
it is the usual one: the highest sum of scores over all last pieces. For a BPE model
the score of a path is 0 if every two neighbours are a pair that the merges leave
apart and minus infinity otherwise; exactly one path has score 0, and it is the
sequence that merging gives. Only words with a run of marks, in which equal ranks make
merging depend on position, are merged in the plain way.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.llm.arrow_text import ragged, slices, starts_of, texts_of
from rollkin.llm.piece_model import MARK, PieceModel, load, marked_words

#: Characters up to which a word's ids are remembered for later batches.
REMEMBERED_LENGTH = 200
REMEMBERED = 1 << 20
WORDS = 500_000


class ForwardTrie:
    """Segments words with one model, and remembers which neighbouring pieces stay apart."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.ids: dict[str, bytes] = {}  # of words met so far, up to WORDS of them
        ending: dict[str, set[int]] = {}
        for p in model.id_of:
            if len(p) > 1:
                ending.setdefault(p[-2:], set()).add(len(p))
        #: By last two characters: lengths of the pieces that end so, longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in ending.items()}

    def _stays_whole(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.model.merge(piece)) == 1
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[left, right] = self._stays_whole(right) and self.model.merge(left + right) == [left, right]
        return known

    def segment(self, words: list[str]) -> Iterator[list[str]]:
        """Symbols of each of ``words``, which must be sorted."""
        ends: list[str] = [""]  # ends[i]: last symbol of the best path over the first i characters
        before = ""
        known, lengths = self.model.id_of, self.lengths
        apart, stay_apart, whole = self.apart, self._stay_apart, self._stays_whole
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del ends[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                    if n > i:
                        continue
                    piece = word[i - n : i]
                    if piece in known:
                        last = ends[i - n]
                        fits = apart.get((last, piece))
                        if fits is None:
                            fits = stay_apart(last, piece) if last else whole(piece)
                        if fits:
                            ends.append(piece)
                            break
                else:
                    ends.append(word[i - 1])  # no longer piece ends here
            before = word
            path, i = [], len(word)
            while i:
                path.append(ends[i])
                i -= len(ends[i])
            path.reverse()
            yield path


@lru_cache(maxsize=4)
def trie(path: str) -> ForwardTrie:
    return ForwardTrie(load(path))


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Piece ids of each distinct marked word, as the bytes of 32-bit integers."""
    model, forward = load(path), trie(path)
    known, id_of = forward.ids, model.id_of
    new = sorted(w for w in words if w not in known)
    ids: dict[str, bytes] = {}
    plain = [w for w in new if MARK + MARK not in w]
    for w, symbols in zip(plain, forward.segment(plain)):
        try:
            ids[w] = array("i", [id_of[s] for s in symbols]).tobytes()
        except KeyError:
            ids[w] = array("i", [i for s in symbols for i in model.ids_of_symbol(s)]).tobytes()
    for w in new:
        if w not in ids:
            ids[w] = array("i", [i for s in model.merge_long(w) for i in model.ids_of_symbol(s)]).tobytes()
    out = [known.get(w) or ids[w] for w in words]
    if len(known) < WORDS:
        known.update((w, i) for w, i in ids.items() if len(w) <= REMEMBERED_LENGTH)
    return out


def encode_texts(texts: pa.Array, path: str) -> pa.ListArray:
    """Piece ids of each text."""
    codes, words, n_words = marked_words(texts)
    ids = word_ids(words.to_pylist(), path)
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), dtype=np.int32)
    starts = starts_of(lengths)[:-1]
    pieces = flat[ragged(starts[codes], lengths[codes])]
    text = np.repeat(np.arange(len(texts)), n_words)
    per_text = np.bincount(text, weights=lengths[codes], minlength=len(texts)).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(starts_of(per_text), pa.int32()), pa.array(pieces, pa.int32()))


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces in a row, start, length); marks are spaces, control pieces are empty."""
    model = load(path)
    raw = []
    for i, p in enumerate(model.pieces):
        if model.id_of.get(p) == i:
            raw.append(p.replace(MARK, " ").encode())
        elif i in model.byte_ids:
            raw.append(bytes([model.byte_ids.index(i)]))
        elif i == model.unknown:
            raw.append(" ⁇ ".encode())
        else:
            raw.append(b"")
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), starts_of(lengths)[:-1], lengths


def decode_lists(pieces: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of piece ids; invalid byte sequences become U+FFFD. Null gives null."""
    data, start, length = piece_bytes(path)
    filled = pc.fill_null(pieces, pa.scalar([], pieces.type))
    per_text = pc.list_value_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = filled.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(int(length[ids].sum()), dtype=np.uint8)
    at = starts_of(length[ids])
    for low in range(0, len(ids), 1 << 20):  # index arrays of bounded size
        run = ids[low : low + (1 << 20)]
        out[at[low] : at[low + len(run)]] = data[ragged(start[run], length[run])]
    ends = at[starts_of(per_text)]
    whole = out.tobytes()
    texts: list[str | None] = []
    for low, high, there in zip(ends[:-1].tolist(), ends[1:].tolist(), pieces.is_valid().to_pylist()):
        if whole[low : low + 1] == b" ":
            low += 1  # the mark that was put in front
        texts.append(whole[low:high].decode("utf-8", errors="replace") if there else None)
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with an ``array<int>`` column of the piece ids of the text.

    Ids equal the library's for the model. All columns stay; one that is named as
    ``out_col`` already is replaced. A null text gives null, an empty one an empty
    list. Texts are taken whole; equal rows give equal rows; no rows give no rows.
    """
    if out_col in docs.columns:
        docs = docs.drop(out_col)
    schema = _with(docs, out_col, "array<int>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                ids = encode_texts(texts_of(part, text_col), model_path)
                ids = pc.if_else(part.column(text_col).is_valid(), ids, pa.scalar(None, ids.type))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out_col])

    return docs.mapInArrow(work, schema)


def decode(docs: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; the inverse of ``encode``.

    A text that holds U+2581 itself comes back with spaces there: the model has one
    symbol for both. Null ids give null, an empty list the empty text. All columns
    stay; one that is named as ``out_col`` already is replaced.
    """
    if out_col in docs.columns:
        docs = docs.drop(out_col)
    schema = _with(docs, out_col, "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                text = decode_lists(part.column(ids_col), model_path)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, out_col])

    return docs.mapInArrow(work, schema)


def _with(docs: DataFrame, column: str, kind: str):
    return docs.limit(0).withColumn(column, F.lit(None).cast(kind)).schema


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, piece_ids, n_pieces, whether decoding gives the text back, and the decoded text's CRC-32.

    ``encode`` and ``decode`` in one pass, so that the text crosses to Python once and
    only ids and digests come back. Null text: null ids, 0 pieces, ``restored`` true
    (null came back), null CRC. Other cases as there.
    """
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                ids = encode_texts(texts_of(part, "text"), model_path)
                back = decode_lists(ids, model_path)
                crc = [zlib.crc32(t.as_buffer()) if there else None for t, there in zip(back, text.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pc.if_else(text.is_valid(), ids, pa.scalar(None, ids.type)), pc.list_value_length(ids).cast(pa.int64()),
                        pc.fill_null(pc.equal(back, text), True), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece_ids", "n_pieces", "restored", "decoded_crc32"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, piece_ids array<int>, n_pieces long, restored boolean, decoded_crc32 long")
