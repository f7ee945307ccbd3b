"""Telephony audio columns: G.711 and IMA ADPCM in RIFF files, expanded and resampled.

A media column holds whole files as binary. mu-law and A-law bytes are expanded by
256-entry tables. ADPCM is sequential inside a block and independent between blocks,
so the blocks of a whole batch are decoded together, one step of all of them at a
time. What readers get is 16-bit PCM at the wanted rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollkin.llm.arrow_text import slices, texts_of
from rollkin.sources.scratch import written

UNIT = 576
PAD = b"\xff"
RATE = 8000
ALAW, MULAW, ADPCM = 6, 7, 17  # format tags of RIFF files
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}

# Step sizes and index changes of the IMA ADPCM recommendation.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


class Audio(NamedTuple):
    """A parsed file: format tag, samples a second, bytes of a block, sample data."""

    tag: int
    rate: int
    block: int
    data: memoryview


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte (complemented sign, 3-bit segment, 4-bit step; bias 132)."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte (even bits inverted; segment 0 is linear)."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@lru_cache(maxsize=1)
def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """(signed change, next index) for each step index and 4-bit code."""
    code, step = np.arange(16), STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of equal-sized mono blocks: (blocks, bytes) uint8 -> (blocks, samples) int16.

    A block begins with its first sample, the step index and a reserved byte; then come
    4-bit codes, the low half of a byte first.
    """
    change, after = _adpcm_moves()
    n, width = blocks.shape
    codes = np.empty((2 * (width - 4), n), dtype=np.int32)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, n), dtype=np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = sample
    for i, code in enumerate(codes, 1):
        move = state + code
        sample = np.clip(sample + change[move], -32768, 32767)
        state = after[move]
        out[i] = sample
    return np.ascontiguousarray(out.T)


def riff(tag: int, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF file; for ADPCM ``data`` is whole blocks of ``block`` bytes."""
    if tag == ADPCM:
        samples = 2 * (block - 4) + 1
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // samples, block, 4, 2, samples)
        count = len(data) // block * samples
    else:
        form, count = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), len(data)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_riff(media: bytes) -> Audio:
    """Format and data of a RIFF file. Anything else raises ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF audio file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            return Audio(form[0], form[2], form[4], memoryview(media)[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no format or no data")


def pack(payload: bytes) -> bytes:
    """A file that holds ``payload`` unchanged as samples of the format that its CRC-32 picks.

    mu-law and A-law take a byte as a sample; ADPCM takes it as two 4-bit codes, in
    blocks of 576 payload bytes behind a neutral block header.
    """
    tag = (ALAW, MULAW, ADPCM)[zlib.crc32(payload) % 3]
    if tag != ADPCM:
        return riff(tag, payload)
    rows = np.zeros((len(payload) // UNIT, UNIT + 4), dtype=np.uint8)
    rows[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    return riff(tag, rows.tobytes(), block=UNIT + 4)


def unpack(audio: Audio) -> bytes:
    """The payload that ``pack`` stored."""
    if audio.tag != ADPCM:
        return bytes(audio.data)
    return np.frombuffer(audio.data, dtype=np.uint8).reshape(-1, audio.block)[:, 4:].tobytes()


@lru_cache(maxsize=8)
def _low_pass(up: int, down: int, reach: int = 8) -> np.ndarray:
    """Windowed sinc that passes what both rates can hold; ``reach`` input samples to a side."""
    half = reach * up
    t = np.arange(-half, half + 1) / max(up, down)
    taps = np.sinc(t) * np.hanning(2 * half + 3)[1:-1]
    return taps * up / taps.sum()


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """16-bit samples at up/down times the rate, by a polyphase filter."""
    if up == down or not len(pcm):
        return pcm
    taps = _low_pass(up, down)
    half = len(taps) // 2
    wide = np.zeros(len(pcm) * up)
    x = pcm.astype(np.float64)
    for phase in range(up):
        own = taps[phase::up]  # this phase's taps meet input samples half/up before and after
        wide[phase::up] = np.convolve(x, own)[half // up : half // up + len(x)]
    return np.clip(np.rint(wide[::down]), -32768, 32767).astype(np.int16)


def to_pcm(audios: list[Audio]) -> list[np.ndarray]:
    """16-bit samples of each file, ADPCM blocks of all files decoded together."""
    out: list[np.ndarray | None] = [None] * len(audios)
    by_block: dict[int, list[int]] = {}
    for i, a in enumerate(audios):
        raw = np.frombuffer(a.data, dtype=np.uint8)
        if a.tag == MULAW:
            out[i] = mulaw_table()[raw]
        elif a.tag == ALAW:
            out[i] = alaw_table()[raw]
        elif a.tag == ADPCM:
            by_block.setdefault(a.block, []).append(i)
        else:
            raise ValueError(f"format tag {a.tag} is not a telephony format")
    for block, members in by_block.items():
        rows = [np.frombuffer(audios[i].data, dtype=np.uint8).reshape(-1, block) for i in members]
        samples = adpcm_blocks(np.concatenate(rows))
        at = 0
        for i, r in zip(members, rows):
            out[i] = samples[at : at + len(r)].ravel()
            at += len(r)
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each whole text, padded to a unit, as an audio file.

    A null text counts as empty and gives one unit of padding. Null ids stay, repeated
    rows give a row each, other columns aren't read, no rows give no rows.
    """
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [t.as_buffer().to_pybytes() for t in texts_of(part, "text")]
                media = [pack(r + PAD * (-len(r) % UNIT if r else UNIT)) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _media_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "media", 4 << 20)


def pcm_column(media: DataFrame, rate: int = 16000) -> DataFrame:
    """``media`` (with a column ``media``) and ``pcm``: 16-bit little-endian samples at ``rate``.

    This is the form to store for training. A null file gives null; a ``pcm`` column
    that is there already is replaced.
    """
    media = media.drop("pcm") if "pcm" in media.columns else media
    schema = media.limit(0).selectExpr("*", "CAST(null AS binary) AS pcm").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _media_slices(batches):
            files = part.column("media").to_pylist()
            audios = [parse_riff(f) for f in files if f is not None]
            pcm = iter([resample(x, *_ratio(a.rate, rate)).astype("<i2").tobytes() for a, x in zip(audios, to_pcm(audios))])
            column = pa.array([None if f is None else next(pcm) for f in files], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "pcm"])

    return media.mapInArrow(work, schema)


def _ratio(have: int, want: int) -> tuple[int, int]:
    g = np.gcd(have, want)
    return int(want // g), int(have // g)


def feature(audio: Audio, pcm: np.ndarray) -> str:
    """Format, samples, root mean square, sign changes, peak and CRC-32 of the resampled sound."""
    wide = pcm.astype(np.float32)
    rms = float(np.sqrt(np.dot(wide, wide) / max(1, len(wide))))
    turns = int(np.count_nonzero(np.signbit(wide[1:]) != np.signbit(wide[:-1])))
    peak = int(np.abs(pcm.astype(np.int32)).max(initial=0))
    return f"{NAMES[audio.tag]} n={len(pcm)} rms={rms:.0f} turns={turns} peak={peak} crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def digests(media: DataFrame, rate: int = 16000) -> DataFrame:
    """What the stored files hold: (doc_id, n_bytes, payload and file digests, feature, pcm) per row.

    ``pcm``: the sound of the file that was read back, expanded or decoded and resampled
    to ``rate``, as 16-bit little-endian samples; the feature is taken from it.
    """
    schema = (
        f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _media_slices(batches):
            files = part.column("media").to_pylist()
            audios = [parse_riff(f) for f in files]
            payloads = [unpack(a) for a in audios]
            sounds = [resample(x, *_ratio(a.rate, rate)) for a, x in zip(audios, to_pcm(audios))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("n_bytes"), pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array(map(len, files), pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([feature(a, x) for a, x in zip(audios, sounds)]), pa.array([x.astype("<i2").tobytes() for x in sounds], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
            )

    return media.mapInArrow(work, schema)


def stored_digests(docs: DataFrame, rate: int = 16000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as audio in the shared folder, reads the files back, and gives their digests and PCM.

    The resampled PCM is a column of the result, so it is stored where the result is.
    Nulls, repeats, clashing columns and empty tables: as in ``store_texts``.
    """
    return digests(written(store_texts(docs, id_col, text_col), "media"), rate)
