"""Telephony audio as media columns.

Companded samples (mu-law, A-law) are expanded by lookup tables of 256 entries, IMA ADPCM blocks are
decoded step by step with numpy vectors across all blocks of many files at once, and the PCM is
resampled and stored as 16-bit WAV.  ``store_payload`` keeps arbitrary bytes losslessly in a WAV file: as
mu-law or A-law samples, or as ADPCM blocks of 576 bytes.  ``text_media`` writes texts so, one of the
three formats for each by a checksum of its bytes; ``decoded`` reads stored files and gives digests, a
description of the sound, and the resampled PCM.

Defined cases: a null text counts as an empty one; an empty text is one padding unit; media that are
null or can't be read give nulls; repeated rows give a row each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, written

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
UNIT = 576


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 85
    part, low = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(part == 0, low, low + 256 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM format: the step sizes and the index changes.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _ima_change() -> np.ndarray:
    """The change of the value for each step index and nibble: an eighth, a quarter, a half and the whole of the step by the bits set."""
    code = np.arange(16)
    step = IMA_STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


IMA_CHANGE = _ima_change()


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: every whole block at once, one nibble of all blocks a step; a cut last block is dropped."""
    if block <= 4 or len(data) < block:
        return np.zeros(0, np.int16)
    blocks = np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    coded = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(coded) + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * len(coded)):
        code = coded[k // 2] >> 4 if k % 2 else coded[k // 2] & 15
        value = np.clip(value + IMA_CHANGE[index, code], -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[k + 1] = value
    return out.T.reshape(-1)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, so that every machine gives the same samples."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part) // to).astype(np.int16)


def wav(kind: int, rate: int, bits: int, block: int, data: bytes, samples: int) -> bytes:
    """A mono RIFF WAVE file; formats other than PCM get the fact chunk."""
    extra = b"" if kind == PCM else struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == IMA else struct.pack("<H", 0)
    speed = rate * block if kind != IMA else rate * block // (2 * (block - 4) + 1)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16 + len(extra), kind, 1, rate, speed, block, bits) + extra
    if kind != PCM:
        form += struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes] | None:
    """Format, rate, block size and sample bytes of a mono WAVE file; None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = (kind, rate, block) if channels == 1 and rate else None
        elif name == b"data" and form:
            return (*form, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def decode_wav(media: bytes | None) -> tuple[np.ndarray, int] | None:
    """PCM samples and their rate."""
    return decode_all([read_wav(media) if media is not None else None])[0]


def pcm_wav(pcm: np.ndarray, rate: int) -> bytes:
    return wav(PCM, rate, 16, 2, pcm.astype("<i2").tobytes(), len(pcm))


def store_payload(payload: bytes, rate: int = 8000, kind: int = MULAW, unit: int = UNIT) -> bytes:
    if kind == IMA:
        return wav(IMA, rate, 4, unit, payload, len(payload) // unit * (2 * (unit - 4) + 1))
    return wav(kind, rate, 8, 1, payload, len(payload))


def feature(pcm: np.ndarray, rate: int) -> str:
    """Rate, samples, peak, root mean square, sign changes and mean of a sound; one value for equal sounds."""
    wide = pcm.astype(np.int64)
    n = len(wide)
    if not n:
        return f"rate={rate};samples=0"
    low = pcm < 0
    turns = int(np.count_nonzero(low[1:] != low[:-1]))
    return f"rate={rate};samples={n};peak={int(np.abs(wide).max())};rms={(int((wide * wide).sum()) / n) ** 0.5:.3f};turns={turns};mean={int(wide.sum()) / n:.3f}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(id_col, n_bytes, media): each text's bytes, padded with 255 to a positive multiple of unit, as a WAV file."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                raw = text.as_py() or b""
                sizes.append(len(raw))
                kind = (MULAW, ALAW, IMA)[zlib.crc32(raw) % 3]
                media.append(store_payload(raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw)), kind=kind, unit=unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def decode_all(files: list[tuple[int, int, int, bytes] | None]) -> list[tuple[np.ndarray, int] | None]:
    """PCM samples and rate of many files as read_wav gives them; ADPCM blocks of one size are decoded together."""
    out: list = [None] * len(files)
    alike: dict[int, list[int]] = {}
    for i, found in enumerate(files):
        if found is None:
            continue
        kind, rate, block, data = found
        if kind in (MULAW, ALAW):
            out[i] = (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)], rate
        elif kind == IMA:
            alike.setdefault(block, []).append(i)
        elif kind == PCM and block == 2:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
    for block, members in alike.items():
        whole = [len(files[i][3]) // block if block > 4 else 0 for i in members]
        sound = decode_ima(b"".join(files[i][3][: n * block] for i, n in zip(members, whole)), block)
        ends = np.cumsum(whole) * (2 * (block - 4) + 1)
        for i, n, end in zip(members, whole, ends.tolist()):
            out[i] = sound[end - n * (2 * (block - 4) + 1) : end], files[i][1]
    return out


def decoded(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", to_rate: int = 16000, keep: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """Stored WAV files read back: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm and, with keep, media.

    pcm is the sound as a 16-bit WAV file at to_rate.
    """
    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    schema = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, {kinds}" + (", media binary" if keep else "")
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm", "media"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def described(files: list[bytes | None]) -> list[list]:
        found = [None if f is None else read_wav(f) for f in files]
        columns: list[list] = [[] for _ in types]
        for raw, f, sound in zip(files, found, decode_all(found)):
            row: tuple = (None,) * 7
            if raw is not None:
                row = (None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None, None)
            if f is not None and sound is not None:
                pcm = resample(*sound, to_rate)
                row = (len(f[3]), hashlib.sha256(f[3]).hexdigest(), zlib.crc32(f[3][-32:]), row[3], row[4], f"format={NAMES[f[0]]};{feature(pcm, to_rate)}", pcm_wav(pcm, to_rate))
            for column, value in zip(columns, row):
                column.append(value)
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            sizes = np.cumsum(lengths)
            while start < len(batch):
                before = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
                part = batch.slice(start, stop - start)
                own = [pa.array(v, t) for v, t in zip(described(part.column(2).to_pylist()), types)]
                columns = [part.column(0), part.column(1), *own, *([part.column(2)] if keep else [])]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])
                start = stop

    return media.select(F.col(f"`{id_col}`"), F.col("n_bytes"), F.col(f"`{media_col}`")).mapInArrow(run, schema)


def text_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to_rate: int = 16000, unit: int = UNIT, keep: bool = True) -> DataFrame:
    """Texts as telephony audio: media files are written to the shared folder, read back and decoded."""
    return decoded(written(text_media(docs, id_col, text_col, unit), "media"), id_col, to_rate=to_rate, keep=keep)


def decode_media(media: DataFrame, media_col: str = "media", to_rate: int = 16000) -> DataFrame:
    """Adds pcm, the resampled 16-bit WAV of any supported mono WAV column (null where it can't be read)."""

    @F.udf("binary", useArrow=True)
    def pcm(data):
        found = decode_wav(bytes(data)) if data is not None else None
        return None if found is None else pcm_wav(resample(found[0], found[1], to_rate), to_rate)

    return media.withColumn("pcm", pcm(F.col(f"`{media_col}`")))


def op8_media_columns(spark, sf_dir):
    return text_audio(table(spark, sf_dir, "documents"), keep=False)
