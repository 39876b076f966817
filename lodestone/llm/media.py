"""Telephony audio: texts kept as 8-bit samples, expanded from mu-law, A-law and IMA ADPCM.

``encode`` stores a payload as a mu-law WAV file, one sample a byte, so it is lossless; ``decode`` walks
the chunks of a WAV file again; ``features`` expands the samples by lookup tables, decodes ADPCM blocks
with numpy across all blocks of a slab, and resamples to 16 kHz PCM.

Edge cases: a null or empty text is one block of 192 spaces; a null id stays null; repeated rows give
repeated rows with equal values; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.scratch import written

BLOCK = 192
PAD = b"\x20"
RATE = 8000
MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 17, 1
SLAB_BYTES = 4 << 20

# Fixed values of the IMA ADPCM format.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mu_law_table() -> np.ndarray:
    """PCM16 value of each of the 256 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM16 value of each of the 256 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + code: the change of the predictor, and the next step index."""
    index, code = np.divmod(np.arange(89 * 16), 16)
    step = np.array(IMA_STEPS)[index]
    move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -move, move).astype(np.int32)
    return change, np.clip(index + np.array(IMA_MOVES)[code & 7], 0, 88).astype(np.int32)


MU, A = mu_law_table(), a_law_table()
CHANGE, NEXT = _ima_tables()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples (steps x blocks, int16) of ADPCM blocks (blocks x bytes, uint8), all blocks in step."""
    columns = np.ascontiguousarray(blocks.T)
    value = (columns[0].astype(np.int32) | (columns[1].astype(np.int32) << 8)).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(columns[2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (len(columns) - 4), blocks.shape[0]), np.int16)
    out[0] = value
    for k, column in enumerate(columns[4:]):
        for half, code in enumerate((column & 15, column >> 4)):
            at = (index << 4) + code
            value += CHANGE[at]
            np.clip(value, -32768, 32767, out=value)
            index = NEXT[at]
            out[1 + 2 * k + half] = value
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of the text, filled with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def wav(data: bytes, tag: int = MU_LAW) -> bytes:
    """A mono 8 kHz WAV file of 8-bit codes."""
    chunks = b"fmt " + struct.pack("<IHHIIHHH", 18, tag, 1, RATE, RATE, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(data))
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(stored: bytes) -> tuple[int, bytes]:
    """Format tag and data of a WAV file; ValueError if it isn't one."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", stored, at + 8)[0]
        elif name == b"data" and tag is not None:
            return tag, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def expand(tag: int, data: bytes, block: int = BLOCK) -> np.ndarray:
    """PCM16 samples of mu-law, A-law, ADPCM or PCM data."""
    codes = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return MU[codes]
    if tag == A_LAW:
        return A[codes]
    if tag == IMA_ADPCM:
        return ima_decode(codes.reshape(-1, block)).T.ravel()
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format {tag} is not known")


def double_rate(samples: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: each sample, then the mean of it and the next; a recording's last one is held."""
    after = np.empty_like(samples)
    after[:-1] = samples[1:]
    after[ends - 1] = samples[ends - 1]
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    out[1::2] = (samples.astype(np.int32) + after) >> 1
    return out


def _slab_features(datas: list[bytes], keep_pcm: bool) -> tuple[list[str], list[bytes | None]]:
    """Of recordings whose lengths are multiples of 192."""
    codes = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.fromiter(map(len, datas), np.int64, len(datas))
    ends = np.cumsum(sizes)
    starts, mu, a = ends - sizes, MU[codes], A[codes]
    total = lambda x: np.add.reduceat(x, starts)
    square = lambda x: total(np.square(x, dtype=np.int64))
    crossing = np.zeros(len(mu), np.int64)
    crossing[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    crossing[starts] = 0
    decoded = ima_decode(codes.reshape(-1, BLOCK))
    of_block = np.square(decoded, dtype=np.int64).sum(axis=0)
    ima, last = np.add.reduceat(of_block, starts // BLOCK), np.add.reduceat(decoded[-1].astype(np.int64), starts // BLOCK)
    wide = double_rate(mu, ends)
    made = zip(square(mu), np.maximum.reduceat(np.abs(mu.astype(np.int32)), starts), total(crossing), square(a), ima, last, starts, ends, strict=True)
    texts, pcm = [], []
    for mu2, peak, zero, a2, ima2, tail, s, e in made:
        samples = wide[2 * s : 2 * e].tobytes()
        texts.append(f"mu:{mu2}:{peak}:{zero};a:{a2};ima:{ima2}:{tail};pcm16k:{2 * (e - s)}:{zlib.crc32(samples):08x}")
        pcm.append(samples if keep_pcm else None)
    return texts, pcm


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, media = [], []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode()
            n.append(len(raw))
            media.append(wav(raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def _decoder(keep_pcm: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, crc, sizes, media_sha, media_n, texts, pcm, slab, held = [], [], [], [], [], [], [], [], 0
            for value in batch.column(2):
                stored = value.as_buffer()
                view = stored.to_pybytes()
                data = unwav(view)[1]
                sha.append(hashlib.sha256(data).hexdigest())
                crc.append(zlib.crc32(data[-16:]))
                sizes.append(len(data))
                media_sha.append(hashlib.sha256(view).hexdigest())
                media_n.append(len(view))
                slab.append(data)
                held += len(data)
                if held >= SLAB_BYTES:
                    more = _slab_features(slab, keep_pcm)
                    texts, pcm, slab, held = texts + more[0], pcm + more[1], [], 0
            if slab:
                more = _slab_features(slab, keep_pcm)
                texts, pcm = texts + more[0], pcm + more[1]
            long = pa.int64()
            columns = [batch.column(0), batch.column(1), pa.array(sizes, long), pa.array(sha, pa.string()), pa.array(crc, long), pa.array(media_n, long), pa.array(media_sha, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pcm, pa.binary())] * keep_pcm, ["id", *FIELDS, *["pcm16k"] * keep_pcm])

    return decode


FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
TYPES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a WAV file, one task a partition, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(_encode, f"id {kind}, n_bytes long, media binary")


def features(media: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Digests and features of stored media; with ``keep_pcm`` the resampled PCM too."""
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(_decoder(keep_pcm), f"id {kind}, {TYPES}" + ", pcm16k binary" * keep_pcm)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media in the shared folder and describes what is read back."""
    return features(written(encode(df, id_col, text_col), "media")).withColumnRenamed("id", id_col)
