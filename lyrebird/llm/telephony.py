"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM in WAV.

Stored bytes are one code a sample (half a byte for ADPCM).  Reading expands
mu-law and A-law with a table of 256 values, decodes ADPCM one step at a time
for all blocks of many rows together, and resamples to linear PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lyrebird.llm.words import text_blocks
from lyrebird.staging import table

RATE = 8000
OUT_RATE = 16000
#: payloads are padded with zeros to a multiple of this
UNIT = 64
#: bytes of an ADPCM block, its header of 4 among them
ADPCM_BLOCK = 256

#: codec -> WAV format tag; fixed values of the WAV format
FORMATS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
CODECS = tuple(FORMATS)

# Fixed values of the IMA ADPCM standard.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], np.int32)
_INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav_bytes(payload: bytes, codec: str) -> bytes:
    """A mono WAV file whose codes are the payload."""
    if codec == "ima_adpcm":
        part = ADPCM_BLOCK - 4
        body = b"".join(bytes(4) + payload[i : i + part] for i in range(0, len(payload), part))
        samples = 2 * len(payload) + -(-len(payload) // part)
        fmt = struct.pack("<HHIIHHHH", 17, 1, RATE, RATE * ADPCM_BLOCK // (2 * part + 1), ADPCM_BLOCK, 4, 2, 2 * part + 1)
    else:
        body, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    rest = b"".join(n + struct.pack("<I", len(x)) + x for n, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", body)))
    return b"RIFF" + struct.pack("<I", 4 + len(rest)) + b"WAVE" + rest


def wav_codes(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block size and data of a mono telephony WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            fmt = next((c for c, t in FORMATS.items() if t == tag), None), channels, rate, block
        elif name == b"data":
            if not fmt or not fmt[0] or fmt[1] != 1:
                raise ValueError("not a mono telephony codec")
            return fmt[0], fmt[2], fmt[3], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def payload_of(codec: str, block: int, data: bytes) -> bytes:
    """The codes alone, without the headers of ADPCM blocks."""
    return b"".join(data[i + 4 : i + block] for i in range(0, len(data), block)) if codec == "ima_adpcm" else data


def adpcm_samples(many: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each (block size, data); blocks of all rows are decoded side by side."""
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(many)
    for size in {b for b, _ in many}:
        own = [i for i, (b, _) in enumerate(many) if b == size]
        counts = [-(-len(many[i][1]) // size) for i in own]
        raw = np.zeros((sum(counts), size), np.uint8)
        flat, at = raw.reshape(-1), 0
        for i, n in zip(own, counts, strict=True):
            flat[at : at + len(many[i][1])] = np.frombuffer(many[i][1], np.uint8)
            at += n * size
        value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(raw[:, 2], 88).astype(np.int32)
        pcm = np.empty((2 * (size - 4) + 1, len(raw)), np.int16)
        pcm[0] = value
        codes = np.ascontiguousarray(raw[:, 4:].T)
        for k in range(2 * (size - 4)):
            code = codes[k // 2] >> 4 if k % 2 else codes[k // 2] & 15
            step = _STEPS[index]
            delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + _INDEX_STEP[code], 0, 88)
            pcm[k + 1] = value
        whole, at = np.ascontiguousarray(pcm.T), 0
        for i, n in zip(own, counts, strict=True):
            last = len(many[i][1]) - (n - 1) * size  # bytes of a short last block
            out[i] = whole[at : at + n].reshape(-1)[: (n - 1) * (2 * (size - 4) + 1) + 2 * (last - 4) + 1] if n else out[i]
            at += n
    return out


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation of 16-bit samples from one rate to another."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.repeat(pcm, 2)
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        return out
    return np.rint(np.interp(np.arange(len(pcm) * to // rate) * (rate / to), np.arange(len(pcm)), pcm)).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square and sign changes, in whole numbers."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt(np.dot(wide, wide) / max(1, len(wide))))
    changes = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={rms};changes={changes}"


def decoded(media: list[bytes], to: int = OUT_RATE) -> list[tuple[str, bytes, np.ndarray]]:
    """codec, payload and PCM at the rate asked for, of each WAV file."""
    read = [wav_codes(m) for m in media]
    adpcm = iter(adpcm_samples([(block, data) for codec, _, block, data in read if codec == "ima_adpcm"]))
    out = []
    for codec, rate, block, data in read:
        pcm = next(adpcm) if codec == "ima_adpcm" else (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)]
        out.append((codec, payload_of(codec, block, data), resampled(pcm, rate, to)))
    return out


def _store_and_read(kind: pa.DataType, blobs: bool, to: int, codecs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in text_blocks(batch["data"]):
                texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                media = [wav_bytes(p := padded(t), codecs[zlib.crc32(p) % len(codecs)]) for t in texts]
                read = decoded(media, to)
                columns = {
                    "doc_id": batch["doc_id"].slice(first, len(texts)),
                    "n_bytes": pa.array(np.diff(offsets)),
                    "codec": pa.array([c for c, _, _ in read], pa.string()),
                    "payload_bytes": pa.array([len(p) for _, p, _ in read], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for _, p, _ in read], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for _, p, _ in read], pa.int64()),
                    "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    "feature": pa.array([f"{c};{features(x)}" for c, _, x in read], pa.string()),
                }
                if blobs:
                    columns |= {"media": pa.array(media, pa.binary()), "pcm": pa.array([x.tobytes() for _, _, x in read], pa.binary())}
                yield pa.record_batch(columns)

    return run


def media_columns(docs: DataFrame, blobs: bool = True, to: int = OUT_RATE, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """doc_id, digests and features of each row's media, and with blobs also media (WAV) and pcm (16-bit).

    docs has doc_id and text.  A null text is an empty one and stores one unit of
    zeros.  The codec is picked by the payload's CRC, so equal texts have equal
    values; repeated rows and null ids stay as they are.  An empty table gives no
    rows.  Other columns are left alone.
    """
    kind = next(f for f in docs.schema.fields if f.name == "doc_id").dataType
    schema = (
        f"doc_id {kind.simpleString()}, n_bytes long, codec string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string" + (", media binary, pcm binary" if blobs else "")
    )
    data = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(_store_and_read(to_arrow_type(kind), blobs, to, codecs), schema)


def decode_media(rows: DataFrame, media: str = "media", to: int = OUT_RATE) -> DataFrame:
    """rows with pcm (16-bit samples at rate to) and codec of its WAV column.

    Null media have null pcm and codec; bytes that are no mono telephony WAV are an
    error.  Each row is read by itself, 256 at a time, so repeated rows have equal
    results; media without samples have empty pcm; an empty table gives no rows.
    Columns named pcm and codec are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                given = part[media].to_pylist()
                read = iter(decoded([m for m in given if m is not None], to))
                found = [next(read) if m is not None else None for m in given]
                pcm = pa.array([x and x[2].tobytes() for x in found], pa.binary())
                codec = pa.array([x and x[0] for x in found], pa.string())
                yield pa.record_batch([*part.columns, codec, pcm], [*part.schema.names, "codec", "pcm"])

    fields = [f for f in rows.schema.fields if f.name not in ("codec", "pcm")]
    kept = rows.select(*[f.name for f in fields])
    schema = StructType([*fields, StructField("codec", StringType()), StructField("pcm", BinaryType())])
    return kept.mapInArrow(run, schema)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), blobs=False)
