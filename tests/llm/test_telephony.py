"""Telephony audio: code tables, ADPCM step by step, and exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from awkward import outcome

from lyrebird.llm import telephony as T


def test_code_tables():
    assert len(set(T.MULAW.tolist())) == 255 and T.MULAW[0xFF] == T.MULAW[0x7F] == 0
    assert T.MULAW[0x80] == 32124 and T.MULAW[0x00] == -32124
    assert len(set(T.ALAW.tolist())) == 256 and T.ALAW[0xD5] == 8 and T.ALAW[0x55] == -8 and T.ALAW[0xAA] == 32256 and T.ALAW[0x2A] == -32256


def one_block(data):
    value, index = int.from_bytes(data[:2], "little", signed=True), data[2]
    out = [value]
    for byte in data[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T._STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


@pytest.mark.parametrize("n", [64, 252, 256, 1024])
def test_adpcm(n):
    rng = np.random.default_rng(n)
    many = [T.wav_codes(T.wav_bytes(rng.bytes(k), "ima_adpcm")) for k in (n, 64, n + 64)]
    got = T.adpcm_samples([(block, data) for _, _, block, data in many])
    for (_, _, block, data), pcm in zip(many, got, strict=True):
        assert pcm.tolist() == [x for i in range(0, len(data), block) for x in one_block(data[i : i + block])]


@pytest.mark.parametrize("codec", T.CODECS)
def test_payloads_come_back(codec):
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000):
        payload = T.padded(rng.bytes(n))
        assert len(payload) == max(64, -(-n // 64) * 64)
        name, back, pcm = T.decoded([T.wav_bytes(payload, codec)])[0]
        assert (name, back) == (codec, payload) and len(pcm) >= 2 * len(payload)


def test_resampling():
    x = np.array([0, 10, -10], np.int16)
    assert T.resampled(x, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10] and T.resampled(x, 8000, 8000).tolist() == x.tolist()
    assert len(T.resampled(np.zeros(80, np.int16), 8000, 44100)) == 441
    with pytest.raises(ValueError):
        T.wav_codes(b"RIFF")


def test_columns(docs, odd_docs, no_docs, rows):
    got = T.media_columns(odd_docs)
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
        _, payload, pcm = T.decoded([bytes(r.media)])[0]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and r.pcm == pcm.tobytes() and r.feature.endswith(T.features(pcm))
    for i, t, *_ in rows:
        data = (t or "").encode()
        assert any(r.n_bytes == len(data) and r.payload_sha256 == hashlib.sha256(T.padded(data)).hexdigest() for r in by[i])
    plain = T.media_columns(docs, blobs=False)
    assert outcome(got.select(*plain.columns)) == outcome(plain) and T.media_columns(no_docs).count() == 0
    assert len({c.codec for v in by.values() for c in v}) == 3


def test_decoding_given_media(spark):
    rows = [(1, bytearray(T.wav_bytes(T.padded(b"abc"), "alaw")), "x"), (2, None, "y")]
    got = {r.k: r for r in T.decode_media(spark.createDataFrame(rows, "k int, media binary, pcm string")).collect()}
    assert got[1].codec == "alaw" and len(got[1].pcm) == 2 * 2 * 64 and got[2].pcm is None
