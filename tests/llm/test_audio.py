import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import audio
from tests.llm.helpers import documents, empty


def g711_mulaw(code):
    code = ~code & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def g711_alaw(code):
    code ^= 0x55
    e, m = code >> 4 & 7, code & 15
    size = (m << 4) + 8 if e == 0 else ((m << 4) + 264) << (e - 1)
    return size if code & 128 else -size


def adpcm_block(block):
    """One IMA block, sample by sample."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[nibble])))
            out.append(value)
    return out


def plain_figures(samples):
    changes = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
    return f"{sum(x * x for x in samples) // len(samples)}/{max(map(abs, samples))}/{changes}"


def plain_feature(payload):
    """The feature by plain decoders, sample by sample: doubled mu-law, mu-law, A-law and ADPCM."""
    mulaw = [g711_mulaw(c) for c in payload]
    doubled = [y for a, b in zip(mulaw, mulaw[1:] + mulaw[-1:]) for y in (a, round((a + b) / 2))]
    adpcm = [x for i in range(0, len(payload), 64) for x in adpcm_block(payload[i : i + 64])]
    signals = {"pcm16000": doubled, "mulaw": mulaw, "alaw": [g711_alaw(c) for c in payload], "adpcm": adpcm}
    return ";".join(f"{name}:{plain_figures(x)}" for name, x in signals.items())


def test_tables():
    assert audio.MULAW_TABLE.tolist() == [g711_mulaw(c) for c in range(256)]
    assert audio.ALAW_TABLE.tolist() == [g711_alaw(c) for c in range(256)]
    assert audio.MULAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_TABLE[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    assert len(audio.STEPS) == 89 and all(abs(b / a - 1.1) < 0.06 for a, b in zip(audio.STEPS[20:], audio.STEPS[21:]))


def test_adpcm_blocks_side_by_side():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8).tobytes()
    wanted = [s for i in range(50) for s in adpcm_block(data[i * 64 : i * 64 + 64])]
    assert audio.decode_adpcm(data).tolist() == wanted


def test_resampling():
    pcm = np.array([0, 3, -5, 32767, -32768], dtype=np.int16)
    twice = audio.resample(pcm)
    assert twice[::2].tolist() == pcm.tolist()
    assert twice.tolist() == np.rint(np.interp(np.minimum(np.arange(10) / 2, 4), np.arange(5), pcm)).astype(int).tolist()
    assert len(audio.resample(np.arange(100, dtype=np.int16), 8000, 11025)) == 137


@pytest.mark.parametrize("kind", [audio.MULAW, audio.ALAW, audio.ADPCM])
@pytest.mark.parametrize("n", [64, 128, 6400])
def test_stored_payloads_come_back(kind, n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert audio.load(audio.store(payload, kind)) == (kind, 8000, payload)
    with pytest.raises(ValueError):
        audio.load(payload)


def test_odd_rows(spark):
    docs = documents(spark)
    import factloom.llm.audio as a

    class Reader:
        """Stands in for a session whose documents are these."""

        conf = spark.conf

        class read:
            parquet = staticmethod(lambda _: docs)

    got = a.op6_audio(Reader, "").collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(got) == 14
    values = {}
    for r in got:
        raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = audio.store(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == plain_feature(payload)
        assert values.setdefault(raw, r.feature) == r.feature


def test_media_columns(spark):
    rows = {r.doc_id: r for r in audio.media_columns(documents(spark, [(1, "some bytes", "en", "a"), (2, None, "en", "a")])).collect()}
    kind, rate, payload = audio.load(bytes(rows[1].media))
    assert payload.startswith(b"some bytes") and len(payload) == 64 and len(rows[1].pcm) == 2 * 128
    assert len(rows[2].pcm) == 256
    assert audio.media_columns(empty(spark)).count() == 0


def test_features_come_from_the_bytes_read_back(monkeypatch):
    """A store that changes bytes shows in every part of the feature."""
    back, load = audio.padded(b"other bytes"), audio.load
    monkeypatch.setattr(audio, "load", lambda media: (*load(media)[:2], back))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"some bytes"])], names=["doc_id", "text"])
    [got] = audio._figures_of(iter([batch]))
    assert got.column("feature").to_pylist() == [plain_feature(back)]


@pytest.mark.parametrize("size", [64, 128, 192])
def test_slices_change_nothing(monkeypatch, size):
    r = np.random.default_rng(size)
    texts = [r.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 130, 1000, 64, 300, 5, 640)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    [whole] = audio._figures_of(iter([batch]))
    monkeypatch.setattr(audio, "SLICE", size)
    [parts] = audio._figures_of(iter([batch]))
    assert whole.equals(parts)
    assert whole.column("feature").to_pylist() == [plain_feature(audio.padded(t)) for t in texts]
    sounds = [audio.resample(audio.to_pcm(audio.MULAW, audio.padded(t))).astype("<i2").tobytes() for t in texts]
    assert whole.column("pcm_sha256").to_pylist() == [hashlib.sha256(x).hexdigest() for x in sounds]


def test_memory_of_a_long_text():
    """A long text needs a few times its own size: the text, its stored form and what is read back."""
    n = 8 << 20
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"abcdefg " * (n // 8)])], names=["doc_id", "text"])
    tracemalloc.start()
    [got] = audio._figures_of(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("payload_bytes").to_pylist() == [n] and peak < 8 * n
