"""Telephony audio columns: mu-law, A-law and IMA ADPCM, expanded to PCM and resampled.

Companded samples go through 256-entry lookup tables. ADPCM blocks are decoded side by side: one numpy step
for the n-th sample of every block. Telephone rate (8 kHz) is resampled to 16 kHz by linear interpolation
and stored as 16-bit PCM.

A payload is stored losslessly as the data chunk of a RIFF/WAVE file of 8-bit mu-law samples (format 7) and
read back through the file's own chunk table.

The query's figures are summed slice by slice, so beside a text's own stored and read-back bytes a worker holds the samples
of a slice or two, however long the text. ADPCM blocks of short texts are decoded together up to a slice.

Defined results: a null text counts as empty and stores 64 zero bytes; equal texts give equal values; a null doc_id is kept;
rows pass one by one, repeated rows included; an empty table gives an empty result; columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, raw_bytes, spread, text_bytes

UNIT, RATE, OUT_RATE, MULAW, ALAW, ADPCM = 64, 8000, 16000, 7, 6, 0x11
#: Bytes of payload expanded at once, a multiple of the block.
SLICE = 1 << 18


def _mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: inverted bits, a sign, a three-bit exponent and a four-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: even bits inverted, a sign, a three-bit exponent and a four-bit mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, step + 8, step + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _step_table() -> np.ndarray:
    """IMA ADPCM step sizes: 7, then about a tenth more each time up to 32767."""
    # Fixed values of the published format.
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
            544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
            12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        dtype=np.int32,
    )


MULAW_TABLE, ALAW_TABLE, STEPS = _mulaw_table(), _alaw_table(), _step_table()
#: How a nibble moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def expand(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[codes]


def decode_adpcm(data: bytes, block: int = UNIT) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks: a first sample, a step index and a reserved byte, then nibbles, low first.

    All blocks are decoded together, so the loop runs over the samples of one block.
    """
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((len(rows), 1 + 2 * (block - 4)), dtype=np.int16)
    out[:, 0] = value
    for n in range(2 * (block - 4)):
        nibble = (rows[:, 4 + n // 2] >> (4 * (n % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[nibble], 0, len(STEPS) - 1)
        out[:, n + 1] = value
    return out.reshape(-1)


def resample(pcm: np.ndarray, rate: int = RATE, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation to another rate, rounded half to even; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    if to == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(n, dtype=np.int32)
        out[::2] = wide
        middle = wide + np.append(wide[1:], wide[-1:])
        out[1::2] = middle + (middle >> 1 & 1) >> 1
        return out.astype(np.int16)
    return np.rint(np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm)).astype(np.int16)


def store(payload: bytes, kind: int = MULAW, rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file whose data chunk is the payload."""
    block = 1 if kind != ADPCM else UNIT
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * block, block, 8 if kind != ADPCM else 4, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def load(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, payload) of a stored file, by its chunk table."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pcm_slices(kind: int, payload: bytes) -> Iterator[np.ndarray]:
    """The payload's samples, slice by slice."""
    for at in range(0, len(payload), SLICE):
        part = payload[at : at + SLICE]
        yield decode_adpcm(part) if kind == ADPCM else expand(np.frombuffer(part, dtype=np.uint8), {MULAW: MULAW_TABLE, ALAW: ALAW_TABLE}[kind])


def to_pcm(kind: int, payload: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int16), *pcm_slices(kind, payload)])


def doubled_slices(slices: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """What ``resample`` to the double rate makes of the whole signal, slice by slice: each waits for the next one's first sample."""
    held = None
    for part in slices:
        if held is not None:
            yield resample(np.append(held, part[:1]))[:-2]
        held = part
    if held is not None:
        yield resample(held)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


class Figures:
    """Mean square (integer), peak and sign changes of a signal that comes in slices."""

    def __init__(self) -> None:
        self.n = self.squares = self.peak = self.changes = 0
        self.negative = None

    def add(self, pcm: np.ndarray) -> None:
        wide, negative = pcm.astype(np.int64), pcm < 0
        self.changes += int(np.count_nonzero(negative[1:] != negative[:-1])) + (self.negative is not None and bool(self.negative != negative[0]))
        self.n, self.squares, self.peak = self.n + len(pcm), self.squares + int(wide @ wide), max(self.peak, int(wide.max()), -int(wide.min()))
        self.negative = negative[-1]

    def __str__(self) -> str:
        return f"{self.squares // self.n}/{self.peak}/{self.changes}"


def figures(slices: Iterator[np.ndarray]) -> str:
    out = Figures()
    for part in slices:
        out.add(part)
    return str(out)


def adpcm_figures(payloads: list[bytes]) -> list[str]:
    """The figures of each payload's ADPCM samples; the blocks of short payloads are decoded together, up to a slice at once."""
    out, group, size = [], [], 0

    def flush() -> None:
        if not group:
            return
        rows = decode_adpcm(b"".join(group)).reshape(-1, 2 * (UNIT - 4) + 1)
        ends = np.cumsum([len(x) // UNIT for x in group])
        out.extend(figures(iter([part.reshape(-1)])) for part in np.split(rows, ends[:-1]))
        group.clear()

    for payload in payloads:
        if size + len(payload) > SLICE:
            flush()
            size = 0
        if len(payload) > SLICE:
            out.append(figures(pcm_slices(ADPCM, payload)))
        else:
            group.append(payload)
            size += len(payload)
    flush()
    return out


def _figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm_sha256": pa.string()}
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in kinds}
        read: list[bytes] = []
        held, first = 0, 0

        def with_adpcm() -> None:
            for i, text in enumerate(adpcm_figures(read), first):
                columns["feature"][i] += f";adpcm:{text}"

        for raw in raw_bytes(batch.column(1)):
            media = store(padded(bytes(raw)))
            kind, rate, back = load(media)
            digest, sound = hashlib.sha256(), Figures()
            for part in doubled_slices(pcm_slices(kind, back)) if OUT_RATE == 2 * rate else [resample(to_pcm(kind, back), rate)]:
                digest.update(part.astype("<i2").tobytes())
                sound.add(part)
            feature = f"pcm{OUT_RATE}:{sound};mulaw:{figures(pcm_slices(kind, back))};alaw:{figures(pcm_slices(ALAW, back))}"
            values = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, digest.hexdigest()]
            for name, value in zip(kinds, values):
                columns[name].append(value)
            read.append(back)
            held += len(back)
            if held > SLICE:
                with_adpcm()
                first, read, held = len(columns["feature"]), [], 0
        with_adpcm()
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[name], k) for name, k in kinds.items())], names=["doc_id", *kinds])


def _media(kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sound = [], []
            for raw in raw_bytes(batch.column(1)):
                stored = store(padded(bytes(raw)), kind)
                _, rate, back = load(stored)
                media.append(stored)
                sound.append(resample(to_pcm(kind, back), rate).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary()), pa.array(sound, pa.binary())], names=["doc_id", "media", "pcm"])

    return run


def media_columns(docs: DataFrame, kind: int = MULAW, data_col: str = "text") -> DataFrame:
    """(doc_id, media, pcm): the stored file of each row's bytes and its resampled 16-bit PCM, little-endian."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(data_col).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(_media(kind), "doc_id long, media binary, pcm binary")


def op6_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string"
    return spread(rows).mapInArrow(_figures_of, schema)
