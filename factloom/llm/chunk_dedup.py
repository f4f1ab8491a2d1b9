"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes is the least among its neighbours within ``REACH``
positions on either side. The place depends on the bytes near it alone, so an insertion moves no boundary
beyond its own surroundings; chunks are longer than ``REACH`` bytes and seldom over three times that. Where a
phrase of up to ``REACH`` bytes repeats, equal minima come closer and are thinned to that distance.
A chunk is shared when its 128-bit digest occurs in two or more documents. Shared chunks that follow each
other form a run, and a run of ``MIN_WORDS`` words or more is a repeated passage: in a passage of over 50
words only the chunks at its two ends, at most, are cut by text that isn't shared.

The chunk table is written once. Digests meet by a partial aggregation (least and greatest document), so a chunk of a
third of all documents is one aggregated row, which is written too: the join back to the chunks is one of two plain tables,
which adaptive execution broadcasts where the shared digests are few and splits at a hot digest where they are many. No pair
of documents is listed. Runs are found for each text of a document by itself, the key being (doc_id, hash of the text).

Defined results: null and empty texts have no chunks; texts of any length are cut whole; a passage repeated within one
document only isn't reported; rows of one doc_id count as one document, equal rows as one row and different texts as texts
of their own, with passages of their own; a null doc_id takes no part; the first holder of a passage is the smallest doc_id
among the documents that hold one of its chunks; an empty table gives an empty result; columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bounded_batches, raw_bytes, spread, stored

WINDOW, REACH, MIN_WORDS = 32, 24, 25
#: Random value of each byte, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 gear values, each shifted by its age, modulo 2**32."""
    h = GEAR[data]
    age = 1
    while age < WINDOW:
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
        age *= 2
    return h


def boundaries(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one being its length."""
    n = len(text)
    if n <= REACH:
        return np.array([n] if n else [], dtype=np.int64)
    h = gear(np.frombuffer(text, dtype=np.uint8))
    worst = np.uint32(0xFFFFFFFF)
    least, wide = h, 1
    while 2 * wide <= REACH:
        least = np.minimum(least, np.append(least[wide:], np.full(wide, worst)))
        wide *= 2
    rest = REACH - wide
    least = np.minimum(least, np.append(least[rest:], np.full(rest, worst)))  # of [i, i + REACH)
    after = np.append(least[1:], worst)
    before = np.append(np.full(REACH, worst), least[: n - REACH])
    ends = np.nonzero((h <= before) & (h <= after))[0] + 1
    ends = _apart(ends[(ends > REACH) & (ends < n)])
    data = np.frombuffer(text, dtype=np.uint8)
    for _ in range(3):  # never inside a character
        ends = ends + (data[np.minimum(ends, n - 1)] & 0xC0 == 0x80)
    return np.append(ends[ends < n], n)


def _apart(ends: np.ndarray) -> np.ndarray:
    """Ends more than ``REACH`` apart. Only equal minima are closer, where a short phrase repeats; there every choice of
    ends leaves the same chunks, as they begin at the same place of the phrase."""
    if len(ends) < 2 or int(np.diff(ends).min()) > REACH:
        return ends
    kept, last = [], -REACH
    for end in ends.tolist():
        if end - last > REACH:
            kept.append(end)
            last = end
    return np.array(kept, dtype=np.int64)


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = boundaries(text)
    return np.append(0, ends[:-1]) if len(ends) else ends, ends


_CHUNK = "doc_id long, text_key long, at int, size int, words int, hi long, lo long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each text: first byte, bytes, words that begin in it, and the digest's halves."""
    for batch in batches:
        ids, keys, starts, sizes, words, digests = [], [], [], [], [], []
        for doc_id, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_bytes(batch.column(2))):
            text = bytes(raw)
            start, end = chunks(text)
            if not len(end):
                continue
            data = np.frombuffer(text, dtype=np.uint8)
            space = (data == 32) | ((data >= 9) & (data <= 13))
            begins = np.cumsum(~space & np.append(True, space[:-1]))
            upto = begins[end - 1]
            ids.append(np.full(len(end), doc_id, dtype=np.int64))
            keys.append(np.full(len(end), key, dtype=np.int64))
            starts.append(start)
            sizes.append(end - start)
            words.append(np.diff(np.append(0, upto)))
            digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(start.tolist(), end.tolist())]
        if not ids:
            continue
        both = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
        parts = [np.concatenate(ids), np.concatenate(keys), *(np.concatenate(x).astype(np.int32) for x in (starts, sizes, words)), both[:, 0].copy(), both[:, 1].copy()]
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["doc_id", "text_key", "at", "size", "words", "hi", "lo"])
        for i in range(0, len(out), 50_000):
            yield out.slice(i, 50_000)


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, size, words, hi, lo) of all chunks; ``at`` and ``size`` count UTF-8 bytes."""
    bounded_batches(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("data"))
    return spread(rows).mapInArrow(_chunks, _CHUNK)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, later_only: bool = False) -> DataFrame:
    """Repeated passages of each text: (doc_id, text_key, start, end, words, chunks, first_doc_id), places in UTF-8 bytes, end
    exclusive.

    ``later_only`` takes of each document only chunks that a document of a smaller doc_id holds.
    """
    parts = stored(chunk_table(docs))
    shared = parts.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id")).where("first_doc_id < last_doc_id").drop("last_doc_id")
    hits = parts.join(stored(shared), ["hi", "lo"]).select("doc_id", "text_key", "at", "size", "words", "first_doc_id").distinct()
    if later_only:
        hits = hits.where("first_doc_id < doc_id")
    # A text's chunks tile it, so a run continues while a chunk begins where the one before ended.
    order = Window.partitionBy("doc_id", "text_key").orderBy("at")
    ends = F.lag(F.col("at") + F.col("size")).over(order)
    runs = hits.withColumn("begins", F.when(ends == F.col("at"), 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    found = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("at").alias("start"),
        F.max(F.col("at") + F.col("size")).alias("end"),
        F.sum("words").alias("words"),
        F.count(F.lit(1)).alias("chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    return found.where(F.col("words") >= min_words).select("doc_id", "text_key", "start", "end", "words", "chunks", "first_doc_id")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text): texts without the passages that a document of a smaller doc_id holds too, a row for each input row."""
    found = stored(repeated_passages(docs, min_words, later_only=True))
    cuts = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "cuts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"), F.xxhash64("text").alias("text_key"))
    rows = rows.join(cuts, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    data = F.col("data")

    def piece(cut, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["end"])
        return F.substring(data, before + 1, cut["start"] - before).cast("string")

    rest = F.substring(data, F.element_at("cuts", -1)["end"] + 1, F.octet_length(data)).cast("string")
    kept = F.concat(F.array_join(F.transform("cuts", piece), ""), rest)
    return rows.select("doc_id", F.when(F.col("cuts").isNull(), data.cast("string")).otherwise(kept).alias("text"))


def op8_substring(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "end", "words", "chunks", "first_doc_id")
