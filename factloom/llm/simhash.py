"""SimHash near-duplicates with covering locality-sensitive hashing.

A document's fingerprint has a bit set where over half of its word shingles' XXH64 values have it set.
Two fingerprints link at ``RADIUS`` or fewer differing bits; a component is what links reach.

Candidate search is exact. The 64 bits are cut into six blocks and every choice of three blocks is a
mask (20 tables): three differing bits lie in at most three blocks, so some choice of three others
agrees entirely and the pair meets in that table. Distinct fingerprints alone are hashed (copies have
collapsed), a bucket yields a spanning star for each of its linked parts and never its pairs. A bucket
above ``BUCKET`` fingerprints is dealt again: its 32 free bits are cut into eight blocks of four and the
pairs meet in one of 56 masks that fix five of them, so what is left has at most 2**12 members.

The sizes of buckets are counted by partial sums and joined back, so a bucket that holds a third of all fingerprints is
split like any skewed join before it is dealt again.

Defined results: null text counts as empty; no word gives fingerprint zero, which links like any
other; fewer words than a shingle give one shingle of them all; texts of any length are hashed whole; repeated rows keep a
row each; a doc_id with several texts has a fingerprint for each and links through all of them; a null
doc_id keeps its row, and component_id is the smallest non-null doc_id reachable (null if there is none).
An empty table gives an empty result. Other columns of the input are ignored by the query, whatever their names, and passed
on by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, checkpointed, raw_bytes, text_bytes
from factloom.llm.components import connected_components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
BUCKET = 16_384
BLOCK = 1 << 16


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(positions: list[int], parts: int) -> list[int]:
    """Masks of consecutive, nearly equal parts of the given bit positions."""
    ends = [round(len(positions) * i / parts) for i in range(parts + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(ends, ends[1:])]


_BLOCKS = _cut(list(range(BITS)), 2 * RADIUS)
#: Every choice of three of the six blocks.
TABLES = [sum(_BLOCKS[i] for i in chosen) for chosen in combinations(range(2 * RADIUS), RADIUS)]
#: For each table, the masks that also fix five of eight parts of its free bits.
FINER = [
    [mask | sum(part[i] for i in chosen) for chosen in combinations(range(8), 8 - RADIUS)]
    for mask in TABLES
    for part in [_cut([p for p in range(BITS) if not mask >> p & 1], 8)]
]


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of a text's UTF-8 bytes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.nonzero(2 * ones > len(starts))[0].tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(bytes(x)) for x in raw_bytes(batch.column(0))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])


def _fingerprinted(docs: DataFrame, text_col: str, columns: dict[str, tuple[Column, str]]) -> DataFrame:
    """(fp, ...) of each row, with further (column, type) by name, checkpointed."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(text_bytes(text_col).alias("__text"), *[c.cast(kind).alias(name) for name, (c, kind) in columns.items()])
    return checkpointed(rows.mapInArrow(_fingerprints, ", ".join(["fp long", *(f"{name} {kind}" for name, (_, kind) in columns.items())])))


def stars(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for every linked part of a bucket: each unseen member is reached once, so the work
    shrinks with what is already linked and no pair is listed."""
    left = np.sort(members)
    found, centres = [], []
    while len(left) > 1:
        centre, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(frontier), 64):
                rest = np.nonzero(~near)[0]
                differing = np.bitwise_count(left[rest][None, :] ^ frontier[at : at + 64, None])
                near[rest[(differing <= RADIUS).any(axis=0)]] = True
            frontier, left = left[near], left[~near]
            found.append(frontier)
            centres.append(np.full(len(frontier), centre))
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(found or [empty]), np.concatenate(centres or [empty])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the buckets in a partition sorted by (t, key); a bucket may run over several batches."""
    held = [np.zeros(0, dtype=np.int64)] * 3

    def stars_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        t, key, fp = columns
        edges = np.nonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))[0] + 1
        both = [stars(part.view(np.uint64)) for part in np.split(fp, edges) if len(part) > 1]
        empty = np.zeros(0, dtype=np.uint64)
        a, b = (np.concatenate([x[i] for x in both] or [empty]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate([old, np.asarray(batch.column(i), dtype=np.int64)]) for i, old in enumerate(held)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        start = len(last) - int(last.sum())
        held = [x[start:] for x in now]
        if start:
            yield stars_of([x[:start] for x in now])
    if len(held[0]):
        yield stars_of(held)


def _bucket_links(rows: DataFrame) -> DataFrame:
    return rows.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_links, "a long, b long")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Star links (a, b) that connect exactly what the pairs within the radius among distinct ``fp`` connect."""
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(TABLES)])
    dealt = nodes.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.key")
    sizes = checkpointed(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = checkpointed(dealt.join(sizes, ["t", "key"]).select("fp", "t", "key", "n"))
    out = _bucket_links(shared.where(F.col("n") <= bucket))
    large = shared.where(F.col("n") > bucket)
    if not large.isEmpty():
        masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in finer]) for finer in FINER])
        finer = large.select("t", "key", "fp", F.posexplode(F.element_at(masks, F.col("t").cast("int") + 1)).alias("i", "mask"))
        finer = finer.select((F.col("t") * 100 + F.col("i") + 1000).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        out = out.unionByName(_bucket_links(finer))
    return out.distinct()


def roots(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The distinct fingerprints ``fp`` of a table with their other columns and ``root``, a fingerprint that names the component."""
    nodes = checkpointed(nodes)
    found = connected_components(links(nodes.select("fp"), bucket)).select(F.col("node").alias("fp"), F.col("root").alias("__root"))
    return nodes.join(found, "fp", "left").withColumn("root", F.coalesce("__root", "fp")).drop("__root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id), a row for each input row."""
    rows = _fingerprinted(docs, text_col, {"doc_id": (F.col(id_col), "long")})
    nodes = roots(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), bucket)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of each component: the first by doc_id (null last), then by a digest of the text, then by the row's JSON.

    The rows' choice is a minimum by fingerprint and then by component, so a component of any size is partial minima only.
    Rows that agree in doc_id and text are told apart by a minimum over their JSON form; equal rows are interchangeable.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("digest"))
    digest = F.md5(text_bytes())
    rows = _fingerprinted(docs, "text", {"doc_id": (F.col("doc_id"), "long"), "digest": (digest, "string")})
    nodes = roots(rows.groupBy("fp").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("rows")), bucket)
    first = checkpointed(nodes.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.doc_id").alias("__id"), F.col("place.digest").alias("__digest")))
    same = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.md5(text_bytes("__row.text")) == F.col("__digest"))
    stay = docs.select(F.struct("*").alias("__row")).join(first, same)
    # Rows that agree in doc_id and text are seldom; only they are aggregated, the others pass by.
    again = checkpointed(rows.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).count().where("count > 1").select("__id", "__digest", F.lit(True).alias("__again")))
    if again.isEmpty():
        return stay.select("__row.*")
    both = F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__digest") == F.col("b.__digest"))
    once = stay.alias("a").join(again.alias("b"), both, "left_anti").select("__row")
    several = stay.alias("a").join(again.alias("b"), both, "left_semi")
    chosen = several.groupBy("__id", "__digest").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return once.unionByName(chosen.select("__row")).select("__row.*")
