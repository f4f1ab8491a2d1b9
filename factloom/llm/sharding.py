"""Sharding by extendible hashing, with DataFrame functions alone.

A row's hash is 60 bits of the MD5 of its id. The directory is indexed by prefixes of it: a bucket of depth d
holds the rows of one d-bit prefix, and only a bucket above the byte limit splits on another bit. Byte sums
are taken once for prefixes of a fine depth (partial aggregation) and rolled up, so all splits of that many
bits are decided in one pass over a table of prefixes; cells that are still too large go on to deeper bits.
Rows that no bit tells apart (one id, repeated) fill overflow pages of the byte limit by running sums over a hash of each
row's id and text. Rows that agree in both are interchangeable: as many of them lie on each page whatever the order of
reading, and they are numbered in parts, so an id and text that make up a third of all rows are no single task.

Defined results: a null text has 0 bytes; a null id hashes as the empty text; a row larger than the limit is a shard of its
own, as are texts of any length; repeated rows keep a row each; ties on a page's edge go by the row's hash; an empty table
gives an empty result; columns besides doc_id and text are ignored, whatever their names. The rows' shards and pages are the
same whatever the order of reading.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import checkpointed

SHARD_BYTES, HASH_BITS = 64 << 20, 60
#: Byte limit of the registered query: small, so that buckets split at every size of its table.
QUERY_BYTES = 64 << 10
#: Bits decided in one pass beyond what evenly filled shards would need.
SPARE_BITS = 4
#: Parts in which rows of one hash are summed and numbered.
PARTS = 4096


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    """The leading bits of a hash as a number."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - (depth if isinstance(depth, Column) else F.lit(depth))).cast("int"))


def _settle(rows: DataFrame, shallow: int, deep: int, limit: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(leaves as prefix at depth ``deep`` with their own depth and bytes, cells of depth ``deep`` still too large).

    A leaf is a bucket that fits and whose parent doesn't; the two halves of a parent are one row of the aggregate, so it has
    both sums and no table meets itself. Cells meet their leaf among the depths that leaves have: at those a bucket holds few
    cells, whereas at depth 0 all of them would be one key of the join. Only the two tables that are read again are written.
    """
    cells = checkpointed(rows.groupBy(prefix(F.col("h"), deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes")).coalesce(parts))
    depth = F.explode(F.sequence(F.lit(shallow), F.lit(deep)))
    at_depth = cells.select("cell", "bytes", depth.alias("depth")).withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")))
    half = lambda bit: F.sum(F.when(F.col("bucket") % 2 == bit, F.col("bytes")))
    parents = at_depth.groupBy("depth", F.call_function("shiftright", F.col("bucket"), F.lit(1)).alias("parent")).agg(half(0).alias("low"), half(1).alias("high"))
    halves = F.explode(F.array(*[F.struct((F.col("parent") * 2 + bit).alias("bucket"), F.col(name).alias("bytes")) for bit, name in enumerate(("low", "high"))]))
    split = (F.col("depth") == shallow) | (F.coalesce("low", F.lit(0)) + F.coalesce("high", F.lit(0)) > limit)
    buckets = parents.where(split).select("depth", halves.alias("half")).select("depth", "half.bucket", F.col("half.bytes").alias("shard_bytes"))
    leaves = checkpointed(buckets.where(F.col("shard_bytes") <= limit).coalesce(parts))
    least = leaves.agg(F.coalesce(F.min("depth"), F.lit(deep))).first()[0]
    placed = at_depth.where(F.col("depth") >= least).join(leaves, ["depth", "bucket"]).select("cell", "depth", "bucket", "shard_bytes")
    return placed, cells.where(F.col("bytes") > limit).select("cell")


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, bucket, page, shard_bytes), a row for each input row.

    Tables of prefixes and the result come in as many parts as the input at most: they are small beside its texts, and a part
    of a shuffle each would be thousands of small files.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id"), size.alias("n_bytes"), hash_of(F.col("doc_id")).alias("h"), F.xxhash64("doc_id", "text").alias("r"))
    rows = checkpointed(rows)
    parts = max(1, rows.rdd.getNumPartitions())
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    step = max(1, math.ceil(math.log2(max(2.0, total / limit))) + SPARE_BITS)
    shallow, out, rest = 0, None, rows
    while True:
        deep = min(HASH_BITS, shallow + step)
        leaves, large = _settle(rest, shallow, deep, limit, parts)
        placed = rest.withColumn("cell", prefix(F.col("h"), deep)).join(leaves, "cell").select("doc_id", "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"), "shard_bytes")
        out = placed if out is None else out.unionByName(placed)
        if large.isEmpty():
            return out.coalesce(parts)
        rest = checkpointed(rest.join(large, prefix(F.col("h"), deep) == F.col("cell"), "left_semi"))
        if deep == HASH_BITS:
            return out.unionByName(_pages(rest, limit)).coalesce(parts)
        shallow, step = deep + 1, min(step, HASH_BITS - deep)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash that exceed the limit together: pages by running sums.

    Groups of equal rows are ordered by a hash of their content, and their sums are taken in salted parts first; the rows of
    a group are numbered in parts too. No window is larger than the number of parts or the rows of one part.
    """
    content, size = ["h", "r", "n_bytes"], F.greatest("n_bytes", F.lit(1))
    dealt = checkpointed(rows.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS))))
    counts = checkpointed(dealt.groupBy(*content, "deal").agg(F.count(F.lit(1)).alias("n")))
    groups = counts.groupBy(*content).agg(F.sum(F.col("n") * size).alias("bytes")).withColumn("salt", F.pmod("r", F.lit(PARTS)))
    groups = checkpointed(groups)
    parts = groups.groupBy("h", "salt").agg(F.sum("bytes").alias("part"))
    parts = parts.select("h", "salt", (F.sum("part").over(Window.partitionBy("h").orderBy("salt")) - F.col("part")).alias("before"))
    own = F.sum("bytes").over(Window.partitionBy("h", "salt").orderBy("r", "n_bytes")) - F.col("bytes")
    starts = groups.withColumn("own", own).join(parts, ["h", "salt"]).select(*content, (F.col("own") + F.col("before")).alias("start"))
    first = F.sum("n").over(Window.partitionBy(*content).orderBy("deal")) - F.col("n")
    starts = counts.withColumn("first", first).join(starts, content).select(*content, "deal", (F.col("start") + F.col("first") * size).alias("start"))
    number = F.row_number().over(Window.partitionBy(*content, "deal").orderBy("doc_id")) - 1
    placed = dealt.withColumn("number", number).join(starts, [*content, "deal"])
    # Every second page takes the rows that begin in one half-limit and end in the next, so no page passes the limit
    # unless a single row does.
    begin = F.col("start") + F.col("number") * size
    half = max(1, limit // 2)
    big = F.col("n_bytes") > half
    page = F.when(big, begin * 2 + 2).otherwise(F.floor(begin / half) * 2 * half + 1)
    paged = placed.select("doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("bucket"), page.cast("long").alias("page"))
    sums = paged.groupBy("bucket", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(sums, ["bucket", "page"]).select("doc_id", "n_bytes", "depth", "bucket", "page", "shard_bytes")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_BYTES)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
at_depth AS (SELECT *, h >> CAST({HASH_BITS} - depth AS BIGINT) AS bucket FROM sized, range(0, 25) t(depth)),
sums AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM at_depth GROUP BY depth, bucket),
fit AS (SELECT a.doc_id, a.n_bytes, a.depth, a.bucket, s.shard_bytes, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.depth) AS place
        FROM at_depth a JOIN sums s ON a.depth = s.depth AND a.bucket = s.bucket WHERE s.shard_bytes <= {QUERY_BYTES})
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, bucket, CAST(0 AS BIGINT) AS page, shard_bytes FROM fit WHERE place = 1
"""
