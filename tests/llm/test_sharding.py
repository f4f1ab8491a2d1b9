import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.llm import sharding
from tests.conftest import SF
from tests.llm.helpers import documents, empty, prose
from tests.oracle import assert_equal, connect


def split(rows, limit, depth=0, path=0):
    """Extendible hashing by hand: an oversized bucket splits on its next bit."""
    if sum(n for _, n in rows) <= limit or depth == sharding.HASH_BITS:
        return [(depth, path, rows)] if rows else []
    bit = lambda h: h >> (sharding.HASH_BITS - depth - 1) & 1
    return [x for b in (0, 1) for x in split([r for r in rows if bit(r[0]) == b], limit, depth + 1, path * 2 + b)]


def hashed(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("limit", [500, 3000, 20_000, 10_000_000])
def test_equals_splitting_by_hand(spark, limit):
    rows = [(i, prose(i, 5 + i % 40), "en", "a") for i in range(300)]
    got = sharding.assign(documents(spark, rows), limit).collect()
    wanted = split([(hashed(i), len(t.encode())) for i, t, *_ in rows], limit)
    place = {h: (d, p, sum(n for _, n in part)) for d, p, part in wanted for h, _ in part}
    assert len(got) == 300
    assert all((r.depth, r.bucket, r.shard_bytes) == place[hashed(r.doc_id)] and r.page == 0 and r.shard_bytes <= limit for r in got)


def test_rows_no_bit_tells_apart(spark):
    rows = [(7, "x" * (10 + i), "en", "a") for i in range(60)] + [(8, "y" * 900, "en", "a"), (9, None, "en", "a")]
    got = sharding.assign(documents(spark, rows), 200).collect()
    assert len(got) == len(rows) and sum(r.n_bytes for r in got) == sum(len(t or "") for _, t, *_ in rows)
    shards = {}
    for r in got:
        shards.setdefault((r.depth, r.bucket, r.page), []).append(r.n_bytes)
        assert r.shard_bytes <= 200 or r.n_bytes > 200
    assert all(sum(v) <= 200 or len(v) == 1 for v in shards.values())
    assert len(shards) < 60


def test_pages_agree_whatever_the_order_of_reading(spark):
    rows = [(7, "x" * (1 + i % 37) + str(i % 50), "en", "a") for i in range(400)] + [(7, "same text", "en", "b")] * 300 + [(None, None, "en", "c")] * 20
    docs = documents(spark, rows)
    found = [sorted((str(r.doc_id), r.n_bytes, r.bucket, r.page, r.shard_bytes) for r in sharding.assign(d, 200).collect()) for d in (docs.repartition(1), docs.repartition(5), docs.orderBy(F.rand(3)), docs.repartition(3, "text"))]
    assert len(found[0]) == len(rows) and all(x == found[0] for x in found)


def test_odd_rows(spark):
    assert sharding.assign(documents(spark), 1000).count() == 14
    assert sharding.assign(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_duckdb(spark, sf):
    folder = SF.replace("0.001", sf)
    got = sharding.op3_sharding(spark, folder)
    assert_equal(got, connect(folder), sharding.ORACLE)
    assert got.select("depth", "bucket").distinct().count() >= 8


def test_small_tables_are_few_files(spark):
    """What is written between the passes follows the parts of the input, not those of a shuffle."""
    docs = documents(spark, [(i, prose(i, 5 + i % 40), "en", "a") for i in range(300)]).repartition(2)
    wanted = sorted(sharding.assign(docs, 500).collect())
    assert len({(r.depth, r.bucket) for r in wanted}) > 50
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = lambda: set(folder.rglob("part-*"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        before = files()
        got = sharding.assign(docs, 500)
        written = files() - before
        assert sorted(got.collect()) == wanted
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(written) <= 12


@pytest.mark.parametrize("cut", ["limit", "where", "parts"])
def test_nothing_to_deal(spark, cut):
    docs = documents(spark)
    none = {"limit": lambda: docs.limit(0), "where": lambda: docs.where("false"), "parts": lambda: spark.createDataFrame(spark.sparkContext.emptyRDD(), docs.schema)}[cut]()
    assert sharding.assign(none).count() == 0
