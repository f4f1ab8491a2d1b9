from itertools import combinations

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash
from tests.llm.helpers import documents, empty, words


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def check(spark, rows, **more):
    got = simhash.near_duplicates(documents(spark, rows), **more).collect()
    wanted = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), f) for i, f in wanted)
    roots = components([f for _, f in wanted])
    least = {}
    for i, f in wanted:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    assert all(r.component_id == least.get(roots[r.fp % (1 << 64)]) for r in got)
    return got


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark).collect()]
    got = check(spark, rows)
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fp == 0} == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text, r.lang, r.source) for r in docs])


def test_every_pair_within_the_radius_meets(spark):
    r = np.random.default_rng(5)
    for _ in range(2000):
        bits = r.choice(64, 3, replace=False)
        difference = sum(1 << int(b) for b in bits)
        met = [t for t, m in enumerate(simhash.TABLES) if not m & difference]
        assert met and all(any(not f & difference for f in simhash.FINER[t]) for t in met)
    assert all(m.bit_count() >= 31 for m in simhash.TABLES) and all(64 - m.bit_count() <= 13 for f in simhash.FINER for m in f)


@pytest.mark.parametrize("bucket", [4, 16_384])
def test_oversized_buckets_keep_every_link(spark, bucket):
    """A dense ball of fingerprints: links by buckets and by finer masks connect what the pairs connect."""
    r = np.random.default_rng(7)
    centre, values = 0x0123456789ABCDEF, set()
    while len(values) < 300:
        flips = r.choice(64, r.integers(0, 9), replace=False)
        values.add(centre ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket)
    found = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.connected_components(links).collect()}
    groups = {}
    for v in values:
        groups.setdefault(found.get(v, v), set()).add(v)
    wanted = {}
    for v, root in components(values).items():
        wanted.setdefault(root, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_of_each_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 7, 8, 9, 10, 11, None]))
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


A, B = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"


@pytest.mark.parametrize(
    "rows,wanted",
    [
        ([(5, A), (3, B), (5, B)], [(3, B), (5, A)]),
        ([(5, A), (5, B)], [(5, A), (5, B)]),
        ([(5, B), (5, B), (5, B), (None, B), (None, A)], [(5, B), (None, A)]),
        ([(None, A), (None, A)], [(None, A)]),
        ([(2, None), (1, ""), (1, " ")], [(1, "")]),
    ],
)
def test_repeated_ids_with_different_texts(spark, rows, wanted):
    """Rows are told apart by id and text: of each component one stays, whatever ids stand for."""
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs).collect()]
    if (1, "") in wanted:
        assert len(got) == 1 and got[0][0] == 1
    else:
        assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_rows_of_one_id_and_text_leave_the_same_row(spark):
    rows = [(1, A, "en", s) for s in ("c", "b", None, "b")] + [(2, B, "en", "z")]
    for n in (1, 3, 5):
        got = simhash.keep_one_of_each(documents(spark, rows).repartition(n)).collect()
        assert sorted((r.doc_id, r.source) for r in got) == [(1, None), (2, "z")]  # JSON leaves a null out


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = simhash.op2_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fp = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots, least = components(list(fp.values())), {}
    for i, f in fp.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    assert {tuple(r) for r in got.collect()} == {(i, f"{f:016x}", least[roots[f]]) for i, f in fp.items()}
