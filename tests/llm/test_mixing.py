import hashlib


from factloom.llm import mixing
from tests.llm.helpers import documents, empty, prose, words
from tests.oracle import assert_equal, connect


def water_fill(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / w for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = water_fill(sizes)
    by_id = {}
    for i, text, _, source in rows:
        by_id.setdefault(i, []).append((len(words(text)), source))
    assert len(got) == len(rows)
    spent = dict.fromkeys(sizes, 0)
    for r in got:
        source = next(s for n, s in by_id[r.doc_id] if sizes[s] == r.source_size and n == r.size and abs(target[s] - r.target) < 1e-6)
        assert r.taken <= 3 * r.size
        spent[source] += r.taken
    for s, n in spent.items():
        assert int(target[s]) - n <= 3 and n <= target[s] + 1e-6
    assert sorted(map(str, mixing.mix(documents(spark, rows)).collect())) == sorted(map(str, got))


def test_odd_rows(spark):
    check(spark, [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark).collect()])
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_hot_and_small_sources(spark):
    rows = [(i, prose(i, 20 + i % 90), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(1000, "tiny words", "en", None)]
    check(spark, rows)


def test_equals_duckdb(spark, sf_dir):
    assert_equal(mixing.op5_mixing(spark, sf_dir), connect(sf_dir), mixing.ORACLE)


def test_the_cut_is_exact(spark):
    rows = [(i, prose(i, 50), "en", s) for s in "abc" for i in range(ord(s) * 100, ord(s) * 100 + 40)]
    got = mixing.mix(documents(spark, rows)).collect()
    spent = {}
    for r in got:
        spent[r.target] = spent.get(r.target, 0) + r.taken
    assert all(int(t) == n for t, n in spent.items())


def test_documents_of_the_mix(spark):
    rows = [(i, prose(i, 30 + i % 11), "en", "abc"[i % 3]) for i in range(90)]
    taken = {r.doc_id: r.taken for r in mixing.mix(documents(spark, rows)).collect()}
    got = mixing.mixed_documents(documents(spark, rows))
    assert got.columns == documents(spark).columns
    seen = dict.fromkeys(taken, 0)
    text = {i: t for i, t, *_ in rows}
    for r in got.collect():
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        seen[r.doc_id] += len(words(r.text))
    assert seen == taken
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_keys_are_hash_random(spark):
    row = documents(spark, [(5, "x", "en", "a")]).select(mixing.key_of(*[__import__("pyspark").sql.functions.col(c) for c in ("doc_id", "text")])).first()[0]
    assert row == hashlib.md5(b"5").hexdigest() + hashlib.md5(b"x").hexdigest()
