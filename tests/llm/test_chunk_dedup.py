from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import chunk_dedup as cd
from tests.llm.helpers import documents, empty, prose


def slow_gear(data):
    return [sum(int(cd.GEAR[data[i - age]]) << age for age in range(min(i + 1, 32))) % (1 << 32) for i in range(len(data))]


def slow_boundaries(data):
    h, n = slow_gear(data), len(data)
    if n <= cd.REACH:
        return [n] if n else []
    ends, last = [], -cd.REACH
    for i in range(cd.REACH, n - 1):
        if all(h[i] <= h[j] for j in range(max(0, i - cd.REACH), min(n, i + cd.REACH + 1))) and i + 1 - last > cd.REACH:
            ends.append(last := i + 1)
    return [*ends, n]


@pytest.mark.parametrize("n", [0, 1, 24, 25, 60, 500, 3000])
def test_boundaries_by_definition(n):
    data = np.random.default_rng(n).integers(97, 110, n, dtype=np.uint8).tobytes()
    if n:
        assert cd.gear(np.frombuffer(data, dtype=np.uint8)).tolist() == slow_gear(data)
    assert cd.boundaries(data).tolist() == slow_boundaries(data)


@pytest.mark.parametrize("phrase", ["x", "Heat ", "Erberte Erb, ", "twenty four bytes long, "])
def test_repeated_phrases_are_cut_alike_wherever_they_begin(phrase):
    stretch = (phrase * 400).encode()
    inside = []
    for lead in (b"", b"some other beginning ", prose(5, 40, None).encode(), prose(6, 71, None).encode()):
        data = lead + stretch + b" and an end of its own"
        assert cd.boundaries(data[:900]).tolist() == slow_boundaries(data[:900])
        start, end = cd.chunks(data)
        inside.append({data[a:b] for a, b in zip(start, end) if a > len(lead) + 60 and b < len(lead) + len(stretch)})
    assert all(x == inside[0] and len(x) == 1 for x in inside)


def test_chunks_are_whole_characters():
    data = "".join(chr(0x3040 + i * i % 90) + "é𝒳"[i % 2] for i in range(900)).encode()
    start, end = cd.chunks(data)
    assert b"".join(data[a:b] for a, b in zip(start, end)) == data and len(end) > 50
    for a, b in zip(start, end):
        data[a:b].decode()


def test_insertions_move_nothing_beyond_their_surroundings():
    data = prose(1, 3000, None).encode()
    changed = data[:5000] + b"inserted" + data[5000:]
    a, b = cd.boundaries(data), cd.boundaries(changed)
    assert set(a[a < 5000 - 60].tolist()) <= set(b.tolist())
    assert set((a[a > 5000 + 60] + 8).tolist()) <= set(b.tolist())
    assert 30 < np.diff(a).mean() < 80 and np.diff(a)[:-1].min() > cd.REACH


def flagged(spark, rows, **more):
    return cd.repeated_passages(documents(spark, rows), **more).collect()


def test_planted_passages(spark):
    passage = prose(77, 55, None)
    rows = [(i, f"{prose(i, 30, None)} {passage} {prose(500 + i, 45, None)}", "en", "a") for i in range(4)]
    rows += [(100 + i, prose(1000 + i, 200, None), "en", "a") for i in range(30)]
    got = flagged(spark, rows)
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and {r.first_doc_id for r in got} == {0}
    text = {i: t for i, t, *_ in rows}
    for r in got:
        part = text[r.doc_id].encode()[r.start : r.end].decode()
        assert part in passage and len(part) > 0.6 * len(passage)


def test_every_long_repeat_of_the_table_is_caught(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def holders(n):
        seen = defaultdict(set)
        for i, text in docs.items():
            w = text.split()
            for k in range(len(w) - n + 1):
                seen[tuple(w[k : k + n])].add(i)
        return {i for s in seen.values() if len(s) > 1 for i in s}

    got = {r.doc_id for r in cd.op8_substring(spark, sf_dir).collect()}
    assert holders(51) <= got <= holders(20)


def test_odd_rows(spark):
    assert cd.repeated_passages(empty(spark)).count() == 0
    got = cd.repeated_passages(documents(spark)).collect()
    assert got == []  # the only shared text is 14 words; one document's repeats, a repeated row and rows without an id don't count
    both = flagged(spark, [(1, prose(3, 90, None), "en", "a"), (1, prose(3, 90, None), "en", "a"), (None, prose(3, 90, None), "en", "a")])
    assert both == []


def test_texts_without_repeats(spark):
    passage = prose(77, 80, None)
    rows = [(1, passage, "en", "a"), (2, f"{prose(8, 40, None)} {passage} {prose(9, 40, None)}", "en", "a"), (3, "short", "en", "a"), (4, None, "en", "a")]
    got = {r.doc_id: r.text for r in cd.without_repeats(documents(spark, rows)).collect()}
    assert got[1] == passage and got[3] == "short" and got[4] is None
    assert len(got[2]) < len(rows[1][1]) - 0.6 * len(passage) and got[2].startswith(prose(8, 40, None)[:100]) and got[2].endswith(prose(9, 40, None)[-100:])


def test_one_id_with_different_texts(spark):
    """The texts of one doc_id are cut and reported apart; equal rows are one."""
    p = prose(41, 60, None)
    around = [f"{prose(42 + i, 30, None)} {p} {prose(52 + i, 30, None)}" for i in range(2)]
    rows = [(1, p, "en", "a"), (2, around[0], "en", "a"), (2, prose(99, 80, None), "en", "a"), (2, around[1], "en", "a"), (2, around[1], "en", "a")]
    for n in (1, 4):
        got = cd.repeated_passages(documents(spark, rows).repartition(n)).collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 2] and len({r.text_key for r in got}) == 3
        assert all(any(t.encode()[r.start : r.end].decode() in p for t in around) for r in got if r.doc_id == 2)
    left = sorted(r.text for r in cd.without_repeats(documents(spark, rows)).where("doc_id = 2").collect())
    assert len(left) == 4 and prose(99, 80, None) in left
    assert all(len(t) < len(around[0]) - 0.5 * len(p) for t in left if t != prose(99, 80, None))
