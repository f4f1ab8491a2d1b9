import hashlib
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
from factloom.llm import bpe, mixing, quality
from factloom.llm.common import shared_folder
from tests.llm.helpers import LONG, documents, empty, prose, words
from tests.llm.test_scans import PII, plain
from tests.llm.test_simhash import components, plain_fingerprint


def run_stages(spark, docs, folder):
    """Each stage's rows, written and read again as the driver does."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = run_stages(spark, docs, tmp_path)
    before = docs
    tables = {}
    for name, after in stages:
        tables[name] = (before.collect(), after.collect())
        if name != "encoding":
            assert after.columns == docs.columns
        before = after
    given, kept = tables["quality_rules"]
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if verdict[r.doc_id]}
    text = {r.doc_id: r.text for r in given}
    assert all(r.text == text[r.doc_id] for r in kept)

    given, kept = tables["near_duplicates"]
    fp = {r.doc_id: plain_fingerprint(r.text) for r in given}
    roots, least = components(list(fp.values())), {}
    for i, f in fp.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())

    given, kept = tables["personal_data"]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given)
    after = {r.doc_id: r for r in kept}
    for r in given:
        assert plain(PII, after[r.doc_id].text) == "" or "[" not in after[r.doc_id].text
        if not plain(PII, r.text):
            assert after[r.doc_id].text == r.text
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    given, kept = tables["mixture"]
    taken = {r.doc_id: r.taken for r in mixing.mix(stages[2][1]).collect()}
    spent = Counter()
    for r in kept:
        spent[r.doc_id] += len(words(r.text))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in spent.items() if n}

    given, kept = tables["encoding"]
    own = bpe.tokenizer(bpe.default_vocabulary())
    wanted = Counter()
    for r in given:
        ids = own.encode(r.text)
        wanted[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in kept) == wanted
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, kept))


def test_odd_rows(spark, tmp_path):
    """Repeated ids and rows, nulls in every column, empty and long texts, ties and clashing column names, stage by stage."""
    p = [prose(i, 60 + i) for i in range(6)]
    rows = [
        (1, p[0], "en", "a"), (1, p[1], "en", "a"), (1, p[1], "en", "a"), (2, p[0], "en", "b"), (None, p[2], "en", "a"), (None, p[2], "en", None), (3, p[3], None, None),
        (4, "", "en", "a"), (5, None, None, None), (None, None, "en", "a"), (6, p[4] + " mail zq@mail.example.com", "en", "b"), (7, LONG, "zz", "a"), (8, prose(9, 30_000), "en", "a"), (9, "short", "en", "a"),
    ]
    docs = documents(spark, rows)
    out = dict(run_stages(spark, docs, tmp_path / "odd"))
    ids = lambda name: sorted((str(r.doc_id), r.text) for r in out[name].collect())
    long = rows[12][1]
    assert ids("quality_rules") == sorted((str(i), t) for i, t, *_ in rows if t and len(words(t)) >= 60 and t != LONG)
    assert ids("near_duplicates") == sorted([("1", p[0]), ("1", p[1]), ("None", p[2]), ("3", p[3]), ("6", rows[10][1]), ("8", long)])
    clean = p[4] + " mail [EMAIL]"
    assert ids("personal_data") == sorted([("1", p[0]), ("1", p[1]), ("None", p[2]), ("3", p[3]), ("6", clean), ("8", long)])
    plan = {(r.doc_id, r.size): r.taken for r in mixing.mix(out["personal_data"]).collect()}
    spent = Counter()
    size = {t: len(words(t)) for t in (clean, long, *p)}
    for r in out["mixture"].collect():
        whole = next(t for t in size if t.startswith(r.text[:200].rsplit(" ", 1)[0]))
        spent[r.doc_id, size[whole]] += len(words(r.text))
        assert r.n_chars == len(r.text) and (r.key, r.row, r.spans) == ("k", "r", "s")
    assert {k: v for k, v in plan.items() if v} == dict(spent) and plan[3, 63] > 0
    own = bpe.tokenizer(bpe.default_vocabulary())
    assert sorted((str(r.doc_id), r.n_tokens) for r in out["encoding"].collect()) == sorted((str(r.doc_id), len(own.encode(r.text))) for r in out["mixture"].collect())
    last = run_stages(spark, empty(spark), tmp_path / "empty")[-1][1]
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == 0


def test_stage_tables_go(spark, sf_dir):
    """Of a run's stage tables only the last is left."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    names = lambda: {x.name for x in folder.iterdir() if x.name.split("-")[0] in dict(corpus_pipeline.STAGES)}
    before = names()
    corpus_pipeline.run(spark, sf_dir).count()
    assert [x.split("-")[0] for x in names() - before] == [corpus_pipeline.STAGES[-2][0]]


def test_names():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and len({n for n, _ in corpus_pipeline.STAGES}) == len(corpus_pipeline.STAGES)
    assert all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)
