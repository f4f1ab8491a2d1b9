import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id as lid
from tests.conftest import SF
from tests.llm.helpers import documents, empty


@pytest.fixture(scope="module")
def held_out(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    return docs, lid.fit(docs)


def test_held_out_accuracy_and_calibration(spark, held_out):
    docs, model = held_out
    got = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    kept = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if r.held_out) == sorted(kept)
    right = np.array([got[i].lang_pred == truth[i] for i in kept])
    assert right.mean() > 0.98 and abs(np.mean([got[i].score for i in kept]) - right.mean()) < 0.05
    assert all(0 <= r.score <= 1 for r in got.values())


def test_the_model_is_sparse_and_reruns_agree(held_out):
    docs, model = held_out
    assert (model.weights == 0).mean() > 0.4
    again = lid.fit(docs)
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature


def test_odd_rows(spark, held_out):
    got = lid.identify(documents(spark), held_out[1]).collect()
    assert len(got) == 14
    assert {(r.doc_id, r.lang_pred) for r in got if r.lang_pred == "und"} == {(3, "und"), (4, "und"), (5, "und"), (7, "und"), (None, "und")}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert len([r for r in got if r.doc_id == 6]) == 2


def test_without_labels_and_without_rows(spark):
    assert lid.fit(empty(spark)) is None
    assert lid.identify(empty(spark), None).count() == 0
    unlabelled = documents(spark, [(1, "some words", None, "a")])
    assert lid.fit(unlabelled) is None
    assert lid.identify(unlabelled, None).first().lang_pred == "und"
    one = documents(spark, [(1, "some words", "xx", "a"), (3, "", "xx", "a")])
    assert lid.identify(one, lid.fit(one)).first().lang_pred == "xx"


def test_slices_change_nothing(monkeypatch):
    text = ("Größe und Maß ΣΑΣ İ 日本\t" * 300).encode()
    whole = lid.features(text)
    monkeypatch.setattr(lid, "SLICE", 97)
    part = lid.features(text)
    assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])


def plain_features(text):
    """N-grams of code points by slicing, hashed with Python's integers."""
    lower, found, full = "".join(" " if 9 <= ord(c) <= 13 else c for c in text.lower()), Counter(), (1 << 64) - 1
    for n in lid.ORDERS:
        for i in range(len(lower) - n + 1):
            key = 0
            for c in lower[i : i + n]:
                key = (key * lid.STEP + ord(c)) & full
            key = (key + n * lid.ORDER) * lid.MIX & full
            key ^= key >> 31
            found[(key * lid.LAST & full) >> 49] += 1
    return found


TEXTS = ["Das Maß ist voll", "ÇA VA été", "日本語のテキスト", "Ελλάδα ΣΑΣ", "Привет, мир!", "a\tb\nc", "x", "𝒳𝒴 𝒳", "ab" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_features_by_definition(text):
    at, counts = lid.features(text.encode())
    assert dict(zip(at.tolist(), counts.tolist())) == plain_features(text)
    assert lid.features(text.upper().encode())[0].tolist() == lid.features(text.upper().lower().encode())[0].tolist()


def test_training_by_a_plain_reading(spark):
    """TF-IDF, FTRL-proximal with elastic net and the temperature, by loops over dictionaries."""
    r = np.random.default_rng(4)
    vocabulary = {"aa": "das und ist nicht ein".split(), "bb": "the and is not one".split(), "cc": "это не так мир да".split()}
    rows = [(i, " ".join(r.choice(vocabulary[g], 6)), g, "s") for i, g in enumerate(list(vocabulary) * 12)] + [(400, "the und", None, "s"), (401, None, "aa", "s")]
    docs = documents(spark, rows)
    model = lid.fit(docs)
    learned = docs.where(~lid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text"), "lang", "text").collect()
    learned = sorted((p, g, t) for p, g, t in learned)
    counts = [plain_features(t) for _, _, t in learned]
    frequency = Counter(f for c in counts for f in c)
    idf = lambda f: math.log((1 + len(learned)) / (1 + frequency[f])) + 1
    examples = []
    for (_, g, _), c in zip(learned, counts):
        x = {f: (1 + math.log(n)) * idf(f) for f, n in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        examples.append(({f: v * lid.SCALE / length for f, v in x.items()} | {"bias": 1.0}, sorted(vocabulary).index(g)))
    z, n = Counter(), Counter()

    def weight(f, k):
        a, b = z[f, k], n[f, k]
        return 0.0 if abs(a) <= lid.L1 else -(a - math.copysign(lid.L1, a)) / ((lid.BETA + math.sqrt(b)) / lid.ALPHA + lid.L2)

    for _ in range(lid.PASSES):
        for i, (x, y) in enumerate(examples):
            if i % 4 == 0:
                continue
            w = {(f, k): weight(f, k) for f in x for k in range(3)}
            s = [sum(v * w[f, k] for f, v in x.items()) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(3):
                error = e[k] / sum(e) - (k == y)
                for f, v in x.items():
                    g = v * error
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / lid.ALPHA * w[f, k]
                    n[f, k] += g * g
    assert model.languages == sorted(vocabulary)
    for k in range(3):
        assert model.bias[k] == pytest.approx(weight("bias", k), abs=1e-9)
        assert all(model.weights[f, k] == pytest.approx(weight(f, k), abs=1e-9) for f in frequency)
    assert (model.weights[[f for f in range(lid.BUCKETS) if f not in frequency]] == 0).all()

    def loss(t):
        total = 0.0
        for x, y in examples[::4]:
            s = [sum(v * weight(f, k) for f, v in x.items()) / t for k in range(3)]
            total += math.log(sum(math.exp(v - max(s)) for v in s)) + max(s) - s[y]
        return total

    assert loss(model.temperature) == pytest.approx(min(map(loss, np.geomspace(0.05, 20, 121))), abs=1e-9)


def test_the_sample_is_bounded_whatever_the_copies(spark):
    """Equal rows count once; the first by hash are taken, as many as are asked for."""
    rows = [(None, "one and the same text", "en", "a")] * 300 + [(i, f"text {i}", "en", "a") for i in range(500)] + [(i, "kurz", "de", "a") for i in range(5)]
    labelled = documents(spark, rows).select(F.xxhash64("doc_id", "text").alias("place"), "lang", "text")
    got = lid.sample(labelled, 100)
    assert dict(got.groupBy("lang").count().collect()) == {"en": 100, "de": 5}
    unsigned = lambda r: r.place % (1 << 64)
    wanted = sorted({unsigned(r) for r in labelled.where("lang = 'en'").collect()})[:100]
    assert sorted(unsigned(r) for r in got.where("lang = 'en'").collect()) == wanted


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lid.op1_language(spark, sf_dir).collect()
    model = lid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred, r.score) == (model.predict(texts[r.doc_id].encode()) if lettered else ("und", 0.0))
