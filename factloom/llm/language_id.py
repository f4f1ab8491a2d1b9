"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams (one to four characters, that is code points, of the lower-cased text with ASCII white space as spaces) are hashed
to ``BUCKETS`` features. Document frequencies are counted over every training document. Weights are learned with
FTRL-proximal (elastic net) from a sample of at most ``PER_LANGUAGE`` documents of each language, the first by a hash of id
and text; a quarter of the sample is left out of learning and sets the softmax temperature. Whole texts are used throughout.
A feature's value is (1 + log tf) idf, scaled to unit length over the text, so a phrase repeated many times doesn't outweigh
the rest.

Defined results: ``und`` with score 0 for a null or empty text or one without a letter, and for every text when no
training document has a language; texts of any length are read whole, in slices; a null lang is not learned from; a null
doc_id is not held out; ties go to the first language by code point; rows pass one by one, repeated rows included, and equal
texts get equal predictions; an empty table gives an empty result; other columns are ignored, whatever their names. lang,
source and doc_id are never inputs of a prediction. The driver holds the sample's features, so the number of languages is
taken to be that of a label column, not of free text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bounded_batches, raw_bytes, spread, text_bytes

ORDERS, BUCKETS, PER_LANGUAGE = (1, 2, 3, 4), 1 << 15, 600
#: How many times the documents of a language's sample are ranked to choose it.
SPARE = 1.3
#: Length of a text's vector.
SCALE = 5.0
#: FTRL-proximal: learning rate, its smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.1, 0.01, 4
#: Characters hashed at once.
SLICE = 1 << 20
#: Fixed values of our hash: multipliers of a character, of the order and of the two mixing steps.
STEP, ORDER, MIX, LAST = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_SPACES = {c: " " for c in range(9, 14)}


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Feature numbers of a text's n-grams, with repeats, in slices of bounded size."""
    lower = text.decode("utf-8", "replace").lower().translate(_SPACES)
    data = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(ORDERS) - 1].astype(np.uint64)
        packed = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            ends = len(part) - n + 1
            if ends <= 0:
                break
            packed = packed[:ends] * np.uint64(STEP) + part[n - 1 :]
            if n in ORDERS:
                mixed = (packed + np.uint64(n * ORDER % (1 << 64))) * np.uint64(MIX)
                mixed ^= mixed >> np.uint64(31)
                yield (mixed * np.uint64(LAST) >> np.uint64(64 - BUCKETS.bit_length() + 1))[:SLICE].astype(np.intp)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, their counts) of a text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in ngrams(text):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.nonzero(counts)[0]
    return at, counts[at]


def values(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of a text's features, a vector of length ``SCALE``."""
    value = (1 + np.log(counts)) * idf[at]
    return value * (SCALE / max(1e-12, float(np.sqrt(value @ value))))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that have it) of a task; feature -1 counts the documents."""
    found, n = np.zeros(BUCKETS, dtype=np.int64), 0
    mark = np.zeros(BUCKETS, dtype=bool)
    for batch in batches:
        for raw in raw_bytes(batch.column(0)):
            mark[:] = False
            for part in ngrams(bytes(raw)):
                mark[part] = True
            found += mark
            n += 1
    at = np.nonzero(found)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], n), pa.int64())], names=["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [features(bytes(raw)) for raw in raw_bytes(batch.column(2))]
        at = pa.array([a.tolist() for a, _ in both], pa.list_(pa.int32()))
        counts = pa.array([c.tolist() for _, c in both], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, counts], names=["place", "lang", "at", "counts"])


@dataclass
class Model:
    languages: list[str]
    #: A row for each feature.
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, text: bytes) -> np.ndarray:
        at, counts = features(text)
        return values(at, counts, self.idf) @ self.weights[at] + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def train(rows: list[tuple], idf: np.ndarray) -> Model:
    """FTRL-proximal over (place, lang, features, counts), in order of place, then the temperature on the quarter left out."""
    languages = sorted({r[1] for r in rows})
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))
    label = {x: i for i, x in enumerate(languages)}
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))
    # The last row is the bias, a feature of its own.
    examples = []
    for _, lang, at, counts in rows:
        at = np.asarray(at, dtype=np.intp)
        examples.append((np.append(at, BUCKETS), np.append(values(at, np.asarray(counts), idf), 1.0), label[lang]))
    fit, held = [x for i, x in enumerate(examples) if i % 4], examples[::4]
    fit = fit or examples

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, value, y in fit:
            w = weights(z[at], n[at])
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    scores = np.array([value @ w[at] for at, value, _ in held]) if held else np.zeros((0, len(languages)))
    truth = np.array([y for _, _, y in held], dtype=int)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

    temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(truth) else 1.0
    return Model(languages, w[:BUCKETS], w[BUCKETS], idf, float(temperature))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, the first by ``place``; (place, lang, text) rows come in.

    Rows of one place are equal and count as one. Places are uniform, so the first are among those below ``SPARE`` times the
    share that would give as many; only these rows, a bounded number of each language, are ranked.
    """
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()
    if not sizes:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, SPARE * per_language / max(1, n))])
    fraction = F.shiftrightunsigned("place", 12).cast("double") / float(1 << 52)
    near = labelled.where(fraction < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "place"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place_order"))
    return near.withColumn("place_order", F.shiftrightunsigned("place", 1)).withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank", "place_order")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the labelled documents that are not held out; None if there are none.

    The driver gets a count for each language, ``BUCKETS`` document frequencies and the sample's features.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select(F.xxhash64("doc_id", "text").alias("place"), "lang", text_bytes().alias("text"))
    counted = spread(labelled.select("text")).mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(BUCKETS), 0
    for feature, n in counted.collect():
        if feature < 0:
            total = n
        else:
            frequency[feature] = n
    if not total:
        return None
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows = sample(labelled, per_language).mapInArrow(_sampled, "place long, lang string, at array<int>, counts array<int>").toArrow()
    columns = [rows.column(0).to_pylist(), rows.column(1).to_pylist(), *([x.values.to_numpy() for x in rows.column(i)] for i in (2, 3))]
    return train(list(zip(*columns)), idf)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(bytes(raw)) if lettered and model else ("und", 0.0) for raw, lettered in zip(raw_bytes(batch.column(2)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of whole texts."""
    bounded_batches(docs.sparkSession)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_bytes().alias("text"), lettered.alias("lettered"))
    return spread(rows).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
