"""Quality rules by distribution divergence.

A first pass over the whole corpus makes each language's references: the median share of each character class over its
texts, and the distribution over its most frequent words (all other words are one further class). Copies of a text together
weigh as one text, so neither a large group of copies nor junk in less than half of the texts moves the class reference, and
copies don't move the words. A second pass measures each document's Jensen-Shannon distance (base 2, 0 to 1) to the
references of its language, or to the nearest where it has none, and rejects a document beyond a distance. Length guards
keep a document that is too short for a histogram from being judged by it; beyond them, what a sample of the document's
length differs from its own source on average, (bins - 1) / (8 n ln 2) of the squared distance, is taken off first.

Base rules come first: fewer than 20 words, or over 30 % of words in eight-word windows that occur again.

Defined results: null text counts as empty (rejected by its length); texts of any length are read whole; a null or unknown
lang is compared with every reference; if there are none, the method rejects nothing; a distance equal to its limit is
kept; words that tie for the last place of a reference go by their bytes; a null doc_id is kept; rows pass one by one,
repeated rows included, and equal rows get equal results; an empty table gives an empty result; other columns are ignored
by ``judge`` and passed on by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bounded_batches, checkpointed, raw_bytes, spread, text_bytes

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Words of a language's reference; distances above which a document is rejected; least sizes to be judged.
COMMON_WORDS = 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.38
MIN_CHARS, MIN_COMMON_GUARD = 200, 100
#: Words a counting task holds before it hands its counts on.
HELD_WORDS = 300_000
#: Steps in which a share is counted for the median, and how many of them are ranked together.
STEPS, BLOCK = 1000, 50
#: The weight of a text; n copies weigh UNIT / n each.
UNIT = 1 << 20
#: Groups of copies whose digests are broadcast (under 100 bytes each); beyond it rows meet them by a shuffle.
BROADCAST_COPIES = 200_000

CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other", "letter"]
#: Class of each UTF-8 byte: ASCII by kind; a lead byte stands for its character; continuation bytes count as none.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[0xC2:0x100] = 7
_CLASS[0x80:0xC0] = 8
_SPACE = 3
_SYMBOL = 5


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class in a UTF-8 text."""
    return np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=9)[:8]


def repeated_words(words: list[bytes]) -> int:
    """Words lying in eight-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) > len(words) - WINDOW:
        return 0
    mixed, key = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.zeros(n, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    for k in range(WINDOW):
        key = key * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):  # two windows of one hash: count the windows themselves
        seen = Counter(zip(*[words[k : k + n] for k in range(WINDOW)]))
        starts = np.array([i for i, w in enumerate(zip(*[words[k : k + n] for k in range(WINDOW)])) if seen[w] > 1])
    else:
        starts = np.union1d(a, b)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measures(text: bytes) -> dict:
    """The base figures of a text and what the method needs of it."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    counts = class_counts(text)
    n, again = len(words), repeated_words(words)
    return {
        "words": words,
        "classes": counts,
        "n_words": n,
        "word_chars": int(counts.sum() - counts[_SPACE]),
        "n_symbols": int(counts[_SYMBOL]),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": again,
        "base_failed": n < MIN_WORDS or 100 * again > MAX_REPEATED * n,
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    part = [float((x[x > 0] * np.log2(x[x > 0] / middle[x > 0])).sum()) for x in (p, q)]
    return max(0.0, sum(part) / 2) ** 0.5


def _plain(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?'\"()-|")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of a task, weighted: words of kind w, their total of kind t, and for each class and block of steps
    (kind "class/block") the texts whose share of the class is at a step."""
    held: dict[str, Counter] = {}
    shares: Counter = Counter()
    totals: dict[str, int] = {}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        lang, kind, key, n = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, weight, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_bytes(batch.column(2))):
            text = bytes(raw)
            if not text:
                continue
            words = Counter(filter(None, map(_plain, text.split())))
            own = held.setdefault(lang, Counter())
            for word, n in words.items():
                own[word] += n * weight
            totals[lang] = totals.get(lang, 0) + words.total() * weight
            counts = class_counts(text)
            if counts.sum() >= MIN_CHARS:
                for k, step in enumerate(np.rint(counts * (STEPS / counts.sum())).astype(int).tolist()):
                    shares[lang, k, step] += weight
        if sum(map(len, held.values())) > HELD_WORDS:
            yield rows([(lang, "w", k, n) for lang, c in held.items() for k, n in c.items()])
            held = {}
    if words := [(lang, "w", k, n) for lang, c in held.items() for k, n in c.items()]:
        yield rows(words)
    if rest := [(lang, f"{k}/{step // BLOCK}", str(step).encode(), n) for (lang, k, step), n in shares.items()] + [(lang, "t", b"", n) for lang, n in totals.items()]:
        yield rows(rest)


def _weighted(docs: DataFrame) -> DataFrame:
    """(lang, weight, text) of the documents with a language: UNIT divided by the number of copies of the text."""
    rows = docs.where("lang IS NOT NULL").select("lang", text_bytes().alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    copies = checkpointed(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    weight = F.greatest(F.lit(1), F.round(UNIT / F.coalesce("copies", F.lit(1)))).cast("long")
    return rows.join(copies, "digest", "left").select("lang", weight.alias("weight"), "text")


def _median(at: dict[int, int]) -> float:
    """The share in the middle of counts by step, in between the steps where the middle lies between two."""
    half, seen = sum(at.values()) / 2, 0
    steps = sorted(at)
    for step, after in zip(steps, steps[1:] + steps[-1:]):
        seen += at[step]
        if seen >= half:
            return (step if seen > half else (step + after) / 2) / STEPS
    return 0.0


def references(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, dict]:
    """For each language of the corpus, its class histogram and its most frequent words with the rest's count.

    Counts cover every document with a language; the driver gets ``common`` words and at most 8 x (STEPS + 1) counts of each.
    """
    bounded_batches(docs.sparkSession)
    counted = spread(_weighted(docs)).mapInArrow(_counts, "lang string, kind string, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # One window takes the common words and, a block having fewer steps, all shares and the total too: the corpus is read once.
    # Each task hands on the first of its rows; groups of tasks, and groups of those, choose before the last window does.
    counted = counted.withColumn("part", F.spark_partition_id())
    for groups in (64, 8, 1):
        place = F.row_number().over(Window.partitionBy("lang", "kind", F.col("part") % groups).orderBy(F.desc("n"), "key"))
        counted = counted.withColumn("place", place).where(F.col("place") <= max(common, BLOCK)).drop("place")
    wanted = counted.drop("part")
    out: dict[str, dict] = {}
    for lang, kind, key, n in wanted.collect():
        own = out.setdefault(lang, {"shares": [{} for _ in CLASSES], "words": {}, "total": 0})
        if kind == "w":
            own["words"][bytes(key)] = n
        elif kind == "t":
            own["total"] = n
        else:
            own["shares"][int(kind.split("/")[0])][int(bytes(key))] = n
    for own in out.values():
        own["classes"] = np.array([_median(at) for at in own["shares"]])
        names = sorted(own["words"], key=lambda w: (-own["words"][w], w))[:common]
        own["index"] = {w: i for i, w in enumerate(names)}
        own["histogram"] = np.array([own["words"][w] for w in names] + [own["total"] - sum(own["words"][w] for w in names)], dtype=float)
    return out


def beyond_chance(distance: float, bins: int, n: int) -> float:
    """A distance without what a sample of n differs from its source on average."""
    return max(0.0, distance * distance - (bins - 1) / (8 * n * math.log(2))) ** 0.5


def distances(m: dict, lang: str | None, known: dict[str, dict]) -> tuple[float | None, float | None]:
    """(class distance, word distance) to the language's reference, or to the nearest; None where a guard holds."""
    near: list[tuple[float | None, float | None]] = []
    judged = m["word_chars"] >= MIN_CHARS
    worded = m["n_words"] >= MIN_COMMON_GUARD
    seen = Counter(map(_plain, m["words"])) if worded else None
    for own in [known[lang]] if lang in known else known.values():
        by_class = None
        if judged and own["classes"].sum():
            by_class = beyond_chance(js_distance(m["classes"].astype(float), own["classes"]), len(CLASSES), int(m["classes"].sum()))
        by_word = None
        if worded and own["histogram"].sum():
            h = np.zeros(len(own["histogram"]))
            for w, i in own["index"].items():
                h[i] = seen.get(w, 0)
            h[-1] = sum(seen.values()) - seen.get(b"", 0) - h.sum()
            by_word = beyond_chance(js_distance(h, own["histogram"]), len(h), int(h.sum())) if h.sum() else 1.0
        near.append((by_class, by_word))
    if not near:
        return None, None
    return min(near, key=lambda x: (x[0] or 0) + (x[1] or 0))


def verdict(m: dict, by_class: float | None, by_word: float | None) -> bool:
    return not (m["base_failed"] or (by_class is not None and by_class > MAX_CLASS_DISTANCE) or (by_word is not None and by_word > MAX_WORD_DISTANCE))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _judge(known: dict[str, dict]):
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_bytes(batch.column(2))):
                m = measures(bytes(raw))
                by_class, by_word = distances(m, lang, known)
                values = [doc_id, *(m[k] for k in names[1:7]), verdict(m, by_class, by_word), by_class, by_word]
                for column, value in zip(rows, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return run


def judge(docs: DataFrame) -> DataFrame:
    """The base figures, the distances and the verdict of every document."""
    known = references(docs)
    rows = docs.select(F.col("doc_id").cast("long"), "lang", text_bytes().alias("text"))
    return spread(rows).mapInArrow(_judge(known), _OUT)


def _keep(known: dict[str, dict], lang_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            good = []
            for lang, raw in zip(batch.column(lang_at).to_pylist(), raw_bytes(texts.cast(pa.large_binary()))):
                m = measures(bytes(raw))
                good.append(not m["base_failed"] and verdict(m, *distances(m, lang, known)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them, with all their columns."""
    known = references(docs)
    return docs.mapInArrow(_keep(known, docs.columns.index("lang"), docs.columns.index("text")), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
