import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import quality
from tests.conftest import SF
from tests.llm.helpers import documents, empty, prose, words


def slow(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": repeated,
        "n_repeat_words": len(again),
        "base_failed": len(w) < 20 or 100 * len(again) > 30 * len(w),
    }


def check(text):
    got = quality.measures((text or "").encode())
    assert {k: got[k] for k in slow(text)} == slow(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c#", "é", "\n", "  ", "𝒳$"]), max_size=120))
def test_measures_by_definition(parts):
    check(" ".join(parts))


@pytest.mark.parametrize("text", ["", None, "a " * 500, "x y z\nx y z\n\n \nx y z ", "one two three four five six seven eight nine " * 2, "a b c d e f g h\n" * 3, "\x0b\x0c a\rb", "日本 語\n日本 語"])
def test_measures_of_hard_texts(text):
    check(text)


def test_equal_hashes_of_different_windows(monkeypatch):
    """With every window in one hash the count still goes by the words."""
    text = " ".join(f"w{i % 13}" for i in range(100)) + " " + " ".join(f"v{i}" for i in range(40))
    wanted = slow(text)["n_repeat_words"]
    real = np.argsort
    assert quality.repeated_words(text.encode().split()) == wanted
    monkeypatch.setattr(np, "argsort", lambda key, kind=None: (key.fill(0), real(key, kind="stable"))[1])
    assert quality.repeated_words(text.encode().split()) == wanted


def test_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0
    p, q = np.array([0.5, 0.5]), np.array([1.0, 0])
    m = (p + q) / 2
    assert quality.js_distance(p, q) ** 2 == pytest.approx(((p * np.log2(p / m)).sum() + np.log2(1 / m[0])) / 2)


STOPS, SYMBOLS = ".,;:!?'\"()-", "#*$%&|<>"


def plain_classes(text):
    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return "space"
        if c in STOPS:
            return "stop"
        if c in SYMBOLS:
            return "symbol"
        if "a" <= c <= "z":
            return "lower"
        if "A" <= c <= "Z":
            return "upper"
        if "0" <= c <= "9":
            return "digit"
        return "other" if ord(c) < 128 else "letter"

    n = Counter(map(kind, text))
    return [n[k] for k in ("lower", "upper", "digit", "space", "stop", "symbol", "other", "letter")]


def plain_words(text):
    ascii_lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in (w.strip(STOPS + "|") for w in words(ascii_lower)) if w]


def plain_references(rows):
    """(median class shares, common words with counts, total) of each language, copies of a text weighing as one."""
    out, copies = {}, Counter(t for t, _ in rows)
    for lang in {g for _, g in rows if g is not None}:
        texts = {t: round((1 << 20) / copies[t]) * sum(x == (t, lang) for x in rows) for t, g in rows if g == lang and t}
        count = Counter()
        for t, weight in texts.items():
            for w, n in Counter(plain_words(t)).items():
                count[w.encode()] += n * weight
        shares = []
        for k in range(8):
            at = sorted((float(np.rint(plain_classes(t)[k] * (1000 / len(t)))), weight) for t, weight in texts.items() if len(t) >= 200)
            half, seen, found = sum(w for _, w in at) / 2, 0, 0.0
            for i, (step, weight) in enumerate(at):
                seen += weight
                if seen >= half:
                    found = step if seen > half else (step + at[min(i + 1, len(at) - 1)][0]) / 2
                    break
            shares.append(found / 1000)
        common = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:50]
        out[lang] = (shares, dict(common), count.total())
    return out


def plain_distance(p, q, n):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, max(0.0, (kl(p, m) + kl(q, m)) / 2) - (len(p) - 1) / (8 * n * math.log(2))))


def plain_distances(text, lang, known):
    found = []
    for shares, common, total in [known[lang]] if lang in known else known.values():
        by_class = by_word = None
        if sum(map(len, words(text))) >= 200 and sum(shares):
            by_class = plain_distance(plain_classes(text), shares, len(text))
        if len(words(text)) >= 100 and total:
            seen = Counter(w.encode() for w in plain_words(text))
            h = [seen[w] for w in common] + [seen.total() - sum(seen[w] for w in common)]
            by_word = plain_distance(h, [*common.values(), total - sum(common.values())], sum(h)) if sum(h) else 1.0
        found.append((by_class, by_word))
    return min(found, key=lambda x: (x[0] or 0) + (x[1] or 0), default=(None, None))


@pytest.mark.parametrize("made", [False, True])
def test_references_distances_and_verdicts_by_a_plain_reading(spark, sf_dir, made):
    if made:
        rows = [(i, prose(i, 30 + 17 * (i % 9)) + (" | # x" * 30 if i % 5 == 0 else " Ärger."), ["en", "de", None][i % 3], "a") for i in range(40)]
        rows += [(100 + i, prose(7, 150), "en", "a") for i in range(30)] + [(200, None, "en", "a"), (201, "", "de", "a"), (202, "x" * 300, "xx", "a")]
    else:
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = documents(spark, rows)
    known, wanted = quality.references(docs), plain_references([(t or "", g) for _, t, g, _ in rows])
    assert {g for g, own in known.items() if own["total"]} == {g for g, (_, common, _) in wanted.items() if common}
    for lang, own in known.items():
        shares, common, total = wanted[lang]
        assert own["classes"].tolist() == pytest.approx(shares)
        assert (own["total"], {w: own["words"][w] for w in own["index"]}) == (total, common)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text, lang, _ in rows:
        by_class, by_word = plain_distances(text or "", lang, wanted)
        assert got[i].class_distance == (by_class if by_class is None else pytest.approx(by_class, abs=1e-7))
        assert got[i].word_distance == (by_word if by_word is None else pytest.approx(by_word, abs=1e-7))
        assert got[i].kept == (not slow(text)["base_failed"] and (by_class or 0) <= quality.MAX_CLASS_DISTANCE and (by_word or 0) <= quality.MAX_WORD_DISTANCE)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_copies_weigh_as_one_text(spark, monkeypatch, broadcast):
    """Thousands of copies of an odd text leave the references as they are."""
    monkeypatch.setattr(quality, "BROADCAST_COPIES", broadcast)
    rows = [(i, prose(i, 120), "en", "a") for i in range(40)] + [(900, "%%% $$$ " * 200, "en", "a")]
    few = quality.references(documents(spark, rows))["en"]
    many = quality.references(documents(spark, rows + [(1000 + i, "%%% $$$ " * 200, "en", "a") for i in range(2000)]))["en"]
    assert few["classes"].tolist() == many["classes"].tolist()
    assert list(few["index"]) == list(many["index"]) and np.allclose(few["histogram"] / few["histogram"].sum(), many["histogram"] / many["histogram"].sum(), atol=1e-3)


def test_verdicts_follow_the_labels(spark):
    """Of the documents that pass the base rules, the good ones stay and most of the bad ones go."""
    folder = SF.replace("0.001", "0.01")
    found = {r.doc_id: r for r in quality.op10_quality(spark, folder).collect()}
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    good, bad = ([r.kept for q, r in labels if q == want and not r.base_failed] for want in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.25 * len(bad) and len(bad) > 20


def test_odd_rows(spark):
    got = quality.judge(documents(spark)).collect()
    assert len(got) == 14 and not any(r.kept for r in got if r.base_failed)
    rows = {(r.doc_id, r.n_words) for r in got}
    assert {(3, 0), (4, 0), (5, 0), (8, 1), (10, 80_000), (11, 1)} <= rows
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0
    kept = quality.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
