import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Reference

from factloom.llm import bpe
from tests.llm.helpers import documents, empty

PATH = bpe.default_vocabulary()
REFERENCE = Reference.from_file(PATH)
OWN = bpe.Tokenizer(PATH)


def check(text):
    wanted = REFERENCE.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == wanted
    assert OWN.decode(wanted) == REFERENCE.decode(wanted, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("text", ["", "aaaaaaaa", "<|endoftext|>", "a<|endoftext|> b<|endo", " \n\n  x", "don't WE'LL", "é" * 99, "aAaA" * 40, "the" * 60, " " * 200, "ab" * 3000, "\x00\x7f", "日本語 𝒳"])
def test_hard_texts(text):
    check(text)


def test_merged_vocabulary_entries():
    r = random.Random(3)
    vocab = [b.decode("utf-8", "replace") for b in OWN.bytes_of.values()]
    for _ in range(1500):
        check("".join(r.choice(vocab) for _ in range(r.randint(1, 5))))


def test_pair_test_equals_merging():
    """compatible(a, b) says whether the library leaves two joined tokens alone."""
    r = random.Random(4)
    ids = [i for i, b in OWN.bytes_of.items() if b.isascii() and b.isalpha()]
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        joined = (OWN.bytes_of[a] + OWN.bytes_of[b]).decode()
        assert OWN.compatible(a, b) == (REFERENCE.encode(joined, add_special_tokens=False).ids == [a, b])


def test_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    small = bpe.Tokenizer(PATH)
    text = "the quick brown fox jumps over the lazy dog " * 3
    assert small.encode(text) == OWN.encode(text)


def test_odd_rows(spark):
    rows = documents(spark).collect()
    got = sorted(map(tuple, bpe.digests(documents(spark)).collect()), key=str)
    wanted = []
    for r in rows:
        ids = REFERENCE.encode(r.text or "", add_special_tokens=False).ids
        back = REFERENCE.decode(ids, skip_special_tokens=False)
        wanted.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    assert bpe.digests(empty(spark)).count() == 0


def test_round_trip(spark):
    back = bpe.decode(bpe.encode(documents(spark))).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r.doc_id, r.text or "")) for r in documents(spark).collect())
