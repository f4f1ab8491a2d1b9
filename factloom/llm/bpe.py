"""Byte-level BPE by dynamic programming over prefixes.

Exactly one last token is right for every prefix of a piece. A suffix automaton of the vocabulary lists
the tokens that end at each position; the candidate whose pair with the token before it survives merging
is that last token. Following the back-pointers from the end emits the ids that merging would give.

Pair test: in the merge order of token ``a`` then ``b`` side by side, the tokens at the seam are the
right spine of ``a``'s merge tree and the left spine of ``b``'s, each alive from its own merge to its
parent's. The pair falls apart exactly when two that are alive together have a merge of an earlier rank
than the ends of their lives. At equal rank the left-most merge goes first, hence < on the left, <= on
the right.

Defined results: null text counts as empty (no ids, empty decoding); special tokens inside a text are
single ids, as the public library reads them; invalid UTF-8 in decoded ids becomes U+FFFD. Rows pass one
by one, repeated rows included, and texts of any length are encoded whole; a null doc_id is kept; an empty table gives an
empty result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, raw_bytes, spread, text_bytes

#: The published splitting pattern of this vocabulary family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept between texts by a worker, pieces longer than this many characters are not kept.
CACHE, CACHED_LENGTH, PAIRS = 400_000, 48, 2_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Tokenizer:
    """Encodes and decodes with a byte-level BPE vocabulary file of the public ``tokenizers`` JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {letter: b for b, letter in enumerate(letters)}
        self.letters = {b: letter for b, letter in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.birth: dict[int, int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[left], vocab[right])
            self.rank[pair] = r
            whole = vocab[left + right]
            if whole not in self.halves:
                self.halves[whole], self.birth[whole] = pair, r
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.halves or len(token) == 1:
                self.suffixes.add_word(token, (i, len(token)))
        self.suffixes.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(token, birth, death) from the whole token down to its outermost byte on that side."""
        out, death = [], float("inf")
        while True:
            born = self.birth.get(token, -1)
            out.append((token, born, death))
            if token not in self.halves:
                return out
            death, token = born, self.halves[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` followed by ``b`` leaves exactly these two tokens."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i, j = 0, 0
        while i < len(left) and j < len(right):
            (x, x_born, x_dies), (y, y_born, y_dies) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_dies and r <= y_dies:
                return False
            if x_born >= y_born:
                i += 1
            else:
                j += 1
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece (no splitting)."""
        n = len(piece)
        last, length = [0] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (token, size) in self.suffixes.iter(piece.decode("latin-1").translate(self.letters)):
            end += 1
            if length[end]:
                continue
            start = end - size
            if start:
                if not length[start]:
                    continue
                pair = (last[start], token)
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    good = fits[pair] = self.compatible(*pair)
                if not good:
                    continue
            last[end], length[end] = token, size
        ids, at = [], n
        while at:
            if not length[at]:
                raise ValueError("the vocabulary lacks a byte of this text")
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode_piece(piece.encode())
        entry = (len(ids), ",".join(map(str, ids)), self.decode_bytes(ids))
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = entry
        return entry

    def parts(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, bytes decoded from the ids) of each piece in turn."""
        at = 0
        spots = self.splitter.finditer(text) if self.splitter else ()
        known, piece_of = self.known, self._piece
        for spot in spots:
            yield from (known.get(p) or piece_of(p) for p in self.pieces.findall(text, at, spot.start()))
            special = self.special[spot.group()]
            yield 1, str(special), self.bytes_of[special]
            at = spot.end()
        yield from (known.get(p) or piece_of(p) for p in (self.pieces.findall(text[at:]) if at else self.pieces.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(",")]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer for a path, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for raw in raw_bytes(batch.column(1)):
                parts = list(own.parts(str(raw, "utf-8", "replace")))
                counts.append(sum(p[0] for p in parts))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                back = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            out = [own.encode(str(raw, "utf-8", "replace")) for raw in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(_tokens(path or default_vocabulary()), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none."""
    bounded_batches(tokens.sparkSession)
    rows = tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_texts(path or default_vocabulary()), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of whole texts in one pass."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return spread(rows).mapInArrow(_digests(path or default_vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
