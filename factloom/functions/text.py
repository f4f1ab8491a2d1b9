"""Text, identity and key functions over Columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining-mark ranges that normalised text keeps beside letters and digits.
MARK_RANGES = [
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x05C7, 0x05C7), (0x0610, 0x061A),
    (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED), (0x0711, 0x0711), (0x0730, 0x074A),
    (0x07A6, 0x07B0), (0x07EB, 0x07F3), (0x0816, 0x0819), (0x081B, 0x0823), (0x0825, 0x0827), (0x0829, 0x082D), (0x0859, 0x085F), (0x08D3, 0x08FF),
    (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x2DE0, 0x2DFF), (0xFE20, 0xFE2F), (0xE0100, 0xE01EF),
]
MARKS = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in MARK_RANGES)
_LETTER = r"\p{IsAlphabetic}\p{N}"
#: Control characters that are not white space.
_BAD_CONTROL = r"[\p{Cc}&&[^\x09-\x0D\x{85}]]"
_SPACE = r"[\s\x{85}\p{Z}]"
PREDICATE_NAMESPACE = "kg.relationship."


def normalize(text: Column) -> Column:
    """Lower-cased letters, digits and marks, everything between them one space; null where a control character
    that isn't white space occurs."""
    kept = F.trim(F.regexp_replace(F.lower(text), rf"[^{_LETTER}{MARKS}]+", " "))
    return F.when(text.rlike(_BAD_CONTROL), F.lit(None)).otherwise(kept)


def tokenize(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[^{_LETTER}]+"), lambda t: t != "")


def normalized_match(a: Column, b: Column) -> Column:
    """Whether both normalise, and to the same text."""
    return F.coalesce(normalize(a) == normalize(b), F.lit(False))


def whitespace_mode(text: Column, mode: str) -> Column:
    """The generic text normaliser: preserve, trim, or collapse runs of white space (which also trims)."""
    if mode == "preserve":
        return text
    trimmed = F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")
    if mode == "trim":
        return trimmed
    if mode == "collapse-whitespace":
        return F.regexp_replace(trimmed, rf"{_SPACE}+", " ")
    raise ValueError(f"unknown mode {mode!r}")


def valid_label(text: Column) -> Column:
    """Non-blank and without control characters; null is not valid."""
    return F.coalesce(text.isNotNull() & ~text.rlike(rf"^{_SPACE}*$") & ~text.rlike(r"\p{Cc}"), F.lit(False))


def valid_span(start: Column, end: Column, unit: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & unit.isin("byte", "scalar", "utf-16", "token"), F.lit(False))


def predicate_full(local: Column) -> Column:
    return F.concat(F.lit(PREDICATE_NAMESPACE), local)


def predicate_local(predicate: Column) -> Column:
    return F.when(predicate.startswith(PREDICATE_NAMESPACE), F.substring(predicate, len(PREDICATE_NAMESPACE) + 1, 1 << 20)).otherwise(predicate)


def valid_predicate(local: Column) -> Column:
    """A local name is a valid label and doesn't carry the namespace again."""
    return valid_label(local) & ~local.startswith(PREDICATE_NAMESPACE)


def stable_key(reference: Column) -> Column:
    return F.concat_ws(":", reference["kind"], reference["id"])


def path_key(path: Column) -> Column:
    """assertion:direction:predicate of the steps joined by |, or none without a path."""
    return F.coalesce(F.array_join(F.transform(path, lambda s: F.concat_ws(":", s["assertion_id"], s["direction"], s["predicate"])), "|"), F.lit("none"))


def reference_key(source: Column, reference: Column) -> Column:
    return F.concat(source, F.lit("\x1f"), reference)


def _component(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), F.octet_length(value).cast("string"), F.lit(":"), value, F.lit("|"))


def _pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_component("key", p["k"]), _component("value", p["v"]))), "")


def canonical_identity(subject: Column, predicate: Column, object_: Column, context: Column, qualifiers: Column, polarity: Column) -> Column:
    """The length-prefixed canonical text of the six fields an assertion is identified by."""
    return F.concat(
        _component("subject", stable_key(subject)),
        _component("predicate", predicate),
        _component("object", stable_key(object_)),
        _component("context", _pairs(context)),
        _component("qualifiers", _pairs(qualifiers)),
        _component("polarity", polarity),
    )


def assertion_id(*fields: Column) -> Column:
    """The key of an assertion: SHA-256 of its canonical identity."""
    return F.sha2(canonical_identity(*fields).cast("binary"), 256)


def cursor_token(score: Column, reference: Column, match_type: Column, path: Column, position: Column) -> Column:
    return F.concat(
        F.lit("score="), score.cast("string"), F.lit(";reference="), stable_key(reference), F.lit(";match="), match_type,
        F.lit(";path="), path_key(path), F.lit(";position="), position.cast("string"),
    )
