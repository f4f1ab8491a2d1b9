"""Temporal validity: instants, intervals with four kinds of boundary, three-valued containment, overlap and
disjointness, as Columns over the VALIDITY struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.schema import INSTANT, VALIDITY

#: The thirteen interval relations, each with its inverse.
ALLEN_INVERSE = {
    "before": "after",
    "after": "before",
    "meets": "met-by",
    "met-by": "meets",
    "overlaps": "overlapped-by",
    "overlapped-by": "overlaps",
    "starts": "started-by",
    "started-by": "starts",
    "during": "contains",
    "contains": "during",
    "finishes": "finished-by",
    "finished-by": "finishes",
    "equals": "equals",
}


def instant(seconds: Column, nanos: Column | None = None) -> Column:
    return F.struct(seconds.cast("bigint").alias("s"), (nanos if nanos is not None else F.lit(0)).cast("int").alias("n"))


def instant_of_micros(us: Column) -> Column:
    """An instant from microseconds since the epoch; seconds are floored, so nanoseconds are never negative. Integers alone:
    the far ends of the calendar have more digits than a double."""
    us = us.cast("bigint")
    rest = F.pmod(us, F.lit(1_000_000).cast("bigint"))
    return F.when(us.isNotNull(), instant(F.call_function("div", us - rest, F.lit(1_000_000).cast("bigint")), rest * 1000)).otherwise(F.lit(None).cast(INSTANT))


def valid_instant(at: Column) -> Column:
    return F.coalesce(at["n"].between(0, 999_999_999), F.lit(False))


def instant_text(at: Column) -> Column:
    """unix:S.NNNNNNNNN; before the epoch the sign goes in front of the exact decimal value."""
    negative = at["s"] < 0
    s = F.when(negative & (at["n"] > 0), -(at["s"] + 1)).otherwise(F.abs(at["s"]))
    n = F.when(negative & (at["n"] > 0), 1_000_000_000 - at["n"]).otherwise(at["n"])
    return F.concat(F.lit("unix:"), F.when(negative, F.lit("-")).otherwise(F.lit("")), s.cast("string"), F.lit("."), F.lpad(n.cast("string"), 9, "0"))


def validity(tag: Column | str, start_kind: Column, start: Column, end_kind: Column, end: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(tag.alias("tag"), start_kind.alias("start_kind"), start.alias("start"), end_kind.alias("end_kind"), end.alias("end")).cast(VALIDITY)


def at(when: Column) -> Column:
    return validity("instant", F.lit("inclusive"), when, F.lit("inclusive"), when)


def during(start_kind: str, start: Column, end_kind: str, end: Column) -> Column:
    return validity("interval", F.lit(start_kind), start, F.lit(end_kind), end)


def approximately(center: Column) -> Column:
    return validity("approximate", F.lit("inclusive"), center, F.lit("inclusive"), center)


def from_on(start: Column, kind: str = "inclusive") -> Column:
    return validity("open-ended", F.lit(kind), start, F.lit("open"), F.lit(None))


def until(end: Column, kind: str = "inclusive") -> Column:
    return validity("open-ended", F.lit("open"), F.lit(None), F.lit(kind), end)


def unknown() -> Column:
    return validity("unknown", F.lit("unknown"), F.lit(None), F.lit("unknown"), F.lit(None))


def open_direction(v: Column) -> Column:
    """after where only the start is bounded, before where only the end is, null otherwise."""
    bounded = lambda kind: kind.isin("inclusive", "exclusive")
    return F.when(bounded(v["start_kind"]) & (v["end_kind"] == "open"), "after").when(bounded(v["end_kind"]) & (v["start_kind"] == "open"), "before")


def valid_interval(v: Column) -> Column:
    """Ends in order; equal ends need both to be inclusive."""
    both = v["start"].isNotNull() & v["end"].isNotNull()
    ordered = (v["start"] < v["end"]) | ((v["start"] == v["end"]) & (v["start_kind"] == "inclusive") & (v["end_kind"] == "inclusive"))
    return F.when(both, ordered).otherwise(F.lit(True))


def contains(v: Column, when: Column) -> Column:
    """Whether the interval contains the instant: null where a boundary is unknown and the other one doesn't exclude it."""
    after = F.when(v["start_kind"] == "open", True).when(v["start_kind"] == "inclusive", when >= v["start"]).when(v["start_kind"] == "exclusive", when > v["start"])
    before = F.when(v["end_kind"] == "open", True).when(v["end_kind"] == "inclusive", when <= v["end"]).when(v["end_kind"] == "exclusive", when < v["end"])
    return after & before


def valid_at(v: Column, when: Column) -> Column:
    """Two-valued: the instant itself, or an interval that certainly contains it. Approximate and unknown times don't match."""
    found = F.when(v["tag"] == "instant", v["start"] == when).when(v["tag"].isin("interval", "open-ended"), contains(v, when))
    return F.coalesce(found, F.lit(False))


def _ends_before(end_kind: Column, end: Column, start_kind: Column, start: Column) -> Column:
    """Whether an upper boundary certainly lies before a lower one; equal ends touch only if both are inclusive."""
    apart = (end < start) | ((end == start) & ~((end_kind == "inclusive") & (start_kind == "inclusive")))
    return F.coalesce(apart, F.lit(False))


def _apart(a: Column, b: Column) -> Column:
    return _ends_before(a["end_kind"], a["end"], b["start_kind"], b["start"]) | _ends_before(b["end_kind"], b["end"], a["start_kind"], a["start"])


def overlaps(v: Column, requested: Column) -> Column:
    """Two-valued overlap with a requested interval; an approximate time counts by its centre, an unknown boundary as no."""
    vague = (v["start_kind"] == "unknown") | (v["end_kind"] == "unknown") | (requested["start_kind"] == "unknown") | (requested["end_kind"] == "unknown")
    return F.coalesce((v["tag"] != "unknown") & ~vague & ~_apart(v, requested), F.lit(False))


def definitely_disjoint(a: Column, b: Column) -> Column:
    """Whether two valid times certainly don't meet. Missing, approximate and unknown times never prove it."""
    exact = a["tag"].isin("instant", "interval", "open-ended") & b["tag"].isin("instant", "interval", "open-ended")
    point = (
        F.when((a["tag"] == "instant") & (b["tag"] == "instant"), a["start"] != b["start"])
        .when(a["tag"] == "instant", contains(b, a["start"]) == F.lit(False))
        .when(b["tag"] == "instant", contains(a, b["start"]) == F.lit(False))
        .otherwise(_apart(a, b))
    )
    return F.coalesce(exact & point, F.lit(False))


def validity_unknown(v: Column) -> Column:
    return v.isNull() | F.coalesce(v["tag"] == "unknown", F.lit(True))


def allen_inverse(relation: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ALLEN_INVERSE.items() for x in pair]), relation)


def allen_relation(a: Column, b: Column) -> Column:
    """An addition of ours: the relation of two closed intervals with known ends."""
    s, e, t, f = a["start"], a["end"], b["start"], b["end"]
    return (
        F.when(e < t, "before").when(s > f, "after")
        .when((s == t) & (e == f), "equals")
        .when((e == t) & (s < t), "meets").when((s == f) & (e > f), "met-by")
        .when((s == t) & (e < f), "starts").when((s == t) & (e > f), "started-by")
        .when((e == f) & (s > t), "finishes").when((e == f) & (s < t), "finished-by")
        .when((s > t) & (e < f), "during").when((s < t) & (e > f), "contains")
        .when(s < t, "overlaps").when(s > t, "overlapped-by")
    )
