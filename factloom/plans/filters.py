"""Filter expressions over candidates: a small syntax tree, its validation, and its compilation to one Column.

Filters are two-valued: a missing attribute makes a leaf false, so ``Not`` of it is true. Every leaf is therefore
coalesced before it is combined, and Catalyst is free to push the result into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import temporal


class FilterError(ValueError):
    """A filter that is not well formed."""


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _has(column: str, value: Column) -> Column:
    return _true(F.array_contains(F.col(column), value))


@dataclass(frozen=True)
class Filter:
    def validate(self) -> None:
        pass

    def column(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class All(Filter):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Nothing(Filter):
    def column(self) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]

    def validate(self) -> None:
        if not self.parts:
            raise FilterError("filter boolean group must not be empty")
        for part in self.parts:
            part.validate()

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.column() for p in self.parts])


@dataclass(frozen=True)
class Or(And):
    def column(self) -> Column:
        return reduce(lambda a, b: a | b, [p.column() for p in self.parts])


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def validate(self) -> None:
        self.part.validate()

    def column(self) -> Column:
        return ~self.part.column()


@dataclass(frozen=True)
class Source(Filter):
    source_id: str

    def column(self) -> Column:
        return _has("source_ids", F.lit(self.source_id))


@dataclass(frozen=True)
class Authority(Filter):
    dimension: str
    value: str

    def column(self) -> Column:
        return _has("authority", F.struct(F.lit(self.dimension).alias("dimension"), F.lit(self.value).alias("value")))


@dataclass(frozen=True)
class Evidence(Filter):
    evidence_id: str

    def column(self) -> Column:
        return _has("evidence_ids", F.lit(self.evidence_id))


@dataclass(frozen=True)
class ValidAt(Filter):
    seconds: int
    nanos: int = 0

    def column(self) -> Column:
        return temporal.valid_at(F.col("validity"), temporal.instant(F.lit(self.seconds), F.lit(self.nanos)))


@dataclass(frozen=True)
class ValidDuring(Filter):
    """Boundaries as (kind, seconds, nanos)."""

    start: tuple
    end: tuple

    def column(self) -> Column:
        def boundary(b: tuple) -> tuple[Column, Column]:
            kind, *when = b
            return F.lit(kind), temporal.instant(F.lit(when[0]), F.lit(when[1] if len(when) > 1 else 0)) if when else F.lit(None)

        (sk, s), (ek, e) = boundary(self.start), boundary(self.end)
        return temporal.overlaps(F.col("validity"), temporal.validity("interval", sk, s, ek, e))


@dataclass(frozen=True)
class ValidityUnknown(Filter):
    def column(self) -> Column:
        return temporal.validity_unknown(F.col("validity"))


@dataclass(frozen=True)
class Epistemic(Filter):
    status: str

    def column(self) -> Column:
        return F.col("status").eqNullSafe(self.status)


@dataclass(frozen=True)
class Publication(Filter):
    outcome: str

    def column(self) -> Column:
        return F.col("publication").eqNullSafe(self.outcome)


@dataclass(frozen=True)
class Context(Filter):
    key: str
    value: str

    def validate(self) -> None:
        if not self.key.strip():
            raise FilterError("filter context key must not be empty")
        if "\0" in self.value:
            raise FilterError("filter context value is invalid")

    def column(self) -> Column:
        return _has("context", F.struct(F.lit(self.key).alias("k"), F.lit(self.value).alias("v")))


@dataclass(frozen=True)
class Relationship(Filter):
    predicate: str

    def column(self) -> Column:
        return F.col("predicate").eqNullSafe(self.predicate)


@dataclass(frozen=True)
class SemanticType(Filter):
    type_id: str

    def validate(self) -> None:
        if not self.type_id.strip():
            raise FilterError("filter semantic type is invalid")

    def column(self) -> Column:
        return _has("semantic_types", F.lit(self.type_id))


@dataclass(frozen=True)
class Entity(Filter):
    """position: subject, object or either."""

    position: str
    kind: str
    id: str

    def column(self) -> Column:
        def side(name: str) -> Column:
            return _true((F.col(f"{name}.kind") == self.kind) & (F.col(f"{name}.id") == self.id))

        if self.position == "either":
            return side("subject") | side("object")
        return side(self.position)


@dataclass(frozen=True)
class Visibility:
    """Which candidates a query may see at all; an empty set of statuses allows any."""

    name: str = "public"
    publication: str | None = "published"
    include_inferred: bool = False
    include_machine_generated: bool = False
    include_disputed: bool = False
    statuses: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = []
        if self.publication is not None:
            parts.append(F.col("publication").eqNullSafe(self.publication))
        if not self.include_inferred:
            parts.append(~F.col("inference").eqNullSafe("inferred"))
        if not self.include_machine_generated:
            parts.append(~F.col("inference").eqNullSafe("machine-generated"))
        if not self.include_disputed:
            parts.append(~F.col("status").eqNullSafe("disputed"))
        if self.statuses:
            parts.append(_true(F.col("status").isin(*self.statuses)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


#: The visibility presets.
PUBLIC = Visibility()
SCHOLARLY = Visibility("scholarly", include_disputed=True)
HISTORICAL = Visibility("historical", include_disputed=True)
RESEARCH = Visibility("research", include_inferred=True, include_machine_generated=True, include_disputed=True)
