"""Ontology: classes, properties, the class taxonomy, constraints and the validation report, as tables.

class(key, label); property(key, domain, range) with arrays of class keys; edge(child, parent);
constraint(owner, kind, low, high, other): cardinality, disjoint-with or extension.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.lineage import cut

#: Rounds of a reachability search that had no end before; each doubles the distance covered.
MAX_ROUNDS = 40


class OntologyError(ValueError):
    """An ontology operation that isn't allowed."""


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key)


def add(known: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Classes or properties with others; a key that is there already is an error."""
    out = known.unionByName(new)
    if not duplicates(out, key).isEmpty():
        raise OntologyError("duplicate key")
    return out


def valid_property(domain: Column, range_: Column) -> Column:
    return F.coalesce((F.size(domain) > 0) & (F.size(range_) > 0), F.lit(False))


def in_domain(domain: Column, class_key: Column) -> Column:
    """Exact membership; a subclass of a domain class isn't in the domain by itself."""
    return F.coalesce(F.array_contains(domain, class_key), F.lit(False))


def parents(edges: DataFrame, key: str) -> DataFrame:
    return edges.where(F.col("child") == key).select("parent").distinct()


def children(edges: DataFrame, key: str) -> DataFrame:
    return edges.where(F.col("parent") == key).select("child").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("child", "parent")).alias("key")).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """(descendant, ancestor) of all pairs joined by one edge or more. Pairs double their length every round, so a
    taxonomy of depth d takes log d rounds; each round's table is checkpointed."""
    known = edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct()
    before = -1
    for _ in range(MAX_ROUNDS):
        known = cut(known)
        size = known.count()
        if size == before:
            return known
        before = size
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.descendant")).select("a.descendant", "b.ancestor")
        known = known.unionByName(further).distinct()
    raise OntologyError("the taxonomy is too deep")


def descendants(edges: DataFrame, key: str) -> DataFrame:
    """Everything below a class, level by level from it."""
    found = edges.where(F.col("parent") == key).select(F.col("child").alias("key")).distinct()
    frontier = found
    for _ in range(1 << 16):
        further = edges.join(frontier, edges["parent"] == frontier["key"]).select(F.col("child").alias("key")).distinct()
        frontier = cut(further.join(found, "key", "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))
    raise OntologyError("the taxonomy is too deep")


def cycles(edges: DataFrame) -> DataFrame:
    """Classes that reach themselves."""
    return reachable(edges).where("descendant = ancestor").select(F.col("descendant").alias("key"))


def add_edge(classes: DataFrame, edges: DataFrame, child: str, parent: str) -> tuple[DataFrame, bool]:
    """(edges, whether it is new): no self edge, both ends known, no cycle."""
    if child == parent:
        raise OntologyError("a class can't be its own parent")
    if classes.where(F.col("key").isin(child, parent)).select("key").distinct().count() < 2:
        raise OntologyError("an end is not a class")
    if not edges.where((F.col("child") == child) & (F.col("parent") == parent)).isEmpty():
        return edges, False
    if not descendants(edges, child).where(F.col("key") == parent).isEmpty():
        raise OntologyError("the edge closes a cycle")
    row = edges.sparkSession.createDataFrame([(child, parent)], "child string, parent string")
    return edges.unionByName(row), True


def valid_constraint(kind: Column, low: Column, high: Column, owner: Column, other: Column) -> Column:
    """Structure alone: cardinality bounds in order, disjointness with another class; extensions name something."""
    cardinality = (low >= 0) & (high.isNull() | (low <= high))
    return F.coalesce(F.when(kind == "cardinality", cardinality).when(kind == "disjoint-with", other != owner).when(kind == "extension", F.trim(other) != ""), F.lit(False))


def report(classes: DataFrame, properties: DataFrame, edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """All findings (code, subject): nothing aborts the others."""
    keys = classes.select(F.col("key").alias("known")).distinct()

    def missing(rows: DataFrame, code: str) -> DataFrame:
        """rows: (subject, key)"""
        return rows.join(keys, F.col("key") == F.col("known"), "left_anti").select(F.lit(code).alias("code"), F.col("subject")).distinct()

    ends = edges.select(F.concat_ws(">", "child", "parent").alias("subject"), F.explode(F.array("child", "parent")).alias("key"))
    domains = properties.select(F.col("key").alias("subject"), F.explode("domain").alias("key"))
    ranges = properties.select(F.col("key").alias("subject"), F.explode("range").alias("key"))
    disjoint = constraints.where("kind = 'disjoint-with'").select(F.col("owner").alias("subject"), F.col("other").alias("key"))
    parts = [
        duplicates(classes, "key").select(F.lit("duplicate-class").alias("code"), F.col("key").alias("subject")),
        missing(ends, "missing-taxonomy-class"),
        cycles(edges).select(F.lit("taxonomy-cycle").alias("code"), F.col("key").alias("subject")),
        missing(domains, "missing-domain-class"),
        missing(ranges, "missing-range-class"),
        missing(disjoint, "missing-constraint-class"),
        constraints.where(~valid_constraint(F.col("kind"), F.col("low"), F.col("high"), F.col("owner"), F.col("other"))).select(F.lit("invalid-constraint").alias("code"), F.col("owner").alias("subject")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Snapshots:
    """Registered ontology snapshots; only a valid one can be registered, and one is active."""

    valid: dict[str, DataFrame] = field(default_factory=dict)
    active: str | None = None

    def register(self, name: str, findings: DataFrame) -> None:
        if name in self.valid:
            raise OntologyError("the snapshot is registered already")
        if not findings.isEmpty():
            raise OntologyError("the ontology has findings")
        self.valid[name] = findings

    def activate(self, name: str) -> None:
        if name not in self.valid:
            raise OntologyError("unknown snapshot")
        self.active = name


#: Dimensions of a semantic context, each with one value at most.
CONTEXT_DIMENSIONS = ("language", "domain", "period", "place", "source", "tradition", "genre", "audience")


def semantic_types(primary: Column, additional: Column) -> Column:
    """Primary first; the primary is never repeated among the additional ones."""
    others = F.array_sort(F.array_distinct(F.filter(additional, lambda t: t != primary)))
    return F.concat(F.array(primary), others)


def valid_context(pairs: Column) -> Column:
    """At most one value for each known dimension; extensions may repeat."""
    known = F.filter(pairs, lambda p: p["k"].isin(*CONTEXT_DIMENSIONS))
    names = F.transform(known, lambda p: p["k"])
    return F.size(names) == F.size(F.array_distinct(names))


def lexical_mappings(assertions: DataFrame) -> DataFrame:
    """(assertion_id, lexical_form, concept, mediated) of assertions that map a lexical form to a concept, direct or by a sense."""
    rows = assertions.where((F.col("subject.kind") == "lexical-form") & (F.col("object.kind") == "concept"))
    mediated = F.exists("qualifiers", lambda q: q["k"] == "sense")
    return rows.select("assertion_id", F.col("subject.id").alias("lexical_form"), F.col("object.id").alias("concept"), mediated.alias("mediated"))
