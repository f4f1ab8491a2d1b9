"""Evidence, provenance, authority, confidence and relationship metadata: checks as columns, append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import valid_label
from factloom.schema import EPISTEMIC_STATUSES

# Closed vocabularies of the metadata.
EVIDENCE_ROLES = ("supports", "contradicts", "contextualizes", "defines", "attributes", "derives", "qualifies")
LINEAGE_KINDS = ("derived-from", "generated-by", "used", "attributed-to", "revision-of", "quoted-from", "primary-source", "alternate-of")
CONFIDENCE_FORMS = ("numeric", "qualitative", "unknown")


def evidence_code(row_id: Column, mechanism: Column, locations: Column, inputs: Column) -> Column:
    """The first thing wrong with an evidence row: direct evidence needs a location; derived needs inputs, not itself."""
    return (
        F.when(~valid_label(row_id), "invalid-id")
        .when((mechanism == "direct") & (F.coalesce(F.size(locations), F.lit(0)) <= 0), "missing-location")
        .when((mechanism == "derived") & (F.coalesce(F.size(inputs), F.lit(0)) <= 0), "missing-inputs")
        .when((mechanism == "derived") & F.array_contains(inputs, row_id), "self-dependency")
        .when(~mechanism.isin("direct", "derived"), "unknown-mechanism")
    )


def support_links(assertions: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """links(assertion_id, evidence_id, role) with ``code`` where an end is missing or the role is unknown."""
    a = assertions.select("assertion_id", F.lit(True).alias("has_a")).distinct()
    e = evidence.select("evidence_id", F.lit(True).alias("has_e")).distinct()
    joined = links.join(a, "assertion_id", "left").join(e, "evidence_id", "left")
    code = F.when(F.col("has_a").isNull(), "unknown-assertion").when(F.col("has_e").isNull(), "unknown-evidence").when(~F.col("role").isin(*EVIDENCE_ROLES), "unknown-role")
    return joined.select("assertion_id", "evidence_id", "role", code.alias("code"))


def latest_verification(records: DataFrame) -> DataFrame:
    """(evidence_id, outcome, verifications): the last outcome by time, then id, and how many there are."""
    return records.groupBy("evidence_id").agg(F.max_by("outcome", F.struct("verified_at", "verification_id")).alias("outcome"), F.count(F.lit(1)).alias("verifications"))


def activity_valid(started: Column, ended: Column, description: Column) -> Column:
    return F.coalesce((ended.isNull() | (started <= ended)) & valid_label(description), F.lit(False))


def origin_code(source: Column, reference: Column, version: Column, locator: Column) -> Column:
    return F.when(version.isNotNull() & source.isNull(), "version-without-source").when(locator.isNotNull() & reference.isNull(), "locator-without-reference")


def append_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """Provenance of targets with new activities; an activity is recorded once for a target."""
    fresh = new.dropDuplicates(["target_id", "activity_id"]).join(history, ["target_id", "activity_id"], "left_anti")
    return history.unionByName(fresh.select(*history.columns))


def append_lineage(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """(from_id, to_id, kind) links with new ones: none to itself, each once."""
    return lineage.unionByName(new.where("from_id <> to_id").select(*lineage.columns)).distinct()


def append_audit(audit: DataFrame, new: DataFrame) -> DataFrame:
    return audit.unionByName(new.select(*audit.columns)).distinct()


def authority_code(owner_kind: Column, owner_id: Column, target_kind: Column, target_id: Column, dimensions: Column) -> Column:
    """An authority belongs to its own source or assertion and says something."""
    return F.when((owner_kind != target_kind) | (owner_id != target_id), "target-mismatch").when(F.coalesce(F.size(dimensions), F.lit(0)) <= 0, "no-dimension")


def confidence_valid(form: Column, score: Column, label: Column, basis: Column) -> Column:
    """Numeric scores are finite and within 0 and 1, qualitative ones have a label, and every assessment has a basis."""
    numeric = score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)
    known = F.when(form == "numeric", numeric).when(form == "qualitative", valid_label(label)).otherwise(form == "unknown")
    return F.coalesce(known & (F.size(basis) > 0), F.lit(False))


def confidence_assessment(form: Column, score: Column, label: Column, evidence_ids: Column, verification_ids: Column, explanation: Column) -> Column:
    """The assessment as a record: form, score or label, and its basis of evidence, verifications and an explanation, each id
    once and in order; null where it isn't valid or its basis is empty."""
    nothing = F.expr("cast(array() as array<string>)")
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, nothing)))
    basis = F.concat(ids(evidence_ids), ids(verification_ids), F.filter(F.array(explanation), lambda x: x.isNotNull()))
    valid = confidence_valid(form, score, label, basis) & F.coalesce(explanation.isNull() | valid_label(explanation), F.lit(False))
    record = F.struct(
        form.alias("form"),
        F.when(form == "numeric", score).alias("score"),
        F.when(form == "qualitative", label).alias("label"),
        F.struct(ids(evidence_ids).alias("evidence_ids"), ids(verification_ids).alias("verification_ids"), explanation.alias("explanation")).alias("basis"),
    )
    return F.when(valid, record)


def is_epistemic(status: Column) -> Column:
    return F.coalesce(status.isin(*EPISTEMIC_STATUSES), F.lit(False))


def relationship_code(predicate: Column, inverse: Column, characteristics: Column) -> Column:
    """No inverse of itself; symmetric and asymmetric exclude each other."""
    both = F.array_contains(characteristics, "symmetric") & F.array_contains(characteristics, "asymmetric")
    return F.when(~valid_label(predicate), "invalid-predicate").when(inverse == predicate, "self-inverse").when(F.coalesce(both, F.lit(False)), "conflicting-characteristics")


def register_relationships(known: DataFrame, new: DataFrame) -> DataFrame:
    out = known.unionByName(new)
    if not out.groupBy("predicate").count().where("count > 1").isEmpty():
        raise ValueError("a relationship is registered already")
    return out


def reversed_relationships(known: DataFrame) -> DataFrame:
    """The declared inverses as relationships of their own, pointing back."""
    return known.where("inverse IS NOT NULL").select(F.col("inverse").alias("predicate"), F.col("predicate").alias("inverse"), (~F.col("reversed")).alias("reversed"))


def compositions(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Declared composition rules (first, second, result) with whether all three are registered; they are not executed."""
    names = known.select("predicate")
    out = rules.withColumn("declared", F.lit(True))
    for column in ("first", "second", "result"):
        flag = names.withColumnRenamed("predicate", column).withColumn(f"has_{column}", F.lit(True))
        out = out.join(flag, column, "left")
    return out.select("first", "second", "result", (F.col("has_first").isNotNull() & F.col("has_second").isNotNull() & F.col("has_result").isNotNull()).alias("registered"))
