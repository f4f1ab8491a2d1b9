"""Versions, compatibility and migrations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE_KINDS = ("created", "updated", "corrected", "retracted", "superseded", "merged", "split")
DIMENSIONS = ("schema", "ontology", "rules", "index", "storage", "api")
LEVELS = ("compatible", "migration-required", "incompatible")


def latest(changes: DataFrame) -> DataFrame:
    """(target_kind, target_id, kind, seq): the last change of every target; nothing is ever removed by one."""
    return changes.groupBy("target_kind", "target_id").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def replayed(changes: DataFrame, after: Column | int = -1) -> DataFrame:
    """Last write wins over the journal's changes after a version: (target, content, version)."""
    kept = changes.where(F.col("version") > (after if isinstance(after, Column) else F.lit(after)))
    return kept.groupBy("target").agg(F.max_by("content", F.struct("version", "seq")).alias("content"), F.max("version").alias("version"))


def chain_breaks(commits: DataFrame) -> DataFrame:
    """Commits (version, base) whose base is no commit's version; the first commit, of the least version, has none before it."""
    known = commits.select(F.col("version").alias("base")).distinct()
    loose = commits.join(known, "base", "left_anti")
    least = commits.agg(F.min("version").alias("least"))
    return loose.join(F.broadcast(least), F.col("version") > F.col("least")).select("version", "base")


def commit_codes(commits: DataFrame, changes: DataFrame, records: DataFrame) -> DataFrame:
    """(version, code) of recovery commits: what keeps one from being replayed, null if nothing does.

    commits: (version, base, parent, change_set, change_set_base, named_change_set); changes: (change_set, kind, id);
    records: (version, kind, id). Checked in this order: the change set has changes, starts from the base, the version's parent
    is the base and names the change set, and every record's target is among the changes.
    """
    sizes = changes.groupBy("change_set").agg(F.count(F.lit(1)).alias("changes"))
    targets = changes.select("change_set", "kind", "id").distinct()
    strange = records.join(commits.select("version", "change_set"), "version").join(targets, ["change_set", "kind", "id"], "left_anti")
    strange = strange.groupBy("version").agg(F.count(F.lit(1)).alias("strange"))
    joined = commits.join(sizes, "change_set", "left").join(strange, "version", "left")
    code = (
        F.when(F.col("changes").isNull(), "empty-change-set")
        .when(~F.col("change_set_base").eqNullSafe(F.col("base")), "change-set-base-mismatch")
        .when(~F.col("parent").eqNullSafe(F.col("base")), "parent-mismatch")
        .when(~F.col("named_change_set").eqNullSafe(F.col("change_set")), "change-set-mismatch")
        .when(F.col("strange").isNotNull(), "record-not-in-change-set")
    )
    return joined.select("version", code.alias("code"))


def compatibility(results: DataFrame) -> DataFrame:
    """(pair, all_compatible, any_incompatible, first_incompatible) from (pair, dimension, level)."""
    number = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    bad = F.col("level") == "incompatible"
    return results.groupBy("pair").agg(
        F.bool_and(F.col("level") == "compatible").alias("all_compatible"),
        F.bool_or(bad).alias("any_incompatible"),
        F.min_by(F.when(bad, F.col("dimension")), F.when(bad, number)).alias("first_incompatible"),
    )


class MigrationError(ValueError):
    """A migration that can't be run."""


@dataclass(frozen=True)
class Migration:
    start: int
    end: int
    apply: Callable[[DataFrame], DataFrame]
    verify: Callable[[DataFrame], bool]


def plan(steps: list[Migration], start: int, end: int) -> list[Migration]:
    """Steps that lead from one version to another without a gap."""
    order, at = [], start
    for step in sorted(steps, key=lambda s: s.start):
        if step.start == at and step.end > at:
            order.append(step)
            at = step.end
    if at != end:
        raise MigrationError(f"no step leads on from version {at}")
    return order


def migrate(table: DataFrame, steps: list[Migration], activate: Callable[[DataFrame], None]) -> DataFrame:
    """All steps applied and verified; only then is the result activated."""
    for step in steps:
        table = step.apply(table)
        if not step.verify(table):
            raise MigrationError(f"version {step.end} was not verified")
    activate(table)
    return table
