"""Contradictions between assertions, their records, and the view without actively contradicted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.temporal import definitely_disjoint

KINDS = ("opposed-polarity", "functional-value-conflict")
STATUSES = ("detected", "under-review", "confirmed", "resolved", "dismissed")


class ContradictionError(ValueError):
    """A contradiction record that is not valid."""


def detect(assertions: DataFrame, functional: list[str]) -> DataFrame:
    """(left_id, right_id, kind), left before right: same subject, predicate, context and qualifiers, times that may meet,
    and opposed polarity of one object, or different objects of a functional predicate.

    Two equi-joins instead of one with alternatives: opposed polarity meets on the object too, so neither multiplies rows
    that can't contradict. The pairs of the functional join are the result itself.
    """
    base = assertions.select("assertion_id", "subject", "predicate", "object", "context", "qualifiers", "polarity", "validity")
    key = ["subject", "predicate", "context", "qualifiers"]

    def side(df: DataFrame, name: str, extra: list[str]) -> DataFrame:
        return df.select(*key, *extra, F.col("assertion_id").alias(f"{name}_id"), F.col("object").alias(f"{name}_object"), F.col("validity").alias(f"{name}_validity"))

    positive = base.where("polarity = 'positive'")
    negative = base.where("polarity = 'negative'")
    apart = definitely_disjoint(F.col("a_validity"), F.col("b_validity"))
    opposed = side(positive, "a", ["object"]).join(side(negative, "b", ["object"]), [*key, "object"])
    opposed = opposed.where((F.col("a_id") != F.col("b_id")) & ~apart).select("a_id", "b_id", F.lit(KINDS[0]).alias("kind"))
    values = positive.where(F.col("predicate").isin(*functional)) if functional else positive.limit(0)
    valued = side(values, "a", []).join(side(values, "b", []), key).where((F.col("a_id") < F.col("b_id")) & (F.col("a_object") != F.col("b_object")) & ~apart)
    both = opposed.unionByName(valued.select("a_id", "b_id", F.lit(KINDS[1]).alias("kind")))
    return both.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "kind")


def functional_conflicts(assertions: DataFrame, functional: list[str]) -> DataFrame:
    """(subject, predicate, context, qualifiers, assertions, values, pairs) of every group with a functional conflict: how many
    pairs of its assertions ``detect`` finds, without listing them.

    All pairs of different values, less those whose times certainly don't meet. The latter are counted by a sweep over the
    group's times in order (a start counts the ends that lie before it), for the group and for each value in it, so a subject
    with n values costs n log n instead of n * n.
    """
    key = ["subject", "predicate", "context", "qualifiers"]
    rows = assertions.where((F.col("polarity") == "positive") & F.col("predicate").isin(*functional)) if functional else assertions.limit(0)
    rows = rows.select(*key, "object", "validity")
    values = rows.groupBy(*key, "object").agg(F.count(F.lit(1)).alias("n"))
    sizes = values.groupBy(*key).agg(F.sum("n").alias("assertions"), F.count(F.lit(1)).alias("values"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    v = F.col("validity")
    # At one instant: an exclusive end, an inclusive start, an inclusive end, an exclusive start.
    start = F.struct(v["start"].alias("at"), F.when(v["start_kind"] == "inclusive", 1).otherwise(3).alias("rank"), F.lit(0).alias("ends"))
    end = F.struct(v["end"].alias("at"), F.when(v["end_kind"] == "inclusive", 2).otherwise(0).alias("rank"), F.lit(1).alias("ends"))
    times = rows.where(v["tag"].isin("instant", "interval", "open-ended")).select(*key, "object", F.explode(F.array(start, end)).alias("t")).where("t.at IS NOT NULL")

    def apart(names: list[str]) -> DataFrame:
        before = F.sum("t.ends").over(Window.partitionBy(*names).orderBy("t.at", "t.rank"))
        counted = times.select(*names, "t", before.alias("before")).where("t.ends = 0")
        return counted.groupBy(*names).agg(F.sum("before").alias("apart"))

    within = apart([*key, "object"]).groupBy(*key).agg(F.sum("apart").alias("within"))
    joined = sizes.join(apart(key), key, "left").join(within, key, "left")
    pairs = (F.col("assertions") * F.col("assertions") - F.col("squares")) / 2 - F.coalesce("apart", F.lit(0)) + F.coalesce("within", F.lit(0))
    return joined.select(*key, "assertions", "values", pairs.cast("bigint").alias("pairs")).where("pairs > 0")


def records(findings: DataFrame) -> DataFrame:
    """Findings as contradiction records (contradiction_id, assertion_ids, kind, status)."""
    ids = F.array_sort(F.array_distinct(F.array("left_id", "right_id")))
    rows = findings.select(ids.alias("assertion_ids"), "kind").where(F.size("assertion_ids") >= 2)
    return rows.select(F.sha2(F.concat_ws("|", F.col("kind"), F.concat_ws("|", "assertion_ids")), 256).alias("contradiction_id"), "assertion_ids", "kind", F.lit("detected").alias("status"))


def insert(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known records with others; an id that is there already is an error."""
    if not known.join(new, "contradiction_id", "left_semi").isEmpty():
        raise ContradictionError("a contradiction is recorded already")
    return known.unionByName(new)


def update_status(known: DataFrame, contradiction_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ContradictionError(f"unknown status {status!r}")
    return known.withColumn("status", F.when(F.col("contradiction_id") == contradiction_id, status).otherwise(F.col("status")))


def by_assertion(known: DataFrame) -> DataFrame:
    """(assertion_id, contradictions, active): how many records an assertion is in, and whether one is not dismissed."""
    rows = known.select(F.explode("assertion_ids").alias("assertion_id"), "status")
    return rows.groupBy("assertion_id").agg(F.count(F.lit(1)).alias("contradictions"), F.bool_or(F.col("status") != "dismissed").alias("active"))


def current_view(assertions: DataFrame, known: DataFrame, exclude_active: bool = True) -> DataFrame:
    """All assertions, or those in no active contradiction."""
    if not exclude_active:
        return assertions
    active = known.where("status <> 'dismissed'").select(F.explode("assertion_ids").alias("assertion_id")).distinct()
    return assertions.join(active, "assertion_id", "left_anti")
