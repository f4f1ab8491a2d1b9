"""Bounded rule reasoning: each rule compiles to a chain of joins over the assertion table.

A premise is a filtered scan projected to its variables; premises join on the variables they share. Conditions, typed
bindings and scope are filters, the conclusion a projection, so Catalyst plans the whole rule. Derived conclusions are
provisional and premises match accepted or known assertions alone, so a run derives one step from the explicit ones.

``derive`` has no budgets and stays distributed. ``reason`` adds a profile's budgets, which cut in the order of
(rule, premises by assertion id); what they let through is bounded by the profile.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import assertion_id, predicate_local
from factloom.operators.lineage import cut
from factloom.plans import rules as r
from factloom.schema import ASSERTION, PAIRS


def _term(term: r.Term) -> Column:
    """A term as struct<kind, id>: text has the kind text, so it never equals an object."""
    if isinstance(term, r.Var):
        return F.col(f"v_{term.name}")
    kind, id_ = ("text", term.value) if isinstance(term, r.Text) else (term.kind, term.id)
    return F.struct(F.lit(kind).alias("kind"), F.lit(id_).alias("id"))


def usable(assertions: DataFrame) -> DataFrame:
    """What premises may match: positive, and accepted or known."""
    return assertions.where((F.col("polarity") == "positive") & F.col("status").isin("accepted", "known"))


def match_premise(pattern: r.Pattern, assertions: DataFrame, number: int = 0) -> DataFrame:
    """The premise's variables as v_<name> and the assertion as p<number>."""
    sides = {
        "subject": F.struct(F.col("subject.kind").alias("kind"), F.col("subject.id").alias("id")),
        "predicate": F.struct(F.lit("text").alias("kind"), predicate_local(F.col("predicate")).alias("id")),
        "object": F.struct(F.col("object.kind").alias("kind"), F.col("object.id").alias("id")),
    }
    kept, variables = usable(assertions), {}
    for side, term in zip(sides, pattern.terms):
        if isinstance(term, r.Var):
            if term.name in variables:
                kept = kept.where(sides[side] == variables[term.name])
            variables.setdefault(term.name, sides[side])
        elif isinstance(term, r.Text) and side == "predicate":
            kept = kept.where(predicate_local(F.col("predicate")) == term.value)
        elif isinstance(term, r.Obj) and side != "predicate":
            kept = kept.where((F.col(f"{side}.kind") == term.kind) & (F.col(f"{side}.id") == term.id))
        else:
            kept = kept.where(F.lit(False))
    whole = F.struct("assertion_id", "predicate", "context", "qualifiers", "polarity").alias(f"p{number}")
    return kept.select(*[c.alias(f"v_{name}") for name, c in variables.items()], whole)


def match_premises(rule: r.Rule, assertions: DataFrame, independent: bool = False) -> DataFrame:
    """Every way to match all premises: v_<variable> columns and p0, p1, ...

    Premises are joined on the variables they share. Those that share none give every combination, which a rule may mean but
    only ``independent`` allows.
    """
    found = match_premise(rule.premises[0], assertions, 0)
    for i, premise in enumerate(rule.premises[1:], 1):
        more = match_premise(premise, assertions, i)
        shared = [c for c in more.columns if c.startswith("v_") and c in found.columns]
        if not shared and not independent:
            raise r.RuleError("premises that share no variable multiply; pass independent=True to allow it")
        found = found.join(more, shared) if shared else found.join(more, F.lit(True))
    for condition in rule.conditions:
        found = found.where(_condition(condition, len(rule.premises)))
    return found


def _condition(condition: r.Condition, premises: int) -> Column:
    if isinstance(condition, r.Equal):
        return _term(condition.left).eqNullSafe(_term(condition.right))
    if isinstance(condition, r.NotEqual):
        return ~_term(condition.left).eqNullSafe(_term(condition.right))
    if isinstance(condition, r.PredicateIs):
        return reduce(lambda a, b: a | b, [predicate_local(F.col(f"p{i}.predicate")) == condition.name for i in range(premises)])
    return F.col(f"v_{condition.variable}.kind") == condition.kind


def merged_context(contexts: list[Column]) -> Column:
    """Premises' contexts in order: the first value of a key stays, a later one that differs becomes premise.<i>.<key>."""

    def numbered(number: int, context: Column) -> Column:
        return F.transform(context, lambda e: F.struct(F.lit(number).alias("i"), e["k"].alias("k"), e["v"].alias("v")))

    entries = F.flatten(F.array(*[numbered(i, c) for i, c in enumerate(contexts)]))
    empty = F.expr(f"cast(array() as {PAIRS})")

    def put(out: Column, key: Column, value: Column) -> Column:
        return F.concat(F.filter(out, lambda e: e["k"] != key), F.array(F.struct(key.alias("k"), value.alias("v"))))

    def step(out: Column, x: Column) -> Column:
        there = F.filter(out, lambda e: e["k"] == x["k"])
        renamed = F.concat(F.lit("premise."), x["i"].cast("string"), F.lit("."), x["k"])
        differs = F.exists(there, lambda e: e["v"] != x["v"])
        return F.when(differs, put(out, renamed, x["v"])).when(F.size(there) > 0, out).otherwise(put(out, x["k"], x["v"]))

    return F.array_sort(F.aggregate(entries, empty, step))


def apply_rule(rule: r.Rule, assertions: DataFrame, depth: int = 0, scoped: bool = True) -> DataFrame:
    """Applications of a rule: (rule_id, version, depth, premise_ids, in_scope, and the conclusion's assertion columns)."""
    rule.validate()
    found = match_premises(rule, assertions, rule.independent)
    n = len(rule.premises)
    kinds = [v for v in sorted(set().union(*(p.variables() for p in rule.premises)))]
    subject, predicate, object_ = (_term(t) for t in rule.conclusion.terms)
    good = F.lit(True)
    if rule.scope.predicates:
        good = good & predicate["id"].isin(*rule.scope.predicates)
    if rule.scope.object_kinds:
        allowed = list(rule.scope.object_kinds)
        good = good & object_["kind"].isin(*allowed)
        for v in kinds:
            good = good & (F.col(f"v_{v}.kind").isin("text", *allowed))
    for variable, kind in rule.bindings:
        if kind is not None:
            good = good & (F.col(f"v_{variable}.kind") == kind)
    # A conclusion must be an object, a text and an object; others can't be grounded.
    good = good & (subject["kind"] != "text") & (object_["kind"] != "text") & (predicate["kind"] == "text")
    context = merged_context([F.col(f"p{i}.context") for i in range(n)]) if n > 1 else F.array_sort("p0.context")
    qualifiers = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"p{i}.qualifiers") for i in range(n)]))))
    polarity = F.col("p0.polarity")
    conclusion = {
        "assertion_id": assertion_id(subject, predicate["id"], object_, context, qualifiers, polarity),
        "subject": subject,
        "predicate": predicate["id"],
        "object": object_,
        "context": context,
        "qualifiers": qualifiers,
        "status": F.lit("provisional"),
        "polarity": polarity,
        "inference": F.lit("inferred"),
    }
    columns = [conclusion.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ASSERTION.items()]
    out = found.select(
        F.lit(rule.id).alias("rule_id"),
        F.lit(".".join(map(str, rule.version))).alias("version"),
        F.lit(depth).alias("depth"),
        F.array(*[F.col(f"p{i}.assertion_id") for i in range(n)]).alias("premise_ids"),
        F.coalesce(good, F.lit(False)).alias("in_scope"),
        *columns,
    )
    return out.where("in_scope") if scoped else out


def apply_rules(rules: list[r.Rule], assertions: DataFrame, depth: int = 0, scoped: bool = True) -> DataFrame:
    parts = [apply_rule(rule, assertions, depth, scoped).withColumn("rule_no", F.lit(i)) for i, rule in enumerate(sorted(rules, key=r.Rule.structural_key))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def deduplicated(applications: DataFrame) -> DataFrame:
    return applications.dropDuplicates(["assertion_id", "rule_id", "version", "premise_ids"])


def derive(rules: list[r.Rule], assertions: DataFrame) -> DataFrame:
    """All applications of all rules, without budgets."""
    return deduplicated(apply_rules(rules, assertions))


#: Type of a conclusion's traces.
TRACES = "array<struct<rule_id:string,version:string,premise_ids:array<string>,profile:string,snapshot:string,input_version:bigint,depth:int>>"


def derived_set(applications: DataFrame, profile: str | None = None, snapshot: str | None = None, version: int | None = None) -> DataFrame:
    """A row for each conclusion, with its distinct derivation traces: rule and version, premises, depth, and the profile,
    snapshot and version of the knowledge it was derived from, where given."""
    pinned = [F.lit(x).cast(kind).alias(name) for x, kind, name in ((profile, "string", "profile"), (snapshot, "string", "snapshot"), (version, "bigint", "input_version"))]
    trace = F.struct("rule_id", "version", "premise_ids", *pinned, F.col("depth"))
    others = [F.first(name).alias(name) for name in ASSERTION if name != "assertion_id"]
    return applications.groupBy("assertion_id").agg(F.array_sort(F.collect_set(trace)).alias("traces"), *others)


def may_match(goal: r.Pattern) -> Column:
    """Whether an assertion fits a goal pattern; variables fit anything."""
    out = F.lit(True)
    for side, term in zip(("subject", "predicate", "object"), goal.terms):
        if isinstance(term, r.Var):
            continue
        if side == "predicate":
            out = out & (predicate_local(F.col("predicate")) == term.value if isinstance(term, r.Text) else F.lit(False))
        else:
            out = out & ((F.col(f"{side}.kind") == term.kind) & (F.col(f"{side}.id") == term.id) if isinstance(term, r.Obj) else F.lit(False))
    return out


def conflicts(assertions: DataFrame) -> DataFrame:
    """(positive, negative): the last positive and the last negative assertion of one subject, predicate, object, context and qualifiers."""
    key = ["subject", "predicate", "object", "context", "qualifiers"]
    sides = assertions.groupBy(*key).agg(
        F.max(F.when(F.col("polarity") == "positive", F.col("assertion_id"))).alias("positive"),
        F.max(F.when(F.col("polarity") == "negative", F.col("assertion_id"))).alias("negative"),
    )
    return sides.where("positive IS NOT NULL AND negative IS NOT NULL").select("positive", "negative")


@dataclass
class Reasoned:
    derived: DataFrame
    conflicts: DataFrame
    status: str
    message: str | None
    applications: int
    expanded: int


def reason(
    assertions: DataFrame,
    registry: r.Registry,
    profile: str,
    goal: r.Pattern | None = None,
    seconds: float | None = None,
    snapshot: str | None = None,
    version: int | None = None,
    budgets: r.Budgets | None = None,
) -> Reasoned:
    """A budgeted run. The goal filters the assertions themselves and prunes rules that can't reach it.

    ``seconds`` limits the driver's wall clock: a run past it when its matches are counted derives nothing. The profiles'
    own seconds are meant for one process and would make results depend on the cluster, so they apply only when passed.
    ``snapshot`` and ``version`` name the knowledge the run reads and are written into the traces.
    ``budgets`` stand in for the profile's, up to the ceiling over all of them.
    """
    if profile not in r.PROFILES:
        raise r.RuleError("reasoning is disabled" if profile == "none" else f"unknown profile {profile!r}")
    own, kinds = r.PROFILES[profile]
    budgets = budgets or own
    budgets.validate()
    deadline = None if seconds is None else time.monotonic() + seconds
    working = assertions.where(may_match(goal)) if goal else assertions
    size = working.limit(budgets.max_expansion + 1).count()
    status, message = "complete", None
    if size > budgets.max_expansion:
        working, size = working.orderBy("assertion_id").limit(budgets.max_expansion), budgets.max_expansion
        status, message = "incomplete", "expansion input truncated"
    rules = [x for x in registry.eligible() if x.kind in kinds and (goal is None or r.may_reach(x, goal))]
    empty = assertions.limit(0).withColumn("traces", F.expr(f"cast(array() as {TRACES})"))
    if not rules:
        return Reasoned(empty, conflicts(assertions), status, message, 0, size)
    order = ["rule_no", "premise_ids"]
    matches = apply_rules(rules, working, scoped=False).orderBy(*order).limit(budgets.max_applications + 1)
    numbered = matches.withColumn("n", F.row_number().over(Window.orderBy(*order))).persist()
    n_matches = numbered.count()
    if deadline is not None and time.monotonic() >= deadline:
        return Reasoned(empty, conflicts(assertions), "incomplete", "execution time budget exceeded", 0, size)
    kept = deduplicated(numbered.where((F.col("n") <= budgets.max_applications) & F.col("in_scope")))
    known = working.select("assertion_id", F.lit(True).alias("known"))
    kept = kept.join(known, "assertion_id", "left").withColumn("is_new", F.col("known").isNull())
    # A new conclusion is refused once as many conclusions as a limit allows, new or known, are derived; the run ends there.
    one = F.when(F.row_number().over(Window.partitionBy("assertion_id").orderBy("n")) == 1, 1).otherwise(0)
    counted = kept.select("n", "assertion_id", "is_new", one.alias("one"))
    counted = counted.withColumn("before", F.sum("one").over(Window.orderBy("n")) - F.col("one"))
    limit = min(budgets.max_derived, budgets.result_limit)
    cut_at = counted.where(F.col("is_new") & (F.col("before") >= limit)).agg(F.min("n")).first()[0]
    applied = kept if cut_at is None else kept.where(F.col("n") < cut_at)
    new = applied.where("is_new").select("assertion_id").distinct().count()
    if cut_at is not None:
        reached = "derived-assertion budget exceeded" if limit == budgets.max_derived else "result limit exceeded; derived output truncated"
        status, message = "incomplete", reached
    elif new and size + new > budgets.max_expansion:
        status, message = "incomplete", "expansion budget exceeded"
    # What matches again in the next round counts against the budget too.
    elif n_matches > budgets.max_applications or (new and 2 * n_matches > budgets.max_applications):
        status, message = "incomplete", message or "execution budget exhausted during premise matching"
    derived = derived_set(applied, profile, snapshot, version)
    out = derived.select(*ASSERTION, "traces")
    both = assertions.select(*ASSERTION).unionByName(out.select(*ASSERTION))
    return Reasoned(out, conflicts(both), status, message, applied.count(), size)


def closure(rule: r.Rule, assertions: DataFrame, max_depth: int = 16) -> DataFrame:
    """An addition of ours: the transitive closure of a two-premise rule, derived facts taken as accepted each round."""
    known = assertions
    for _ in range(max_depth):
        new = derived_set(apply_rule(rule, known)).drop("traces").withColumn("status", F.lit("accepted"))
        new = cut(new.join(known.select("assertion_id"), "assertion_id", "left_anti").select(*ASSERTION))
        if new.isEmpty():
            break
        known = known.select(*ASSERTION).unionByName(new)
    return known
