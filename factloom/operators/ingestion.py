"""Governed ingestion as DataFrame stages: mapping, deduplication, validation, approval, publication, synchronisation.

Candidates carry (source_id, record_key, version, ordinal) as their key. Every gate gives the first code that fails, as
a column, so a batch keeps accepted and refused candidates side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.arrays import running
from factloom.functions.text import valid_label, whitespace_mode

KEY = ["source_id", "record_key", "version", "ordinal"]

# The core stages in order, the candidate and governance states with their transitions.
STAGES = (
    "raw-capture", "raw-validation", "normalization", "semantic-mapping", "source-deduplication", "entity-resolution",
    "semantic-validation", "semantic-deduplication", "approval", "indexing-readiness", "publication", "indexing-synchronization",
)
CANDIDATE_STEPS = {
    "received": ("normalized", "quarantined", "blocked"),
    "normalized": ("mapped", "quarantined", "blocked"),
    "mapped": ("source-deduplicated", "resolved", "quarantined", "blocked"),
    "source-deduplicated": ("resolved", "semantic-validated", "quarantined", "blocked"),
    "resolved": ("semantic-validated", "quarantined", "blocked"),
    "semantic-validated": ("awaiting-approval", "quarantined", "blocked", "rejected"),
    "quarantined": ("rejected", "blocked"),
    "awaiting-approval": ("approved", "rejected", "quarantined", "blocked"),
    "approved": ("ready-for-publication", "rejected", "blocked"),
    "ready-for-publication": ("published", "blocked"),
    "published": ("synchronization-pending", "synchronized", "synchronization-failed", "withdrawn"),
    "synchronization-pending": ("synchronized", "synchronization-failed"),
    "synchronization-failed": ("synchronization-pending", "synchronized", "withdrawn"),
    "synchronized": ("withdrawn",),
    "blocked": (),
    "rejected": (),
    "withdrawn": (),
}
GOVERNANCE_STEPS = {
    "awaiting-validation": ("quarantined", "blocked", "awaiting-approval", "rejected"),
    "quarantined": ("awaiting-validation", "awaiting-approval", "rejected", "blocked"),
    "awaiting-approval": ("approved", "rejected", "quarantined", "blocked"),
    "approved": ("withdrawn",),
    "blocked": (),
    "rejected": (),
    "withdrawn": (),
}
TERMINAL = ("blocked", "rejected", "withdrawn", "quarantined", "synchronized")
SEVERITIES = ("info", "warning", "error", "fatal")


class IngestionError(ValueError):
    """An ingestion step that isn't allowed."""


def allowed(steps: dict[str, tuple[str, ...]], from_: Column, to: Column) -> Column:
    """Whether a transition is in the table."""
    table = F.create_map(*[x for s, t in steps.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in t]) if t else F.expr("cast(array() as array<string>)"))])
    return F.coalesce(F.array_contains(F.element_at(table, from_), to), F.lit(False))


def _folded(events: DataFrame, steps: dict[str, tuple[str, ...]], keys: list[str], order: str, state: str) -> DataFrame:
    """(keys, rows, after): each candidate's events in order, and the number of its state after each (0 before the first).

    An event is a function from state to state, the identity where the step is refused; functions compose, so the state after
    every event is a running composition applied to 0. A candidate's log is one row, in memory of one task.
    """
    names = list(steps)
    number = {name: i + 1 for i, name in enumerate(names)}
    same = F.array(*[F.lit(i) for i in range(len(names) + 1)])

    def function(to: str) -> Column:
        before = [0, *(number[name] for name in names)]
        allowed_from = {number[name] for name in names if to in steps[name]} | ({0} if to == names[0] else set())
        return F.array(*[F.lit(number[to] if i in allowed_from else i) for i in before])

    functions = F.create_map(*[x for name in names for x in (F.lit(name), function(name))])
    row = F.struct(F.col(order).alias("at"), F.col(state).alias("to"), F.struct("*").alias("event"))
    by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    grouped = events.groupBy(*keys).agg(F.array_sort(F.collect_list(row), by_place).alias("rows"))
    moves = F.transform("rows", lambda x: F.coalesce(F.element_at(functions, x["to"]), same))
    after = F.transform(running(moves, same, lambda a, b: F.transform(a, lambda i: F.get(b, i))), lambda x: F.get(x, F.lit(0)))
    return grouped.withColumn("after", after)


def transitions(events: DataFrame, steps: dict[str, tuple[str, ...]], keys: list[str], order: str, state: str = "state") -> DataFrame:
    """Events with the candidate's state before and whether the step was allowed. The first state of the table starts a life;
    a refused event leaves the state as it was."""
    names = F.array(*[F.lit(name) for name in steps])
    rows = _folded(events, steps, keys, order, state)
    both = F.transform("rows", lambda x, i: F.struct(x["event"].alias("event"), F.when(i == 0, F.lit(0)).otherwise(F.get("after", i - 1)).alias("was"), F.get("after", i).alias("now")))
    out = rows.select(F.explode(both).alias("x"))
    before = F.when(F.col("x.was") > 0, F.element_at(names, F.greatest(F.col("x.was"), F.lit(1))))
    return out.select("x.event.*", before.alias("before"), (F.col("x.was") != F.col("x.now")).alias("allowed"))


def current_states(events: DataFrame, steps: dict[str, tuple[str, ...]], keys: list[str], order: str, state: str = "state") -> DataFrame:
    """(keys, state) after all events, refused ones left out; a candidate whose life never started has none."""
    names = F.array(*[F.lit(name) for name in steps])
    last = F.element_at("after", -1)
    rows = _folded(events, steps, keys, order, state).where(last > 0)
    return rows.select(*keys, F.element_at(names, F.greatest(last, F.lit(1))).alias(state))


#: The states of a run.
RUN_STATES = ("created", "running", "completed", "completed-with-issues", "failed", "cancelled")


@dataclass
class Run:
    """One ingestion run over one version of a source: what it registers comes from there, and nothing after its end."""

    operation_id: str
    source_id: str
    source_class: str
    source_version: str | None
    state: str = "created"
    error: str | None = None

    def __post_init__(self) -> None:
        if not all(valid_text(x) for x in (self.operation_id, self.source_id, self.source_class)):
            raise IngestionError("a run needs an operation, a source and a source class")

    def begin(self) -> None:
        if self.state != "created":
            raise IngestionError(f"the run is {self.state}")
        self.state = "running"

    def _running(self) -> None:
        if self.state != "running":
            raise IngestionError(f"the run is {self.state}")

    def judged(self, candidates: DataFrame, registered: DataFrame | None = None) -> DataFrame:
        """Candidates (key, source_class) with ``code``: those of another source, version or class and those that are
        registered already are refused; of equal keys in one batch one is registered, which one is open."""
        self._running()
        own = (F.col("source_id") == self.source_id) & F.col("version").eqNullSafe(F.lit(self.source_version)) & (F.col("source_class") == self.source_class)
        rows = candidates.withColumn("own", F.coalesce(own, F.lit(False)))
        again = F.row_number().over(Window.partitionBy(*KEY, "own").orderBy(F.lit(0))) > 1
        rows = rows.withColumn("again", again)
        if registered is not None:
            there = registered.select(*[F.col(k).alias(f"r_{k}") for k in KEY], F.lit(True).alias("there")).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEY]
            rows = rows.join(there, same, "left").withColumn("again", F.col("again") | F.col("there").isNotNull()).drop("there", *[f"r_{k}" for k in KEY])
        code = F.when(~F.col("own"), "candidate-run-mismatch").when(F.col("again"), "duplicate-candidate")
        return rows.withColumn("code", code).drop("own", "again")

    def register(self, candidates: DataFrame, registered: DataFrame | None = None) -> DataFrame:
        """The registered candidates with a batch added, each in state received; a batch with a refused one is an error."""
        judged = self.judged(candidates, registered)
        if not judged.where("code IS NOT NULL").isEmpty():
            raise IngestionError("a candidate is not of this run, or is registered already")
        new = judged.select(*KEY, F.lit("received").alias("state"))
        return new if registered is None else registered.select(*KEY, "state").unionByName(new)

    def finish(self, outcome: str, candidates: DataFrame) -> None:
        """Ends the run; it is completed only if every candidate (state) is synchronised."""
        self._running()
        if outcome not in RUN_STATES[2:]:
            raise IngestionError(f"{outcome!r} is not an outcome")
        if outcome == "completed" and not candidates.where("NOT (state <=> 'synchronized')").isEmpty():
            raise IngestionError("a candidate is not synchronised")
        self.state = outcome

    def fail(self, reason: str) -> None:
        """A failure of the run itself; its candidates keep their states."""
        self._running()
        if not valid_text(reason):
            raise IngestionError("a failure needs a reason")
        self.state, self.error = "failed", reason


@dataclass
class Pipeline:
    """A run's plan: the core stages in order, each followed by its hooks by name."""

    stages: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    hooks: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def stage(self, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        if name not in STAGES or name in self.stages:
            raise IngestionError(f"{name!r} is not a stage, or has one already")
        self.stages[name] = step

    def hook(self, after: str, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        if after not in STAGES:
            raise IngestionError(f"{after!r} is not a stage")
        if any(name in named for named in self.hooks.values()):
            raise IngestionError(f"hook {name!r} is there already")
        self.hooks.setdefault(after, {})[name] = step

    def plan(self) -> list[str]:
        return [x for s in STAGES for x in (s, *sorted(self.hooks.get(s, {})))]

    def run(self, rows: DataFrame) -> DataFrame:
        for name in STAGES:
            rows = self.stages.get(name, lambda df: df)(rows)
            for hook in sorted(self.hooks.get(name, {})):
                rows = self.hooks[name][hook](rows)
        return rows


def check_log(log: DataFrame, planned: Sequence[str] = STAGES) -> DataFrame:
    """Stage executions (run_id, candidate, seq, stage, attempt, outcome, started, ended) with the first code that fails:
    attempts from one, times in order, a stage of the plan, nothing after a terminal state (column ``terminal``), and the
    stage that follows the last one that succeeded or was skipped. A refused execution changes nothing, so a failed stage may
    be tried again and a done one may not. A null seq is judged as a first execution and changes nothing.

    The places at which the plan's stages were done, at most one for each, are folded from a candidate's successes.
    """
    key = ["run_id", "candidate"]
    number = F.array_position(F.array(*[F.lit(s) for s in planned]), F.col("stage"))
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = F.max(F.col("terminal").cast("int")).over(before) == 1
    code = (
        F.when(F.col("attempt") < 1, "invalid-attempt")
        .when(F.col("ended") < F.col("started"), "invalid-time-range")
        .when(F.coalesce(F.col("number"), F.lit(0)) == 0, "unknown-stage")
        .when(F.coalesce(over, F.lit(False)), "after-terminal-state")
    )
    rows = log.withColumn("number", number).withColumn("code", code)
    success = rows.where("code IS NULL AND seq IS NOT NULL AND outcome IN ('succeeded', 'skipped')")
    places = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "number")))
    nothing = F.expr("cast(array() as array<bigint>)")
    done = F.aggregate(places, nothing, lambda at, x: F.when(x["number"] == F.size(at) + 1, F.array_append(at, x["seq"])).otherwise(at))
    reached = success.groupBy(*[F.col(k).alias(f"r_{k}") for k in key]).agg(done.alias("reached"))
    joined = rows.join(reached, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key], "left")
    expected = F.size(F.filter(F.coalesce("reached", nothing), lambda at: at < F.col("seq"))) + 1
    late = F.when(F.col("number") != expected, "stage-out-of-order")
    return joined.withColumn("code", F.coalesce("code", late)).drop("number", "reached", *[f"r_{k}" for k in key])


def run_complete(candidates: DataFrame) -> DataFrame:
    """(run_id, complete): whether every candidate of a run is synchronised."""
    return candidates.groupBy("run_id").agg(F.bool_and(F.col("state") == "synchronized").alias("complete"))


def normalized(records: DataFrame, mode: str, *fields: str) -> DataFrame:
    return records.withColumns({f: whitespace_mode(F.col(f), mode) for f in fields})


def mapped(records: DataFrame, candidates: str) -> DataFrame:
    """Each record's array of candidates exploded, with their ordinals."""
    return records.select(*[c for c in records.columns if c != candidates], F.posexplode(candidates).alias("ordinal", "candidate"))


def source_dedup(candidates: DataFrame, *order: str) -> DataFrame:
    """Candidates with ``first_seen``: one for each (source, record key, version), the first in order."""
    place = F.row_number().over(Window.partitionBy("source_id", "record_key", "version").orderBy(*order))
    return candidates.withColumn("first_seen", place == 1)


def semantic_dedup(candidates: DataFrame, identities: str, *order: str) -> DataFrame:
    """Candidates with the key of the first one that has the same set of canonical identities (``duplicate_of``, null for itself)."""
    keyed = candidates.withColumn("__set", F.sha2(F.concat_ws("\x1f", F.array_sort(F.array_distinct(identities))), 256))
    w = Window.partitionBy("__set").orderBy(*order)
    first = F.first(F.struct(*KEY)).over(w)
    return keyed.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, first)).drop("__set")


def structural_findings(candidates: DataFrame) -> DataFrame:
    """(key, code, severity) of candidates whose own fields are not valid."""
    codes = F.array_compact(F.array(
        F.when(~valid_label(F.col("source_id")), "invalid-source"),
        F.when(~valid_label(F.col("record_key")), "invalid-record-key"),
        F.when(~valid_label(F.col("version")), "invalid-version"),
        F.when(F.col("ordinal") < 0, "invalid-ordinal"),
    ))
    return candidates.select(*KEY, F.explode(codes).alias("code"), F.lit("error").alias("severity"))


def with_policy(findings: DataFrame, policy: DataFrame, default: str = "error") -> DataFrame:
    """Findings with the severity that a policy (code, severity) gives their code."""
    return findings.drop("severity").join(policy.select("code", "severity"), "code", "left").withColumn("severity", F.coalesce("severity", F.lit(default)))


def validation_status(findings: DataFrame, keys: list[str] | None = None, by: DataFrame | None = None) -> DataFrame:
    """(key, status): a fatal finding blocks, an error quarantines, none is valid, else valid with warnings."""
    keys = keys or KEY
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = findings.groupBy(*keys).agg(F.max(rank).alias("worst"), F.count_distinct("code").alias("findings"))
    if by is not None:
        worst = by.select(*keys).distinct().join(worst, keys, "left")
    status = F.when(F.col("worst") == 4, "blocked").when(F.col("worst") == 3, "quarantined").when(F.col("worst").isNull(), "valid").otherwise("valid-with-warnings")
    return worst.select(*keys, status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


def with_rules(candidates: DataFrame, rules: DataFrame, default: dict) -> DataFrame:
    """Candidates with their source class's approval rule, or the default."""
    names = ["allows_unverified", "allows_disputed", "allows_non_authentic", "curation_required"]
    joined = candidates.join(rules.select("source_class", *names), "source_class", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(default[n])) for n in names})


def approval_gate(rows: DataFrame) -> DataFrame:
    """Rows with ``approval_code``: null where a candidate may be published, else the first failing check.

    Needs validation_candidate, candidate, validation_status, decision_candidate, decision_class, source_class, outcome,
    authenticity, curation and the four rule columns.
    """
    authentic = (
        F.when(F.col("authenticity") == "authentic", True)
        .when(F.col("authenticity") == "unverified", F.col("allows_unverified"))
        .when(F.col("authenticity") == "disputed", F.col("allows_disputed"))
        .when(F.col("authenticity") == "non-authentic", F.col("allows_non_authentic"))
    )
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    code = (
        F.when(differs("validation_candidate", "candidate"), "candidate-mismatch")
        .when(F.col("validation_status") == "blocked", "validation-blocked")
        .when(F.col("validation_status") == "quarantined", "validation-quarantined")
        .when(~F.coalesce(F.col("validation_status").isin("valid", "valid-with-warnings"), F.lit(False)), "validation-not-publishable")
        .when(differs("decision_candidate", "candidate") | differs("decision_class", "source_class"), "approval-target-mismatch")
        .when(~F.col("outcome").eqNullSafe("approved"), "not-approved")
        .when(~F.coalesce(authentic, F.lit(False)), "authenticity-not-permitted")
        .when(F.col("curation_required") & ~F.col("curation").eqNullSafe("performed"), "curation-required")
    )
    return rows.withColumn("approval_code", code)


def publication_gate(rows: DataFrame) -> DataFrame:
    """Rows with ``publication_code``, the first failing check of publishing, and ``outcome`` where it passes.

    Needs, beside the approval columns: subgraph_code, revision, validation_revision, approval_revision,
    recorded_authenticity, readiness, index_source, index_key.
    """
    judged = approval_gate(rows)
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    code = (
        F.when(differs("validation_candidate", "candidate"), "candidate-mismatch")
        .when(F.col("subgraph_code").isNotNull(), F.concat(F.lit("invalid-subgraph/"), F.col("subgraph_code")))
        .when(differs("validation_revision", "revision") | differs("approval_revision", "revision"), "reviewed-subgraph-mismatch")
        .when(F.col("recorded_authenticity").isNull(), "missing-source-authenticity")
        .when(differs("recorded_authenticity", "authenticity"), "source-authenticity-mismatch")
        .when(F.col("approval_code").isNotNull(), F.concat(F.lit("approval/"), F.col("approval_code")))
        .when(~F.col("readiness").eqNullSafe("ready"), "index-not-ready")
        .when(differs("index_source", "source_id") | differs("index_key", "record_key"), "index-reference-mismatch")
    )
    return judged.withColumn("publication_code", code).withColumn("published", F.col("publication_code").isNull())


def withdraw(publications: DataFrame, targets: DataFrame, by: str, reason: str) -> DataFrame:
    """Withdrawal records of published candidates; the publications themselves stay as they are."""
    if not valid_text(reason):
        raise IngestionError("a withdrawal needs a reason")
    prior = publications.where("outcome = 'published'").join(targets, KEY, "left_semi")
    return prior.select(*KEY, F.lit("withdrawn").alias("outcome"), F.lit(by).alias("agent"), F.lit(reason).alias("reason"))


def corrections(publications: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(candidate, successor) with ``code``: the prior must be published and the successor another candidate."""
    published = publications.where("outcome = 'published'").select(F.col("candidate").alias("prior"), F.lit(True).alias("was_published"))
    joined = pairs.join(published, pairs["candidate"] == F.col("prior"), "left")
    code = F.when(F.col("was_published").isNull(), "prior-not-published").when(F.col("candidate") == F.col("successor"), "successor-must-differ")
    return joined.select("candidate", "successor", code.alias("code"))


def valid_text(value: str) -> bool:
    return bool(value.strip()) and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in value)


#: Kinds of a subgraph's records, by table.
SUBGRAPH_TABLES = ("entity", "mention", "concept", "source", "reference", "assertion", "evidence", "contradiction")


def revision(records: DataFrame) -> DataFrame:
    """(candidate, revision): a hash over everything a subgraph (candidate, kind, id, content) holds."""
    row = F.concat_ws("\x1f", "kind", "id", "content")
    return records.groupBy("candidate").agg(F.sha2(F.concat_ws("\x1e", F.array_sort(F.collect_list(row))), 256).alias("revision"))


def object_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("candidate").agg(F.count(F.lit(1)).alias("objects"))


def subgraph_findings(records: DataFrame, supports: DataFrame, crosswalk: DataFrame, existing: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(candidate, priority, code, subject) of every rule a subgraph breaks, in the order the checks are made.

    records(candidate, kind, id, valid, subject, object, assertion_ids); supports(candidate, assertion_id, evidence_id);
    crosswalk(candidate, source_id, value, entity_id, declared); existing(kind, id). ``candidates`` (candidate) are all
    candidates that are judged: one with nothing in any table has an empty subgraph.
    """
    local = records.select("candidate", "kind", "id").distinct()
    # What a candidate may refer to: its own records, and what is there already.
    known = existing.select(F.col("kind").alias("k"), F.col("id").alias("i"))
    own = local.select("candidate", F.col("kind").alias("k"), F.col("id").alias("i"))

    def unknown(refs: DataFrame, priority: int, prefix: str) -> DataFrame:
        """refs(candidate, k, i)"""
        missing = refs.join(own, ["candidate", "k", "i"], "left_anti").join(known, ["k", "i"], "left_anti")
        return missing.select("candidate", F.lit(priority).alias("priority"), F.concat(F.lit(prefix), F.col("k")).alias("code"), F.col("i").alias("subject"))

    finding = lambda df, priority, code: df.select("candidate", F.lit(priority).alias("priority"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), F.col("id").alias("subject"))
    repeated = records.groupBy("candidate", "kind", "id").count().where("count > 1")
    ends = records.where("kind = 'assertion'").select("candidate", F.explode(F.array("subject", "object")).alias("r")).select("candidate", F.col("r.kind").alias("k"), F.col("r.id").alias("i"))
    supported = supports.select("candidate", F.lit("assertion").alias("k"), F.col("assertion_id").alias("i"))
    evidenced = supports.select("candidate", F.lit("evidence").alias("k"), F.col("evidence_id").alias("i"))
    contradicted = records.where("kind = 'contradiction'").select("candidate", F.lit("assertion").alias("k"), F.explode("assertion_ids").alias("i"))
    targets = crosswalk.where("declared").select("candidate", F.lit("entity").alias("k"), F.col("entity_id").alias("i"))
    conflicting = crosswalk.groupBy("candidate", "source_id", "value").agg(F.count_distinct("entity_id").alias("n")).where("n > 1")
    authenticity = records.where("kind = 'authenticity'").select("candidate", F.lit("source").alias("k"), F.col("id").alias("i"))
    parts = [
        finding(repeated.where(F.col("kind").isin(*SUBGRAPH_TABLES)), 1, F.concat(F.lit("duplicate-"), F.col("kind"))),
        finding(records.where("NOT valid"), 2, F.concat(F.lit("invalid-"), F.col("kind"))),
        unknown(supported, 3, "unknown-support-"),
        unknown(evidenced, 4, "unknown-support-"),
        unknown(ends, 5, "unknown-assertion-"),
        unknown(authenticity, 6, "unknown-authenticity-"),
        conflicting.select("candidate", F.lit(7).alias("priority"), F.lit("conflicting-crosswalk").alias("code"), F.concat_ws(":", "source_id", "value").alias("subject")),
        unknown(targets, 7, "unknown-crosswalk-"),
        unknown(contradicted, 8, "unknown-contradiction-"),
    ]
    if candidates is not None:
        held = records.select("candidate").unionByName(supports.select("candidate")).unionByName(crosswalk.select("candidate")).distinct()
        nothing = candidates.select("candidate").distinct().join(held, "candidate", "left_anti")
        parts.append(nothing.select("candidate", F.lit(0).alias("priority"), F.lit("empty-subgraph").alias("code"), F.lit("").alias("subject")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def subgraph_codes(findings: DataFrame) -> DataFrame:
    """(candidate, subgraph_code): the first failing check of each candidate."""
    return findings.groupBy("candidate").agg(F.min_by("code", F.struct("priority", "code", "subject")).alias("subgraph_code"))


def readiness_gate(readiness: Column) -> Column:
    return readiness.eqNullSafe("ready")


def sync_status(outcome: Column, retries: Column, limit: int = 3) -> Column:
    """pending, synchronized, retryable or terminal."""
    return F.when(outcome.isNull(), "pending").when(outcome == "ok", "synchronized").when(retries < limit, "retryable").otherwise("terminal")


def reprocess(records: DataFrame, mode: str, keys: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Records to process again: targeted keys, those whose content differs from the previous version, or all."""
    if mode == "targeted":
        if keys is None:
            raise IngestionError("targeted reprocessing needs keys")
        return records.join(keys.select("source_id", "record_key").distinct(), ["source_id", "record_key"], "left_semi")
    if mode == "delta":
        if previous is None:
            raise IngestionError("delta reprocessing needs the previous records")
        return records.join(previous.select("source_id", "record_key", "content"), ["source_id", "record_key", "content"], "left_anti")
    if mode == "full":
        return records
    raise IngestionError(f"unknown mode {mode!r}")
