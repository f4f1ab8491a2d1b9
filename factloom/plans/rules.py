"""Rules: conjunctive premises, conditions, typed bindings, scope and conclusion; their validation and lifecycle."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


class RuleError(ValueError):
    """A rule, or a step of a rule's life, that isn't allowed."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Obj:
    kind: str
    id: str


@dataclass(frozen=True)
class Text:
    value: str


Term = Var | Obj | Text


@dataclass(frozen=True)
class Pattern:
    subject: Term
    predicate: Term
    object: Term

    @property
    def terms(self) -> tuple[Term, Term, Term]:
        return self.subject, self.predicate, self.object

    def variables(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Equal:
    left: Term
    right: Term


@dataclass(frozen=True)
class NotEqual:
    left: Term
    right: Term


@dataclass(frozen=True)
class PredicateIs:
    """True if any chosen premise has the predicate."""

    name: str


@dataclass(frozen=True)
class ObjectKind:
    variable: str
    kind: str


Condition = Equal | NotEqual | PredicateIs | ObjectKind


@dataclass(frozen=True)
class Scope:
    predicates: tuple[str, ...] = ()
    object_kinds: tuple[str, ...] = ()
    max_depth: int | None = None


#: Rule families and the number of premises a family must have.
FAMILIES = {"inverse": 1, "symmetric": 1, "transitive": 2, "type-inheritance": 2, "composition": 2, "property-inheritance": None, "conditional": None}


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    premises: tuple[Pattern, ...]
    conclusion: Pattern
    conditions: tuple[Condition, ...] = ()
    #: (variable, required object kind or None)
    bindings: tuple[tuple[str, str | None], ...] = ()
    scope: Scope = Scope()
    version: tuple[int, int, int] = (1, 0, 0)
    #: Whether premises may share no variable, so that every combination of their matches is meant.
    independent: bool = False

    def validate(self) -> None:
        if not self.id.strip():
            raise RuleError("rule id must not be empty")
        if not self.premises:
            raise RuleError("a rule needs a premise")
        if self.kind not in FAMILIES:
            raise RuleError(f"unknown rule family {self.kind!r}")
        bound = set().union(*(p.variables() for p in self.premises))
        declared = {name for name, _ in self.bindings}
        if declared - bound:
            raise RuleError("a declared binding occurs in no premise")
        if self.conclusion.variables() - bound:
            raise RuleError("the conclusion has an unbound variable")
        for condition in self.conditions:
            if condition_variables(condition) - bound:
                raise RuleError("a condition has an unbound variable")
        if self.scope.max_depth == 0:
            raise RuleError("scope depth must not be zero")
        expected = FAMILIES[self.kind]
        if expected is not None and len(self.premises) != expected:
            raise RuleError(f"{self.kind} rules have {expected} premises")
        if isinstance(self.conclusion.predicate, Obj):
            raise RuleError("a conclusion's predicate is text or a variable")

    def compatible_with(self, other: Rule) -> bool:
        """Same rule, same major version."""
        return self.id == other.id and self.version[0] == other.version[0]

    def structural_key(self) -> str:
        return f"{self.id}:{'.'.join(map(str, self.version))}:{self.kind}|{self.premises!r}=>{self.conclusion!r}"


def condition_variables(condition: Condition) -> set[str]:
    if isinstance(condition, ObjectKind):
        return {condition.variable}
    if isinstance(condition, PredicateIs):
        return set()
    return {t.name for t in (condition.left, condition.right) if isinstance(t, Var)}


def may_overlap(a: Pattern, b: Pattern) -> bool:
    return all(isinstance(x, Var) or isinstance(y, Var) or x == y for x, y in zip(a.terms, b.terms))


def may_reach(rule: Rule, goal: Pattern) -> bool:
    return may_overlap(rule.conclusion, goal) or any(may_overlap(p, goal) for p in rule.premises)


@dataclass(frozen=True)
class Budgets:
    max_depth: int
    max_applications: int
    max_derived: int
    max_expansion: int
    seconds: float
    result_limit: int

    def validate(self) -> None:
        """No budget is zero and none above the ceiling. The depth never binds: derived facts are no premises, so a second round adds nothing."""
        for f in fields(self):
            if getattr(self, f.name) > getattr(CEILING, f.name):
                raise RuleError(f"{f.name} is above the ceiling")
        if not all((self.max_depth, self.max_applications, self.max_derived, self.max_expansion, self.result_limit)):
            raise RuleError("a budget is zero")


#: The profiles' budgets and rule families, and the ceiling over all of them.
CEILING = Budgets(64, 100_000, 50_000, 100_000, 30, 10_000)
PROFILES = {
    "basic": (Budgets(4, 1_000, 500, 1_000, 1, 100), ("inverse", "symmetric")),
    "semantic": (Budgets(16, 10_000, 5_000, 10_000, 5, 1_000), tuple(FAMILIES)),
    "deep": (Budgets(32, 50_000, 25_000, 50_000, 15, 5_000), tuple(FAMILIES)),
}

# The life of a rule; only an activated one is used.
_STEPS = {
    "validated": {"approved"},
    "approved": {"versioned"},
    "versioned": {"activated", "approved"},
    "activated": {"deactivated"},
    "deactivated": {"activated"},
}


@dataclass
class Registry:
    """Rules by id with their state."""

    entries: dict[str, tuple[Rule, str]] = field(default_factory=dict)

    def register(self, rule: Rule) -> None:
        rule.validate()
        if rule.id in self.entries:
            raise RuleError(f"rule {rule.id!r} is registered already")
        self.entries[rule.id] = (rule, "validated")

    def move(self, rule_id: str, state: str) -> None:
        rule, now = self.entries[rule_id]
        if state not in _STEPS[now]:
            raise RuleError(f"a rule that is {now} can't become {state}")
        self.entries[rule_id] = (rule, state)

    def activate(self, rule: Rule) -> None:
        """Registers a rule and takes it through all states."""
        self.register(rule)
        for state in ("approved", "versioned", "activated"):
            self.move(rule.id, state)

    def new_version(self, rule: Rule) -> None:
        old, state = self.entries[rule.id]
        if state != "versioned" or rule.version <= old.version:
            raise RuleError("a new version needs a versioned rule and a higher number")
        rule.validate()
        self.entries[rule.id] = (replace(rule), "versioned")

    def eligible(self) -> list[Rule]:
        return sorted((rule for rule, state in self.entries.values() if state == "activated"), key=Rule.structural_key)
