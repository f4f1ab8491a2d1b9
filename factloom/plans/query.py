"""Requests, their plans and their execution.

A request (lookup, traversal or retrieval) is validated and planned into one access operator plus options; execution
composes one lazy DataFrame: access, reasoning output, visibility and filter, score, order, page. Only ``page`` runs
actions, and only where an error must be raised (an offset beyond the end, an unknown cursor).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import scoring
from factloom.functions.text import cursor_token, path_key, stable_key
from factloom.plans import filters

ORDERINGS = ("relevance", "path-length", "reference")
MODES = ("exact", "lexical", "conceptual", "relational", "semantic")
REASONING = ("none", "basic", "semantic", "deep")


class QueryError(ValueError):
    """A request that is not valid, or can't be executed."""


@dataclass(frozen=True)
class Budget:
    """Limits of a traversal; only the depth may be zero. Nodes, edges and expansions cut the walk in depth-first order, results
    cut what is returned, in rank order."""

    max_depth: int = 3
    max_nodes: int = 10_000
    max_edges: int = 20_000
    max_results: int = 1_000
    max_expansion: int = 10_000

    def validate(self) -> None:
        if self.max_depth < 0 or min(self.max_nodes, self.max_edges, self.max_results, self.max_expansion) <= 0:
            raise QueryError("traversal budgets must be positive")


@dataclass(frozen=True)
class Options:
    filter: filters.Filter = field(default_factory=filters.All)
    visibility: filters.Visibility = filters.PUBLIC
    ranking: str = "general"
    ordering: str = "relevance"
    limit: int = 50
    offset: int = 0
    cursor: str | None = None
    reasoning: str = "none"
    #: A ranking provider of one's own: candidate columns by name -> score Column.
    score: Callable[[dict[str, Column]], Column] | None = None

    def validate(self) -> None:
        self.filter.validate()
        if self.limit <= 0:
            raise QueryError("limit must be positive")
        if self.offset < 0 or (self.cursor is not None and self.offset):
            raise QueryError("cursor and offset exclude each other")
        if self.cursor is not None and not self.cursor.strip():
            raise QueryError("cursor must not be empty")
        if not self.visibility.name.strip():
            raise QueryError("visibility profile needs a name")
        if self.ordering not in ORDERINGS or self.ranking not in scoring.PROFILES or self.reasoning not in REASONING:
            raise QueryError("unknown ordering, ranking or reasoning profile")


@dataclass(frozen=True)
class Lookup:
    """By object (kind, id) or by assertion id."""

    kind: str
    id: str
    options: Options = Options()


@dataclass(frozen=True)
class Traversal:
    kind: str
    id: str
    direction: str = "forward"
    budget: Budget = Budget()
    predicate: str | None = None
    options: Options = Options()


@dataclass(frozen=True)
class Retrieval:
    """mode, and a target: (kind, id), ("predicate", name) or ("text", text)."""

    mode: str
    target: tuple[str, str]
    expansion: str = "none"
    options: Options = Options()

    @staticmethod
    def semantic(target: tuple[str, str], options: Options = Options()) -> Retrieval:
        return Retrieval("semantic", target, "controlled", options)


Request = Lookup | Traversal | Retrieval


@dataclass(frozen=True)
class Operator:
    """A plan node: an access, a composite of children, or a node that options carry instead."""

    kind: str
    request: Request | None = None
    children: tuple[Operator, ...] = ()


@dataclass(frozen=True)
class Plan:
    kind: str
    operator: Operator
    options: Options
    index: str

    def validate(self) -> None:
        self.options.validate()
        if self.operator.kind == "composite" and not self.operator.children:
            raise QueryError("composite operator needs children")


def validate(request: Request) -> None:
    request.options.validate()
    if isinstance(request, Traversal):
        request.budget.validate()
        if request.direction not in ("forward", "inverse"):
            raise QueryError("unknown traversal direction")
    if isinstance(request, Retrieval):
        kind, value = request.target
        if request.mode not in MODES:
            raise QueryError(f"unknown retrieval mode {request.mode!r}")
        if request.mode == "lexical" and (kind != "text" or not value.strip()):
            raise QueryError("lexical retrieval needs text")
        if request.mode == "conceptual" and kind != "concept":
            raise QueryError("conceptual retrieval must target a concept")
        if request.mode == "relational" and kind != "predicate":
            raise QueryError("relational retrieval must target a predicate")
        if request.mode == "exact" and kind in ("text", "predicate"):
            raise QueryError("exact retrieval must target an object")


def plan(request: Request) -> Plan:
    """One operator per request kind; an index is optional, or preferred where text or meaning is searched."""
    validate(request)
    kind = type(request).__name__.lower()
    preferred = isinstance(request, Retrieval) and request.mode != "exact"
    return Plan(kind, Operator(kind, request), request.options, "preferred" if preferred else "optional")


class Access(Protocol):
    """Provider of candidates."""

    def lookup(self, request: Lookup) -> DataFrame: ...

    def traverse(self, request: Traversal) -> DataFrame: ...

    def retrieve(self, request: Retrieval) -> DataFrame: ...

    def reason(self, profile: str) -> DataFrame: ...


def collect(operator: Operator, access: Access) -> DataFrame:
    """The candidates of an operator; a composite concatenates its children and keeps duplicates."""
    if operator.kind == "composite":
        parts = [collect(child, access) for child in operator.children]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    call = {"lookup": access.lookup, "traversal": access.traverse, "retrieval": access.retrieve}.get(operator.kind)
    if call is None:
        raise QueryError(f"operator {operator.kind!r} is not executable")
    return call(operator.request)


def _columns(df: DataFrame) -> dict[str, Column]:
    return {name: F.col(name) for name in df.columns}


def scored(candidates: DataFrame, profile: str, score: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """Candidates with score, stable key, path key and path length; ``score`` replaces the profile's score."""
    c = _columns(candidates)
    return candidates.select(
        "*",
        (score(c).cast("bigint") if score else scoring.score(profile, c)).alias("score"),
        stable_key(F.col("reference")).alias("stable_key"),
        path_key(F.col("path")).alias("path_key"),
        F.greatest(F.lit(0), F.coalesce(F.size("path"), F.lit(0))).alias("path_length"),
    )


def order_of(ordering: str) -> list[Column]:
    """A total order but for rows that agree in everything an item shows."""
    by_score, by_key, by_path = F.desc("score"), F.asc("stable_key"), F.asc("path_key")
    return {
        "relevance": [by_score, by_key, by_path],
        "path-length": [F.asc("path_length"), by_score, by_key, by_path],
        "reference": [by_key, by_score, by_path],
    }[ordering] + [F.asc("match_type")]


def visible(candidates: DataFrame, options: Options) -> DataFrame:
    return candidates.where(options.visibility.column() & options.filter.column())


def top(candidates: DataFrame, options: Options) -> DataFrame:
    """The first offset + limit rows in order, with their position: each task keeps that many, so nothing is sorted whole."""
    rows = scored(visible(candidates, options), options.ranking, options.score)
    order = order_of(options.ordering)
    first = rows.orderBy(*order).limit(options.offset + options.limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def item(page: DataFrame, profile: str) -> DataFrame:
    """What a result shows of a candidate, with its signals and the token that continues after it."""
    c = _columns(page)
    token = cursor_token(F.col("score"), F.col("reference"), F.col("match_type"), F.col("path"), F.col("position"))
    shown = [s.alias(name) for name, s in scoring.signals(profile, c).items()]
    return page.select("position", "stable_key", "match_type", "score", *shown, "path_key", "path_length", "status", "publication", "inference", token.alias("cursor"))


@dataclass
class Result:
    items: DataFrame
    total_matches: int
    returned: int
    next_cursor: str | None
    explanation: dict


def _position(cursor: str) -> int:
    head, _, tail = cursor.rpartition(";position=")
    if not head or not tail.isdigit():
        raise QueryError("unknown cursor")
    return int(tail)


def execute(query: Plan, access: Access) -> DataFrame:
    """The page of a plan as one lazy DataFrame (offsets beyond the end give no rows)."""
    query.validate()
    options = query.options
    if options.cursor is not None:
        options = replace(options, offset=_position(options.cursor) + 1, cursor=None)
    candidates = candidates_of(query, access)
    rows = top(candidates, options).where(F.col("position") >= options.offset)
    if query.operator.kind == "traversal":
        rows = rows.where(F.col("position") < query.operator.request.budget.max_results)
    return item(rows, options.ranking)


def candidates_of(query: Plan, access: Access) -> DataFrame:
    candidates = collect(query.operator, access)
    if query.options.reasoning != "none":
        candidates = candidates.unionByName(access.reason(query.options.reasoning))
    return candidates


def page(request: Request, access: Access) -> Result:
    """A request's result with its totals; raises where the offset passes the end or the cursor isn't of this result."""
    query = plan(request)
    options = query.options
    # Matches are counted before a traversal's result limit; the access operator is asked without it.
    found = visible(candidates_of(query, access), options)
    total = found.count()
    available = min(total, request.budget.max_results) if isinstance(request, Traversal) else total
    if options.cursor is not None:
        at = _position(options.cursor)
        asked = replace(options, offset=0, limit=at + 1, cursor=None)
        row = item(top(found, asked), options.ranking).where(F.col("position") == at).select("cursor").first()
        if row is None or row[0] != options.cursor or at >= available:
            raise QueryError("unknown cursor")
        options = replace(options, offset=at + 1, cursor=None)
    elif options.offset > available:
        raise QueryError("offset beyond the result")
    limit = min(options.limit, available - options.offset)
    shown = top(found, replace(options, limit=max(1, limit)))
    rows = item(shown.where((F.col("position") >= options.offset) & (F.col("position") < options.offset + limit)), options.ranking)
    more = options.offset + limit < available
    last = rows.where(F.col("position") == options.offset + limit - 1).select("cursor").first() if more and limit > 0 else None
    explanation = {
        "summary": f"{query.kind} query",
        "expansion": getattr(request, "expansion", "none"),
        "reasoning": options.reasoning,
        "index": query.index,
        "profile": options.ranking,
        "truncated": available < total,
    }
    return Result(rows, total, limit, last[0] if last else None, explanation)
