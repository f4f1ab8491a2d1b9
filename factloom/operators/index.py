"""Indexes beside the store: forward and reverse id maps, and a lexical inverted index, as tables.

Forward: (target_kind, reference) -> index_id; reverse: index_id -> (target_kind, reference); postings: (term, ref).
Forward and reverse follow a commit strongly; the search index may lag, and says so in its state.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import reference_key, tokenize


class IndexError_(ValueError):
    """An index operation that isn't allowed."""


def index_id(target_kind: Column, reference: Column) -> Column:
    """The index's own id of a target: a hash of both, so the maps are each other's inverse."""
    return F.sha2(F.concat_ws("\x1f", target_kind, reference), 256)


def forward(targets: DataFrame) -> DataFrame:
    """(target_kind, reference, index_id) of targets (target_kind, reference)."""
    return targets.select("target_kind", "reference").distinct().withColumn("index_id", index_id(F.col("target_kind"), F.col("reference")))


def reverse(targets: DataFrame) -> DataFrame:
    return forward(targets).select("index_id", "target_kind", "reference")


def lookup(index: DataFrame, target_kind: str, reference: str) -> DataFrame:
    return index.where((F.col("target_kind") == target_kind) & (F.col("reference") == reference)).select("index_id")


def synchronised(index: DataFrame, upserts: DataFrame, removals: DataFrame) -> DataFrame:
    """A map after a batch: what is written again or removed goes, then the new entries come."""
    key = ["target_kind", "reference"]
    gone = upserts.select(*key).unionByName(removals.select(*key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(forward(upserts).select(*index.columns))


def postings(texts: DataFrame) -> DataFrame:
    """(term, ref) of texts (source, reference, text): a reference has a term once."""
    ref = reference_key(F.col("source"), F.col("reference"))
    return texts.select(ref.alias("ref"), F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).select("term", "ref")


def upsert(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Postings in which the texts' references have their new terms alone."""
    new = postings(texts)
    refs = texts.select(reference_key(F.col("source"), F.col("reference")).alias("ref")).distinct()
    return index.join(refs, "ref", "left_anti").unionByName(new.select(*index.columns))


def remove(index: DataFrame, refs: DataFrame) -> DataFrame:
    return index.join(refs.select("ref").distinct(), "ref", "left_anti")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text), repeated tokens included."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ref, score): how many of a query's tokens a reference has; a repeated token counts each time.

    Tokens of a query are counted before the join, so a common term's postings meet it once.
    """
    wanted = query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return index.join(wanted, "term").groupBy("query_id", "ref").agg(F.sum("times").alias("score"))


def hits(found: DataFrame, limit: int) -> DataFrame:
    """The first hits of each query, score first, then reference key."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ref"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def explained(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ref, summary, matched_terms): which of a query's terms a reference matched, sorted."""
    met = postings(texts).join(query_terms(queries).distinct(), "term")
    found = met.groupBy("query_id", "ref").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"))
    summary = F.concat(F.lit("matched "), F.size("matched_terms").cast("string"), F.lit(" terms"))
    return found.select("query_id", "ref", summary.alias("summary"), "matched_terms")


class SearchProvider(Protocol):
    """An external search index: hits (query_id, ref, score) for queries (query_id, text)."""

    def search(self, queries: DataFrame) -> DataFrame: ...


@dataclass
class PostingsProvider:
    """The provider over a postings table."""

    table: DataFrame

    def search(self, queries: DataFrame) -> DataFrame:
        return search(self.table, queries)


def search_sync(index: DataFrame, changes: DataFrame, texts: DataFrame) -> DataFrame:
    """Postings after a commit's changes (source, reference, removed); every upsert needs a text."""
    key = ["source", "reference"]
    upserts = changes.where("NOT removed")
    if not upserts.join(texts, key, "left_anti").isEmpty():
        raise IndexError_("an upsert has no search text")
    gone = changes.where("removed").select(reference_key(F.col("source"), F.col("reference")).alias("ref"))
    return upsert(remove(index, gone), texts.join(upserts.select(*key), key, "left_semi"))


def coverage(updates: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates without a change, changes without an update): both must be empty."""
    key = ["target_kind", "reference"]
    return updates.join(changes, key, "left_anti").select(*key), changes.join(updates, key, "left_anti").select(*key)


# The states an index may be in, and which of them answer queries.
STATES = ("current", "stale", "unavailable", "rebuilding")
QUERYABLE = ("current", "stale")


@dataclass
class IndexState:
    """The state of one index and the version it has caught up with."""

    name: str
    strong: bool
    state: str = "current"
    version: int = 0

    @property
    def queryable(self) -> bool:
        return self.state in QUERYABLE

    def synchronised(self, version: int) -> None:
        self.state, self.version = "current", version

    def failed(self) -> None:
        """A strong index that misses a commit must not answer; an eventual one stays usable, but stale."""
        self.state = "unavailable" if self.strong else "stale"

    def rebuild(self) -> None:
        self.state = "rebuilding"


def persist(table: DataFrame, state: IndexState, folder: str) -> None:
    """An index as a Parquet table of its version, clustered by its first column, and then the state that names it."""
    from factloom.sources.store import Files

    key = table.columns[0]
    table.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{folder}/{state.name}/{state.version:012d}")
    Files(table.sparkSession, folder).replace(f"{folder}/{state.name}.json", json.dumps(asdict(state)))


def load(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, IndexState]:
    """A persisted index with its state; a condition on the first column reaches the sorted files."""
    from factloom.sources.store import Files

    state = IndexState(**json.loads(Files(spark, folder).read(f"{folder}/{name}.json")))
    return spark.read.parquet(f"{folder}/{name}/{state.version:012d}"), state


@dataclass
class Synchroniser:
    """Applies a commit to the indexes: checks its coverage and base version, repeats idempotently, isolates failures.

    The updates must cover the commit's changes and nothing else (``coverage``); if they don't, every index fails.
    """

    states: dict[str, IndexState] = field(default_factory=lambda: {n: IndexState(n, n != "search") for n in ("forward", "reverse", "search")})

    def apply(self, base: int, version: int, steps: dict, updates: DataFrame | None = None, changes: DataFrame | None = None) -> dict[str, str]:
        """steps: name -> callable; updates and changes: (target_kind, reference) of the projections and of the commit.

        The report says synchronised, unchanged, conflict or failed for each index.
        """
        report = {}
        covered = updates is None or changes is None or all(side.isEmpty() for side in coverage(updates, changes))
        for name, step in steps.items():
            state = self.states[name]
            if state.version == version:
                report[name] = "unchanged"
                continue
            if not covered:
                state.failed()
                report[name] = "failed: the updates don't cover the commit's changes"
                continue
            if state.version != base:
                state.failed()
                report[name] = "conflict"
                continue
            try:
                step()
            except Exception as error:  # one index's failure leaves the others to go on
                state.failed()
                report[name] = f"failed: {error}"
            else:
                state.synchronised(version)
                report[name] = "synchronised"
        return report
