"""The Spark provider of candidates: lookup, traversal and the five retrieval modes over an assertion table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import tokenize
from factloom.operators import graph
from factloom.plans.query import Lookup, QueryError, Retrieval, Traversal
from factloom.schema import CANDIDATE, PATH


def candidates(assertions: DataFrame, match_type: str, reference: Column | None = None, path: Column | None = None) -> DataFrame:
    """Assertions as candidates; the reference is the assertion itself unless given."""
    fields = {name: F.col(name) for name in CANDIDATE if name in assertions.columns}
    fields["reference"] = reference if reference is not None else F.struct(F.lit("assertion").alias("kind"), F.col("assertion_id").alias("id"))
    fields["match_type"] = F.lit(match_type)
    fields["path"] = path if path is not None else F.lit(None)
    return assertions.select(*[fields[name].cast(kind).alias(name) for name, kind in CANDIDATE.items()])


def touches(kind: str, id_: str) -> Column:
    return graph.is_ref("subject", kind, id_) | graph.is_ref("object", kind, id_)


@dataclass
class SparkAccess:
    """``texts`` is (reference struct, text); ``postings`` an index over them, (term, reference struct), which text searches use
    where there is one; ``taxonomy`` is (child, parent) of concept ids; ``reasoner`` maps a profile to assertions."""

    assertions: DataFrame
    relationships: DataFrame | None = None
    texts: DataFrame | None = None
    postings: DataFrame | None = None
    taxonomy: DataFrame | None = None
    reasoner: object = None

    def lookup(self, request: Lookup) -> DataFrame:
        if request.kind == "assertion":
            return candidates(self.assertions.where(F.col("assertion_id") == request.id), "lookup")
        return candidates(self.assertions.where(touches(request.kind, request.id)), "lookup")

    def retrieve(self, request: Retrieval) -> DataFrame:
        kind, value = request.target
        if request.mode == "exact":
            return candidates(self.assertions.where(touches(kind, value)), "exact")
        if request.mode == "conceptual":
            return candidates(self.assertions.where(touches("concept", value)), "conceptual")
        if request.mode == "relational":
            return candidates(self.assertions.where(F.col("predicate") == value), "relational")
        if request.mode == "lexical":
            return self.lexical(value)
        return self.semantic(request)

    def lexical(self, text: str, match_type: str = "lexical") -> DataFrame:
        """References whose text has any token of the query: the index's postings of those tokens, or a scan of the texts. The search
        index gives the scored form."""
        source = self.postings if self.postings is not None else self.texts
        if source is None:
            raise QueryError("no text is indexed")
        wanted = source.sparkSession.range(1).select(F.array_distinct(tokenize(F.lit(text))).alias("t")).first()[0]
        if not wanted:
            hits = source.limit(0)
        elif self.postings is not None:
            hits = source.where(F.col("term").isin(*wanted)).select("reference").distinct()
        else:
            hits = source.where(F.arrays_overlap(tokenize(F.col("text")), F.array(*[F.lit(t) for t in wanted])))
        empty = {name: F.lit(None).cast(kind).alias(name) for name, kind in CANDIDATE.items()}
        empty |= {"reference": F.col("reference"), "match_type": F.lit(match_type).alias("match_type"), "publication": F.lit("published").alias("publication"), "inference": F.lit("observed").alias("inference")}
        return hits.select(*[empty[name].cast(kind).alias(name) for name, kind in CANDIDATE.items()])

    def semantic(self, request: Retrieval) -> DataFrame:
        """Exact, lexical and, where expansion is controlled, one level of the taxonomy below a concept."""
        kind, value = request.target
        if kind == "text":
            return self.lexical(value, "semantic")
        if kind == "predicate":
            return candidates(self.assertions.where(F.col("predicate") == value), "semantic")
        found = self.assertions.where(touches(kind, value))
        if kind == "concept" and request.expansion == "controlled" and self.taxonomy is not None:
            below = self.taxonomy.where(F.col("parent") == value).select(F.col("child").alias("concept")).distinct()
            is_below = (F.col("object.kind") == "concept") & (F.col("object.id") == F.col("concept"))
            found = found.unionByName(self.assertions.where(~touches(kind, value)).join(below, is_below, "left_semi"))
        return candidates(found, "semantic")

    def traverse(self, request: Traversal) -> DataFrame:
        """Every path from the start; its last assertion carries the candidate's attributes, the reference is the path's end."""
        if self.relationships is None:
            raise QueryError("no relationships are declared")
        rows = self.assertions if request.predicate is None else self.assertions.where(F.col("predicate") == request.predicate)
        budget = request.budget
        # The result limit is not the walk's: it takes the best paths after ranking (plans.query).
        bounds = graph.Bounds(budget.max_depth, budget.max_edges, None, budget.max_nodes, budget.max_expansion)
        found = graph.paths(graph.edges(rows), self.relationships, (request.kind, request.id), bounds, request.direction)
        last = found.withColumn("last", F.expr("get(keys, size(keys) - 1)"))
        joined = last.join(self.assertions.withColumnRenamed("assertion_id", "last"), "last", "left").withColumn("assertion_id", F.col("last"))
        return candidates(joined, "traversal", F.col("end"), F.col("path").cast(PATH))

    def reason(self, profile: str) -> DataFrame:
        if self.reasoner is None:
            raise QueryError("reasoning is not available")
        return candidates(self.reasoner(profile), "semantic").withColumn("inference", F.lit("inferred"))
