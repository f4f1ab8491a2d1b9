"""The assertion graph: nodes, edges, single steps and bounded cycle-safe paths.

An edge is an assertion; its id is the assertion id, and that is the order edges are examined in. Paths are
enumerated level by level. Depth-first pre-order is the order of the paths' edge arrays, and the order in which edges
are examined is that of the attempts (a path's edges and the edge examined), so budgets are ordered cuts over those arrays
and nothing runs on the driver. An attempt's number only grows as deeper ones are added, so what is beyond an edge budget
after a level stays beyond it: no level keeps more than the budget's rows for a start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.lineage import cut
from factloom.schema import REF, STEP

#: Rows of the relationship table that may be broadcast.
BROADCAST_RELATIONSHIPS = 10_000
#: Levels of a path search that stay one lazy plan.
PLAIN_LEVELS = 3


class GraphError(ValueError):
    """A graph operation that can't be done."""


def nodes(assertions: DataFrame) -> DataFrame:
    """(kind, id) of every reference an assertion touches, once."""
    ends = assertions.select(F.explode(F.array("subject", "object")).alias("r"))
    return ends.select("r.kind", "r.id").distinct()


def edges(assertions: DataFrame) -> DataFrame:
    """(edge_id, source, target, predicate, polarity), one for each assertion id; parallel edges stay."""
    return assertions.select(F.col("assertion_id").alias("edge_id"), F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "polarity").dropDuplicates(["edge_id"])


def check_unique_edges(graph: DataFrame) -> None:
    """Raises if an assertion is registered as an edge twice."""
    if not graph.groupBy("edge_id").count().where("count > 1").isEmpty():
        raise GraphError("an assertion has more than one edge")


def register_nodes(known: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with others added; a node that is there already stays one node."""
    return known.unionByName(new.select("kind", "id")).distinct()


def register_edges(graph: DataFrame, known_nodes: DataFrame, new: DataFrame, with_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) after adding edges; ends must be nodes already unless ``with_nodes`` adds them."""
    ends = new.select(F.explode(F.array("source", "target")).alias("r")).select("r.kind", "r.id").distinct()
    if with_nodes:
        known_nodes = register_nodes(known_nodes, ends)
    elif not ends.join(known_nodes, ["kind", "id"], "left_anti").isEmpty():
        raise GraphError("an edge's end is not a node")
    out = graph.unionByName(new)
    check_unique_edges(out)
    return out, known_nodes


def is_ref(column: str, kind: str, id_: str) -> Column:
    return (F.col(f"{column}.kind") == kind) & (F.col(f"{column}.id") == id_)


def outgoing(graph: DataFrame, kind: str, id_: str) -> DataFrame:
    return graph.where(is_ref("source", kind, id_)).orderBy("edge_id")


def incoming(graph: DataFrame, kind: str, id_: str) -> DataFrame:
    return graph.where(is_ref("target", kind, id_)).orderBy("edge_id")


def incident(graph: DataFrame, kind: str, id_: str) -> DataFrame:
    return graph.where(is_ref("source", kind, id_) | is_ref("target", kind, id_)).orderBy("edge_id")


def node(graph: DataFrame, kind: str, id_: str) -> DataFrame:
    """The node of a reference: one row (kind, id), or none."""
    return nodes_of(graph.where(is_ref("source", kind, id_) | is_ref("target", kind, id_))).where((F.col("kind") == kind) & (F.col("id") == id_))


def edge(graph: DataFrame, assertion_id: str) -> DataFrame:
    """The edge of an assertion: one row, or none."""
    return graph.where(F.col("edge_id") == assertion_id)


def degrees(graph: DataFrame) -> DataFrame:
    """(kind, id, outgoing, incoming): both counts in one aggregation, a self-loop counting on both sides."""
    sides = graph.select(F.explode(F.array(F.struct(F.col("source").alias("r"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("r"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return sides.groupBy(F.col("x.r.kind").alias("kind"), F.col("x.r.id").alias("id")).agg(F.sum("x.o").alias("outgoing"), F.sum("x.i").alias("incoming"))


def _with_relationships(graph: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges with (inverse, symmetric, reversed) of their relationship; an edge without one isn't walked."""
    dimension = relationships.select("predicate", "inverse", "symmetric", "reversed")
    if dimension.limit(BROADCAST_RELATIONSHIPS + 1).count() <= BROADCAST_RELATIONSHIPS:
        dimension = F.broadcast(dimension)
    return graph.join(dimension, "predicate")


def steps(graph: DataFrame, relationships: DataFrame, direction: str = "forward") -> DataFrame:
    """Every step an edge allows, as (edge_id, from, to, step).

    Forward leaves the canonical source alone (subject, or object where the relationship is reversed). Inverse leaves
    its target and needs a declared inverse, whose name the step takes, or symmetry; a declared inverse goes first.
    """
    known = _with_relationships(graph, relationships)
    source = F.when(F.col("reversed"), F.col("target")).otherwise(F.col("source"))
    target = F.when(F.col("reversed"), F.col("source")).otherwise(F.col("target"))

    def taken(way: str, from_: Column, to: Column, predicate: Column) -> Column:
        return F.struct(F.col("edge_id").alias("assertion_id"), F.lit(way).alias("direction"), predicate.alias("predicate"), from_.alias("from"), to.alias("to")).cast(STEP)

    forward = taken("forward", source, target, F.col("predicate"))
    backward = taken("inverse", target, source, F.coalesce("inverse", "predicate"))
    can_return = F.col("inverse").isNotNull() | F.col("symmetric")
    if direction == "forward":
        found = known.select("edge_id", forward.alias("step"))
    elif direction == "inverse":
        found = known.where(can_return).select("edge_id", backward.alias("step"))
    else:
        raise GraphError(f"unknown direction {direction!r}")
    return found.select("edge_id", F.col("step.from").alias("from"), F.col("step.to").alias("to"), "step")


@dataclass(frozen=True)
class Bounds:
    """Limits of a path search; all but the depth hold for each start and cut the depth-first order.

    Edges: every edge examined at a path's end counts. Results: paths. Nodes: distinct nodes reached. Expansions: paths whose
    edges are examined.
    """

    max_depth: int
    max_edges: int | None = None
    max_results: int | None = None
    max_nodes: int | None = None
    max_expansion: int | None = None


def paths(graph: DataFrame, relationships: DataFrame, start: tuple[str, str] | DataFrame, bounds: Bounds, direction: str = "forward") -> DataFrame:
    """(start, path, end, length, keys) in pre-order of ``keys``, the path's edge ids; the zero-length path comes first.

    ``start`` is one reference or a DataFrame with column ``start``; budgets hold for each start. A path never returns
    to a node it has touched. Each level is one join of the frontier with the steps that leave its ends.
    """
    spark = graph.sparkSession
    if isinstance(start, tuple):
        if node(graph, *start).isEmpty():
            raise GraphError("the start is not a node")
        starts = spark.createDataFrame([(start,)], f"start {REF}")
    else:
        starts = start.select("start").distinct()
    empty = F.expr(f"cast(array() as array<{STEP}>)")
    root = starts.select("start", empty.alias("path"), F.col("start").alias("end"), F.expr("cast(array() as array<string>)").alias("keys"), F.array("start").alias("seen"))
    walkable = steps(graph, relationships, direction)
    out = _all_paths(root, walkable, bounds.max_depth) if bounds.max_edges is None else _paths_in_budget(root, walkable, graph, bounds.max_depth, bounds.max_edges)
    in_order = Window.partitionBy("start").orderBy("keys")
    if bounds.max_expansion is not None:
        parents = out.where(F.size("keys") < bounds.max_depth).select(F.col("start").alias("s"), F.col("keys").alias("k"), F.row_number().over(in_order).alias("n"))
        expanded = parents.where(F.col("n") <= bounds.max_expansion).select("s", "k")
        parent = F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0)))
        # The root is its own prefix and always an expanded or a sole path.
        out = out.join(expanded, (F.col("start") == F.col("s")) & (parent == F.col("k")), "left").where((F.size("keys") == 0) | F.col("k").isNotNull()).drop("s", "k")
    if bounds.max_nodes is not None:
        fresh = (F.row_number().over(Window.partitionBy("start", "end").orderBy("keys")) == 1).cast("int")
        out = out.withColumn("fresh", fresh).withColumn("reached", F.sum("fresh").over(in_order)).where(F.col("reached") <= bounds.max_nodes).drop("fresh", "reached")
    if bounds.max_results is not None:
        out = out.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= bounds.max_results).drop("place")
    return out.select("start", "path", "end", F.size("path").alias("length"), "keys")


def _all_paths(frontier: DataFrame, walkable: DataFrame, max_depth: int) -> DataFrame:
    """Every cycle-free path up to a depth; a few levels stay one lazy plan."""
    out = frontier
    for level in range(max_depth):
        grown = frontier.join(walkable, frontier["end"] == walkable["from"]).where(~F.array_contains("seen", F.col("to")))
        frontier = grown.select("start", F.concat("path", F.array("step")).alias("path"), F.col("to").alias("end"), F.concat("keys", F.array("edge_id")).alias("keys"), F.concat("seen", F.array("to")).alias("seen"))
        if PLAIN_LEVELS <= level + 1 < max_depth:
            # Beyond a few levels the plan would repeat all joins before; the frontier is cut off and may have run dry.
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        out = out.unionByName(frontier)
    return out


def _paths_in_budget(root: DataFrame, walkable: DataFrame, graph: DataFrame, max_depth: int, max_edges: int) -> DataFrame:
    """The paths that a depth-first walk finds before it has examined more than ``max_edges`` edges for a start.

    ``known`` holds the attempts of all levels so far with their number in depth-first order, the root being number 0, and at
    most ``max_edges`` of them for a start. Before a level grows, the degrees of the frontier's ends are summed in that order:
    a path takes only as many of its end's edges as the budget leaves to it, so no hub is unfolded beyond the budget.
    """
    incidence = graph.select("edge_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    ranked = incidence.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("edge_id"))).where(F.col("rank") <= max_edges)
    ranked = cut(ranked.select("edge_id", "node", "rank"))
    degree = ranked.groupBy(F.col("node").alias("n")).agg(F.max("rank").cast("long").alias("degree"))
    in_order = Window.partitionBy("start").orderBy("keys")
    known = root.withColumns({"walked": F.lit(True), "number": F.lit(0)})
    for level in range(max_depth):
        frontier = known.where(F.col("walked") & (F.size("keys") == level))
        before = F.coalesce(F.sum("degree").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("number")
        growing = frontier.join(degree, F.col("end") == F.col("n")).withColumn("left", max_edges - before).where("left > 0").drop("n", "degree", "number", "walked")
        tried = growing.join(ranked, (F.col("end") == F.col("node")) & (F.col("rank") <= F.col("left"))).drop("rank", "left")
        step = walkable.select(F.col("edge_id").alias("e"), F.col("from").alias("f"), "to", "step")
        met = tried.join(step, (F.col("edge_id") == F.col("e")) & (F.col("end") == F.col("f")), "left")
        walked = F.col("to").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("to")), F.lit(False))
        grown = met.select(
            "start",
            F.when(walked, F.concat("path", F.array("step"))).alias("path"),
            F.when(walked, F.col("to")).alias("end"),
            F.concat("keys", F.array("edge_id")).alias("keys"),
            F.when(walked, F.concat("seen", F.array("to"))).alias("seen"),
            walked.alias("walked"),
        )
        numbered = known.drop("number").unionByName(grown).withColumn("number", F.row_number().over(in_order) - 1)
        known = cut(numbered.where(F.col("number") <= max_edges))
        if known.where(F.col("walked") & (F.size("keys") == level + 1)).isEmpty():
            break
    return known.where("walked").drop("walked", "number")


def nodes_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("source", "target")).alias("r")).select("r.kind", "r.id").distinct()


def connected(path: Column) -> Column:
    """Whether each step of a path begins where the one before ended."""
    shifted = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), shifted, lambda a, b: a["to"] == b["from"])
    return F.forall(pairs, lambda x: x)
