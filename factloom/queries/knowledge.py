"""Queries of the graph, reasoning, resolution and contradiction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import normalize, path_key
from factloom.operators import contradiction, graph, reasoning, resolution
from factloom.plans import rules as r
from factloom.queries.registry import register
from factloom.sources import fixture

_facts = fixture.duckdb_facts


# The graph.
@register("graph_nodes", f"{_facts('nations', 'customers', 'segments')} SELECT sk AS kind, si AS id FROM facts UNION SELECT ok, oi FROM facts")
def graph_nodes(spark, sf_dir):
    return graph.nodes(fixture.assertions(spark, sf_dir, "nations", "customers", "segments"))


@register("graph_edges", f"{_facts('orders', 'lines')} SELECT DISTINCT aid AS edge_id, si AS source, oi AS target, pred AS predicate FROM facts")
def graph_edges(spark, sf_dir):
    found = graph.edges(fixture.assertions(spark, sf_dir, "orders", "lines"))
    return found.select("edge_id", F.col("source.id").alias("source"), F.col("target.id").alias("target"), "predicate")


@register(
    "graph_counts",
    f"{_facts('supply', 'types')} SELECT count(DISTINCT aid) AS edges, (SELECT count(*) FROM (SELECT sk, si FROM facts UNION SELECT ok, oi FROM facts)) AS nodes FROM facts",
)
def graph_counts(spark, sf_dir):
    known = fixture.assertions(spark, sf_dir, "supply", "types")
    # Two one-row aggregates meet on a constant key.
    e = graph.edges(known).agg(F.count(F.lit(1)).alias("edges")).withColumn("one", F.lit(1))
    n = graph.nodes(known).agg(F.count(F.lit(1)).alias("nodes")).withColumn("one", F.lit(1))
    return e.join(n, "one").select("edges", "nodes")


@register(
    "graph_degree",
    f"""{_facts('supply', 'suppliers')}, s AS (SELECT sk AS kind, si AS id, 1 AS o, 0 AS i FROM facts UNION ALL SELECT ok, oi, 0, 1 FROM facts)
    SELECT kind, id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM s GROUP BY kind, id""",
)
def graph_degree(spark, sf_dir):
    return graph.degrees(graph.edges(fixture.assertions(spark, sf_dir, "supply", "suppliers")))


for _name, _call, _where in (
    ("outgoing", graph.outgoing, "si = 'part-9'"),
    ("incoming", graph.incoming, "oi = 'part-9'"),
    ("incident", graph.incident, "si = 'part-9' OR oi = 'part-9'"),
):
    register(f"graph_{_name}", f"{_facts('supply', 'lines')} SELECT aid AS edge_id, pred AS predicate FROM facts WHERE {_where}")(
        lambda spark, sf_dir, call=_call: call(graph.edges(fixture.assertions(spark, sf_dir, "supply", "lines")), "entity", "part-9").select("edge_id", "predicate")
    )


def _stepped(name: str, direction: str, sql: str, *groups: str) -> None:
    @register(name, f"{_facts(*groups)} {sql}")
    def run(spark, sf_dir):
        found = graph.steps(graph.edges(fixture.assertions(spark, sf_dir, *groups)), fixture.relationships(spark), direction)
        return found.select("edge_id", F.col("from.id").alias("from_id"), F.col("to.id").alias("to_id"), F.col("step.predicate").alias("predicate"), F.col("step.direction").alias("direction"))


_stepped("graph_step_forward", "forward", "SELECT aid AS edge_id, si AS from_id, oi AS to_id, pred AS predicate, 'forward' AS direction FROM facts", "nations", "customers", "events")
_stepped("graph_step_reversed", "forward", "SELECT aid AS edge_id, oi AS from_id, si AS to_id, pred AS predicate, 'forward' AS direction FROM facts", "supply")
_stepped(
    "graph_step_inverse_declared", "inverse",
    "SELECT aid AS edge_id, oi AS from_id, si AS to_id, CASE pred WHEN 'part-of' THEN 'has-part' ELSE 'location-of' END AS predicate, 'inverse' AS direction FROM facts WHERE pred <> 'performed'",
    "nations", "customers", "events",
)
_stepped("graph_step_symmetric", "inverse", "SELECT aid AS edge_id, oi AS from_id, si AS to_id, pred AS predicate, 'inverse' AS direction FROM facts", "names")


def _paths_sql(depth: int, start: str, end: str) -> str:
    """Every cycle-free forward path by a recursive query; ``keys`` gives the depth-first order, ``work`` the attempts."""
    return f"""{_facts('customers', 'nations', 'worlds')},
    walk AS (WITH RECURSIVE w AS (
      SELECT {start} AS node, [{start}] AS seen, CAST([] AS VARCHAR[]) AS keys, 0 AS length
      UNION ALL SELECT f.oi, list_append(w.seen, f.oi), list_append(w.keys, f.aid), w.length + 1 FROM w JOIN facts f ON f.si = w.node
      WHERE w.length < {depth} AND NOT list_contains(w.seen, f.oi)) SELECT * FROM w),
    tries AS (SELECT list_append(w.keys, f.aid) AS attempt FROM walk w JOIN facts f ON f.si = w.node OR f.oi = w.node WHERE w.length < {depth}),
    numbered AS (SELECT attempt, row_number() OVER (ORDER BY attempt) AS work FROM tries)
    {end}"""


def _walked(spark, sf_dir, start, bounds):
    found = graph.paths(graph.edges(fixture.assertions(spark, sf_dir, "customers", "nations", "worlds")), fixture.relationships(spark), ("entity", start), bounds)
    return found.select(F.col("end.id").alias("end_id"), "length", F.array_join("keys", ">").alias("keys"))


_END = "SELECT node AS end_id, length, array_to_string(keys, '>') AS keys FROM walk"
for _depth in (2, 3):
    register(f"graph_paths_depth{_depth}", _paths_sql(_depth, "'customer-11'", _END))(lambda spark, sf_dir, d=_depth: _walked(spark, sf_dir, "customer-11", graph.Bounds(d)))
register("graph_paths_edge_budget", _paths_sql(3, "'customer-11'", _END + " WHERE length = 0 OR keys IN (SELECT attempt FROM numbered WHERE work <= 2)"))(
    lambda spark, sf_dir: _walked(spark, sf_dir, "customer-11", graph.Bounds(3, max_edges=2))
)
register("graph_paths_result_budget", _paths_sql(3, "'customer-11'", _END + " ORDER BY walk.keys LIMIT 3"))(lambda spark, sf_dir: _walked(spark, sf_dir, "customer-11", graph.Bounds(3, max_results=3)))


register(
    "graph_paths_node_budget",
    _paths_sql(3, "'customer-11'", f"""SELECT node AS end_id, length, array_to_string(keys, '>') AS keys FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (ORDER BY keys) AS reached
      FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY keys) = 1 AS fresh FROM walk) a) b WHERE reached <= 3"""),
)(lambda spark, sf_dir: _walked(spark, sf_dir, "customer-11", graph.Bounds(3, max_edges=1000, max_nodes=3)))
register(
    "graph_paths_expansion_budget",
    _paths_sql(3, "'customer-11'", _END + " WHERE length = 0 OR list_slice(keys, 1, length - 1) IN (SELECT keys FROM (SELECT keys, row_number() OVER (ORDER BY keys) AS n FROM walk WHERE length < 3) e WHERE n <= 2)"),
)(lambda spark, sf_dir: _walked(spark, sf_dir, "customer-11", graph.Bounds(3, max_expansion=2)))


@register(
    "graph_accessors",
    f"""{_facts('customers', 'nations')} SELECT DISTINCT 'node' AS what, 'nation-3' AS id FROM facts WHERE si = 'nation-3' OR oi = 'nation-3'
    UNION ALL SELECT 'edge', min(aid) FROM facts""",
)
def graph_accessors(spark, sf_dir):
    """A node by its reference and an edge by its assertion; what is not there gives no row."""
    known = fixture.assertions(spark, sf_dir, "customers", "nations")
    built = graph.edges(known)
    least = known.agg(F.min("assertion_id")).first()[0]
    found = graph.node(built, "entity", "nation-3").unionByName(graph.node(built, "concept", "nation-3")).select(F.lit("node").alias("what"), "id")
    return found.unionByName(graph.edge(built, least).unionByName(graph.edge(built, "nothing")).select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


@register(
    "graph_path_connected",
    f"""{_facts('customers', 'nations')} SELECT a.si AS start_id, true AS whole, false AS reversed FROM facts a JOIN facts b ON a.oi = b.si WHERE a.grp = 'customers' AND b.grp = 'nations'""",
)
def graph_path_connected(spark, sf_dir):
    """Two-step paths are connected; the same steps the other way round are not."""
    known = fixture.assertions(spark, sf_dir, "customers", "nations")
    starts = known.where("predicate = 'located-in'").select(F.col("subject").alias("start"))
    found = graph.paths(graph.edges(known), fixture.relationships(spark), starts, graph.Bounds(2)).where("length = 2")
    return found.select(F.col("start.id").alias("start_id"), graph.connected(F.col("path")).alias("whole"), graph.connected(F.reverse("path")).alias("reversed"))


@register(
    "graph_paths_all_starts",
    f"""{_facts('customers', 'nations')}
    SELECT a.si AS start_id, b.oi AS end_id, a.aid || ':forward:located-in|' || b.aid || ':forward:part-of' AS path_key FROM facts a JOIN facts b ON a.oi = b.si WHERE a.grp = 'customers' AND b.grp = 'nations'""",
)
def graph_paths_all_starts(spark, sf_dir):
    """Two-step paths from every customer at once: the frontier of all starts is one join a level."""
    known = fixture.assertions(spark, sf_dir, "customers", "nations")
    starts = known.where("predicate = 'located-in'").select(F.col("subject").alias("start"))
    found = graph.paths(graph.edges(known), fixture.relationships(spark), starts, graph.Bounds(2))
    return found.where("length = 2").select(F.col("start.id").alias("start_id"), F.col("end.id").alias("end_id"), path_key(F.col("path")).alias("path_key"))


# Rule families.
_X, _Y, _Z = r.Var("x"), r.Var("y"), r.Var("z")


def _p(s, p, o):
    return r.Pattern(s, r.Text(p), o)


INVERSE = r.Rule("inverse-location", "inverse", (_p(_X, "located-in", _Y),), _p(_Y, "location-of", _X))
SYMMETRIC = r.Rule("same-name", "symmetric", (_p(_X, "same-name-as", _Y),), _p(_Y, "same-name-as", _X))
TRANSITIVE = r.Rule("part-of-part", "transitive", (_p(_X, "part-of", _Y), _p(_Y, "part-of", _Z)), _p(_X, "part-of", _Z))
TYPES = r.Rule("type-inheritance", "type-inheritance", (_p(_X, "instance-of", _Y), _p(_Y, "subclass-of", _Z)), _p(_X, "instance-of", _Z))
TRAITS = r.Rule("trait-inheritance", "property-inheritance", (_p(_X, "instance-of", _Y), _p(_Y, "has-trait", _Z)), _p(_X, "has-trait", _Z))
COMPOSED = r.Rule("located-part-of", "composition", (_p(_X, "located-in", _Y), _p(_Y, "part-of", _Z)), _p(_X, "located-in", _Z))
SOURCED = r.Rule(
    "sourced-from", "conditional", (_p(_X, "supplied-by", _Y), _p(_Y, "located-in", _Z)), _p(_X, "sourced-from", _Z),
    (r.NotEqual(_Z, r.Obj("entity", "nation-0")), r.PredicateIs("supplied-by"), r.ObjectKind("y", "entity")),
)

_USABLE = "polarity = 'positive' AND status IN ('accepted', 'known')"


def _ruled(name: str, rule: r.Rule, sql: str, *groups: str) -> None:
    head = _facts(*groups) + f", u AS (SELECT * FROM facts WHERE {_USABLE})"

    @register(name, f"{head} {sql}")
    def run(spark, sf_dir):
        found = reasoning.deduplicated(reasoning.apply_rule(rule, fixture.assertions(spark, sf_dir, *groups)))
        return found.select(F.col("subject.id").alias("subject_id"), "predicate", F.col("object.id").alias("object_id"), "status", F.array_join("premise_ids", ",").alias("premises"))


_TWO = "SELECT a.si AS subject_id, '{p}' AS predicate, b.oi AS object_id, 'provisional' AS status, a.aid || ',' || b.aid AS premises FROM u a JOIN u b ON a.oi = b.si AND a.ok = b.sk WHERE a.pred = '{a}' AND b.pred = '{b}'"
_ruled("rule_inverse", INVERSE, "SELECT oi AS subject_id, 'location-of' AS predicate, si AS object_id, 'provisional' AS status, aid AS premises FROM u", "customers", "suppliers")
_ruled("rule_symmetric", SYMMETRIC, "SELECT oi AS subject_id, pred AS predicate, si AS object_id, 'provisional' AS status, aid AS premises FROM u", "names")
_ruled("rule_transitive", TRANSITIVE, _TWO.format(p="part-of", a="part-of", b="part-of"), "nations", "worlds")
_ruled("rule_type_inheritance", TYPES, _TWO.format(p="instance-of", a="instance-of", b="subclass-of"), "types", "taxonomy")
_ruled("rule_property_inheritance", TRAITS, _TWO.format(p="has-trait", a="instance-of", b="has-trait"), "types", "traits")
_ruled("rule_composition", COMPOSED, _TWO.format(p="located-in", a="located-in", b="part-of"), "customers", "nations")
_ruled("rule_conditional", SOURCED, _TWO.format(p="sourced-from", a="supplied-by", b="located-in") + " AND b.oi <> 'nation-0'", "supply", "suppliers")
# The scope leaves out orders by their predicate and segments by the kind of their object.
_ruled(
    "rule_scope",
    r.Rule("scoped", "conditional", (r.Pattern(_X, _Y, _Z),), r.Pattern(_X, _Y, _Z), scope=r.Scope(("located-in", "instance-of"), ("entity",))),
    "SELECT si AS subject_id, pred AS predicate, oi AS object_id, 'provisional' AS status, aid AS premises FROM u WHERE pred IN ('located-in', 'instance-of') AND sk = 'entity' AND ok = 'entity'",
    "customers", "segments", "orders",
)
_ruled(
    "rule_typed_binding",
    r.Rule("typed", "conditional", (r.Pattern(_X, _Y, _Z),), _p(_X, "touches", _Z), bindings=(("z", "concept"),)),
    "SELECT si AS subject_id, 'touches' AS predicate, oi AS object_id, 'provisional' AS status, aid AS premises FROM u WHERE ok = 'concept'",
    "customers", "segments",
)


@register(
    "rule_context_merge",
    f"""{_facts('names')} SELECT a.si AS subject_id, c.oi AS object_id, CASE WHEN a.cv = c.cv THEN 'name=' || a.cv ELSE 'name=' || a.cv || ';premise.1.name=' || c.cv END AS context
    FROM facts a JOIN facts c ON a.oi = c.si""",
)
def rule_context_merge(spark, sf_dir):
    rule = r.Rule("name-chain", "transitive", (_p(_X, "same-name-as", _Y), _p(_Y, "same-name-as", _Z)), _p(_X, "same-name-as", _Z))
    found = reasoning.apply_rule(rule, fixture.assertions(spark, sf_dir, "names"))
    context = F.array_join(F.transform("context", lambda e: F.concat_ws("=", e["k"], e["v"])), ";")
    return found.select(F.col("subject.id").alias("subject_id"), F.col("object.id").alias("object_id"), context.alias("context"))


@register(
    "rule_traces",
    f"""{_facts('supply', 'suppliers')}, u AS (SELECT * FROM facts WHERE {_USABLE})
    SELECT a.si AS subject_id, b.oi AS object_id, count(*) AS traces FROM u a JOIN u b ON a.oi = b.si WHERE a.pred = 'supplied-by' AND b.pred = 'located-in' AND b.oi <> 'nation-0' GROUP BY a.si, b.oi""",
)
def rule_traces(spark, sf_dir):
    """Conclusions with the number of their distinct derivations."""
    found = reasoning.derived_set(reasoning.derive([SOURCED], fixture.assertions(spark, sf_dir, "supply", "suppliers")))
    return found.select(F.col("subject.id").alias("subject_id"), F.col("object.id").alias("object_id"), F.size("traces").cast("long").alias("traces"))


@register("reason_conflicts", f"{_facts('supply')} SELECT max(CASE polarity WHEN 'positive' THEN aid END) AS positive, max(CASE polarity WHEN 'negative' THEN aid END) AS negative FROM facts GROUP BY si, oi HAVING count(*) = 2")
def reason_conflicts(spark, sf_dir):
    return reasoning.conflicts(fixture.assertions(spark, sf_dir, "supply"))


def _reason(name: str, profile: str, sql: str, goal: r.Pattern | None = None):
    @register(name, f"{_facts('customers', 'nations', 'worlds')}, u AS (SELECT * FROM facts WHERE {_USABLE}) {sql}")
    def run(spark, sf_dir):
        registry = r.Registry()
        for rule in (INVERSE, COMPOSED, TRANSITIVE):
            registry.activate(rule)
        done = reasoning.reason(fixture.assertions(spark, sf_dir, "customers", "nations", "worlds"), registry, profile, goal)
        return done.derived.select("assertion_id").agg(F.count(F.lit(1)).alias("derived")).withColumns({"status": F.lit(done.status), "applications": F.lit(done.applications).cast("long"), "expanded": F.lit(done.expanded).cast("long")})


# The expansion budget of the basic profile takes the first thousand assertions; its result limit a hundred conclusions.
_reason(
    "reason_basic", "basic",
    """, w AS (SELECT * FROM facts ORDER BY aid LIMIT 1000), m AS (SELECT * FROM w WHERE pred = 'located-in')
    SELECT least((SELECT count(*) FROM m), 100) AS derived, 'incomplete' AS status, least((SELECT count(*) FROM m), 100) AS applications, least((SELECT count(*) FROM facts), 1000) AS expanded""",
)
_reason(
    "reason_goal", "deep",
    """, g AS (SELECT * FROM u WHERE pred = 'part-of') SELECT (SELECT count(*) FROM g a JOIN g b ON a.oi = b.si) AS derived, 'complete' AS status,
    (SELECT count(*) FROM g a JOIN g b ON a.oi = b.si) AS applications, (SELECT count(*) FROM facts WHERE pred = 'part-of') AS expanded""",
    r.Pattern(_X, r.Text("part-of"), _Y),
)


# Entity resolution over parts: an input is one of the part names in another spelling.
def _profiles(spark, sf_dir):
    part = fixture.table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("part-"), "p_partkey").alias("entity_id"),
        F.array("p_name").alias("names"),
        F.array(F.initcap("p_name")).alias("aliases"),
        F.array(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))).alias("identifiers"),
        F.array(F.struct(F.lit("catalogue").alias("source_id"), F.col("p_partkey").cast("string").alias("value"))).alias("source_identifiers"),
        F.array(F.reverse("p_name")).alias("transliterations"),
        F.split("p_name", " ").alias("lexical_keys"),
        F.array("p_type").alias("language_keys"),
        F.array("p_brand").alias("semantic_keys"),
        F.array(F.concat(F.lit("size-"), "p_size")).alias("context_keys"),
        F.array(F.concat(F.lit("price-"), F.floor(F.col("p_retailprice") / 100).cast("string"))).alias("neighborhood_keys"),
    )


_PROFILES = "prof AS (SELECT 'part-' || p_partkey AS entity_id, p_name, p_brand, p_type, p_size, p_partkey, p_retailprice, lower(p_name) AS norm FROM part)"
_ALIAS = "upper(substr(split_part({n}, ' ', 1), 1, 1)) || substr(split_part({n}, ' ', 1), 2) || ' ' || upper(substr(split_part({n}, ' ', 2), 1, 1)) || substr(split_part({n}, ' ', 2), 2)"


def _signal(signal: str, key, given, value: str, on: str) -> None:
    """Candidates that one signal gives: an input for every distinct value of the key over all parts, against all profiles."""
    sql = f"WITH {_PROFILES}, inp AS (SELECT DISTINCT CAST({value} AS VARCHAR) AS k FROM prof) SELECT i.k AS input_id, p.entity_id, '{signal}' AS signal FROM inp i JOIN prof p ON {on}"

    @register(f"resolve_signal_{signal.replace('-', '_')}", sql)
    def run(spark, sf_dir):
        values = fixture.table(spark, sf_dir, "part").select(key().cast("string").alias("k")).distinct()
        inputs = values.select(F.col("k").alias("input_id"), *[v.alias(name) for name, v in ({"text": F.lit("")} | given(F.col("k"))).items()])
        found = resolution.candidates(inputs, _profiles(spark, sf_dir))
        return found.select("input_id", "entity_id", F.explode("signals").alias("signal")).where(F.col("signal") == signal)


_signal("exact-identifier", lambda: F.concat(F.lit("part-"), "p_partkey"), lambda k: {"identifier": k}, "entity_id", "i.k = p.entity_id")
_signal("exact-alias", lambda: F.initcap("p_name"), lambda k: {"text": k}, _ALIAS.format(n="p_name"), f"i.k = {_ALIAS.format(n='p.p_name')}")
_signal("source-identifier", lambda: F.col("p_partkey"), lambda k: {"source_id": F.lit("catalogue"), "value": k}, "p_partkey", "i.k = CAST(p.p_partkey AS VARCHAR)")
_signal("normalized-name-or-alias", lambda: F.col("p_name"), lambda k: {"text": F.concat(F.lit("  "), F.upper(k), F.lit("!!"))}, "p_name", "i.k = p.p_name")
_signal("transliteration", lambda: F.col("p_name"), lambda k: {"transliteration": F.upper(F.reverse(k))}, "p_name", "i.k = p.p_name")
_signal("lexical", lambda: F.element_at(F.split("p_name", " "), 1), lambda k: {"lexical_keys": F.array(k)}, "split_part(p_name, ' ', 1)", "i.k IN (split_part(p.p_name, ' ', 1), split_part(p.p_name, ' ', 2))")
_signal("language", lambda: F.col("p_type"), lambda k: {"language_keys": F.array(k)}, "p_type", "i.k = p.p_type")
_signal("semantic-relationship", lambda: F.col("p_brand"), lambda k: {"semantic_keys": F.array(k)}, "p_brand", "i.k = p.p_brand")
_signal("context", lambda: F.col("p_size"), lambda k: {"context_keys": F.array(F.concat(F.lit("size-"), k))}, "p_size", "i.k = CAST(p.p_size AS VARCHAR)")
_signal("graph-neighborhood", lambda: F.floor(F.col("p_retailprice") / 100), lambda k: {"neighborhood_keys": F.array(F.concat(F.lit("price-"), k))}, "CAST(floor(p_retailprice / 100) AS BIGINT)", "i.k = CAST(CAST(floor(p.p_retailprice / 100) AS BIGINT) AS VARCHAR)")


def _inputs(spark, sf_dir):
    """Every spelling of a name with a brand, every identifier, every brand alone, and every name as nothing known."""
    part = fixture.table(spark, sf_dir, "part")
    spelled = part.select("p_name", "p_brand").distinct().select(F.concat_ws("/", F.lit("in"), "p_name", "p_brand").alias("input_id"), F.upper("p_name").alias("text"), F.array("p_brand").alias("semantic_keys"))
    known = part.select(F.concat(F.lit("id/"), "p_partkey").alias("input_id"), F.lit("?").alias("text"), F.concat(F.lit("part-"), "p_partkey").alias("identifier"))
    weak = part.select("p_brand").distinct().select(F.concat(F.lit("weak/"), "p_brand").alias("input_id"), F.lit("nothing like it").alias("text"), F.array("p_brand").alias("semantic_keys"))
    none = part.select("p_name").distinct().select(F.concat(F.lit("none/"), "p_name").alias("input_id"), F.lit("nothing like it").alias("text"))
    return spelled.unionByName(known, True).unionByName(weak, True).unionByName(none, True)


_PAIRS = f"""WITH {_PROFILES}, combo AS (SELECT DISTINCT p_name, p_brand, norm FROM prof),
    hit AS (SELECT 'in/' || i.p_name || '/' || i.p_brand AS input_id, p.entity_id, 7 AS a, 0 AS b FROM combo i JOIN prof p ON i.norm = p.norm
      UNION ALL SELECT 'in/' || i.p_name || '/' || i.p_brand, p.entity_id, 0, 3 FROM combo i JOIN prof p ON i.p_brand = p.p_brand
      UNION ALL SELECT 'id/' || p_partkey, entity_id, 10, 0 FROM prof UNION ALL SELECT 'weak/' || i.p_brand, p.entity_id, 0, 3 FROM (SELECT DISTINCT p_brand FROM prof) i JOIN prof p ON i.p_brand = p.p_brand),
    pair AS (SELECT input_id, entity_id, max(a) AS a, max(b) AS b FROM hit GROUP BY input_id, entity_id),
    ids AS (SELECT 'in/' || p_name || '/' || p_brand AS input_id FROM combo UNION ALL SELECT 'id/' || p_partkey FROM prof UNION ALL SELECT DISTINCT 'weak/' || p_brand FROM prof UNION ALL SELECT DISTINCT 'none/' || p_name FROM prof),
    ranked AS (SELECT *, greatest(a, b) AS top, row_number() OVER w AS place, lead(greatest(a, b)) OVER w AS following FROM pair
      WINDOW w AS (PARTITION BY input_id ORDER BY greatest(a, b) DESC, CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END DESC, entity_id))"""


@register("resolve_rank", f"{_PAIRS} SELECT input_id, entity_id, CAST(top AS INTEGER) AS top, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 3")
def resolve_rank(spark, sf_dir):
    found = resolution.ranked(resolution.candidates(_inputs(spark, sf_dir), _profiles(spark, sf_dir)))
    return found.where("place <= 3").select("input_id", "entity_id", F.col("primary").alias("top"), "place")


@register(
    "resolve_decide",
    f"""{_PAIRS}, best AS (SELECT * FROM ranked WHERE place = 1),
    d AS (SELECT ids.input_id, entity_id, CASE WHEN entity_id IS NULL THEN 'unknown' WHEN top < 7 THEN 'unresolved' WHEN following IS NOT NULL AND top - following < 1 THEN 'ambiguous' ELSE 'resolved' END AS decision FROM ids LEFT JOIN best USING (input_id))
    SELECT input_id, decision, CASE WHEN decision = 'resolved' THEN entity_id END AS entity_id FROM d""",
)
def resolve_decide(spark, sf_dir):
    return resolution.resolve(_inputs(spark, sf_dir), _profiles(spark, sf_dir))


@register("resolve_crosswalk_conflicts", "SELECT 'brand' AS source_id, p_brand AS value, count(DISTINCT p_partkey) AS entities FROM part GROUP BY p_brand HAVING count(DISTINCT p_partkey) > 1")
def resolve_crosswalk_conflicts(spark, sf_dir):
    part = fixture.table(spark, sf_dir, "part")
    return resolution.crosswalk_conflicts(part.select(F.lit("brand").alias("source_id"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("entity_id")))


# Contradictions.
@register(
    "contradiction_polarity",
    f"""{_facts('supply')} SELECT least(a.aid, b.aid) AS left_id, greatest(a.aid, b.aid) AS right_id FROM facts a JOIN facts b ON a.si = b.si AND a.oi = b.oi WHERE a.polarity = 'positive' AND b.polarity = 'negative'""",
)
def contradiction_polarity(spark, sf_dir):
    return contradiction.detect(fixture.assertions(spark, sf_dir, "supply"), []).select("left_id", "right_id")


@register(
    "contradiction_functional",
    f"""{_facts('supply')}, p AS (SELECT si, oi, aid FROM facts WHERE polarity = 'positive')
    SELECT si AS subject_id, count(*) AS pairs FROM (SELECT a.si FROM p a JOIN p b ON a.si = b.si AND a.aid < b.aid AND a.oi <> b.oi) x GROUP BY si""",
)
def contradiction_functional(spark, sf_dir):
    """Conflicts of each subject as classes and counts; their pairs are not listed."""
    found = contradiction.functional_conflicts(fixture.assertions(spark, sf_dir, "supply"), ["supplied-by"])
    return found.groupBy(F.col("subject.id").alias("subject_id")).agg(F.sum("pairs").alias("pairs"))


@register(
    "contradiction_disjoint_times",
    f"""{_facts('events')}, e AS (SELECT aid, si, oi, tag, s_us, e_us FROM facts)
    SELECT least(a.aid, b.aid) AS left_id, greatest(a.aid, b.aid) AS right_id FROM e a JOIN e b ON a.si = b.si AND a.aid < b.aid AND a.oi <> b.oi
    WHERE a.tag = 'unknown' OR b.tag = 'unknown' OR NOT (coalesce(a.e_us <= b.s_us, false) OR coalesce(b.e_us <= a.s_us, false))""",
)
def contradiction_disjoint_times(spark, sf_dir):
    """Events of a user as values of a functional predicate: those whose times certainly don't meet are no contradiction."""
    known = fixture.assertions(spark, sf_dir, "events")
    plain = known.withColumn("context", F.expr("cast(array() as array<struct<k:string,v:string>>)"))
    return contradiction.detect(plain, ["performed"]).select("left_id", "right_id")


@register(
    "contradictions_by_assertion",
    f"""{_facts('supply')}, c AS (SELECT a.aid AS x, b.aid AS y FROM facts a JOIN facts b ON a.si = b.si AND a.oi = b.oi WHERE a.polarity = 'positive' AND b.polarity = 'negative')
    SELECT aid AS assertion_id, count(*) AS contradictions, true AS active FROM (SELECT x AS aid FROM c UNION ALL SELECT y FROM c) z GROUP BY aid""",
)
def contradictions_by_assertion(spark, sf_dir):
    return contradiction.by_assertion(contradiction.records(contradiction.detect(fixture.assertions(spark, sf_dir, "supply"), [])))


@register(
    "current_view",
    f"""{_facts('supply')} SELECT aid AS assertion_id, polarity FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.si = f.si AND g.oi = f.oi AND g.polarity <> f.polarity)""",
)
def current_view(spark, sf_dir):
    known = fixture.assertions(spark, sf_dir, "supply")
    return contradiction.current_view(known, contradiction.records(contradiction.detect(known, []))).select("assertion_id", "polarity")


@register(
    "text_normalize",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) || ' ' || lower(p_brand) WHEN 1 THEN lower(p_name) || chr(233) || 'a' || chr(769) || ' ' || lower(p_brand)
    WHEN 2 THEN lower(p_name) || ' ' || chr(1087) || ' ' || chr(1633) || lower(p_brand) WHEN 4 THEN lower(p_name) || ' 5' || chr(178) || lower(p_brand) END AS normal
    FROM (SELECT p_partkey, p_name, regexp_replace(p_brand, '[^A-Za-z0-9]', ' ', 'g') AS p_brand FROM part) x""",
)
def text_normalize(spark, sf_dir):
    """Letters beyond ASCII, a combining mark, other digits, white-space controls, and a control that makes the text invalid."""
    part = fixture.table(spark, sf_dir, "part")
    odd = F.element_at(F.array(*[F.lit(x) for x in (" -- ", "\u00c9a\u0301...", "\t\u041f\u2014\u0661", "\x01", "\x855\u00b2")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select("p_partkey", normalize(F.concat("p_name", odd, "p_brand")).alias("normal"))
