"""Hand-made cases for what the tables can't show: boundaries, cycles, budgets, quirks and errors."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import temporal, text
from factloom.operators import contradiction, graph, ingestion, metadata, ontology, reasoning, resolution, versioning
from factloom.plans import filters as f
from factloom.plans import rules as r
from factloom.plans.query import Budget, Lookup, Operator, Options, Plan, QueryError, Retrieval, Traversal, execute, page, plan, top
from factloom.operators.access import SparkAccess, candidates
from factloom.schema import ASSERTION, ddl


def assertion(s, p, o, status="accepted", polarity="positive", context=(), qualifiers=(), id_=None, **more):
    ref = lambda x: {"kind": "entity", "id": x} if isinstance(x, str) else {"kind": x[0], "id": x[1]}
    row = dict.fromkeys(ASSERTION)
    row |= {"assertion_id": id_ or f"{s}-{p}-{o}-{polarity}", "subject": ref(s), "predicate": p, "object": ref(o), "status": status, "polarity": polarity}
    row |= {"context": [{"k": k, "v": v} for k, v in context], "qualifiers": [{"k": k, "v": v} for k, v in qualifiers], "evidence_ids": [], "authority": [], "source_ids": [], "semantic_types": []}
    return row | {"publication": "published", "inference": "observed"} | more


def table(spark, *rows):
    return spark.createDataFrame([tuple(x[c] for c in ASSERTION) for x in rows], ddl(ASSERTION))


RELATIONS = "predicate string, inverse string, symmetric boolean, reversed boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Text.
def test_normalize(spark):
    cases = {"  Hello,   WORLD!! ": "hello world", "a\tb\nc": "a b c", "…": "", "É1": "é1", "x́y": "x́y", "بً": "بً"}
    for given, wanted in cases.items():
        assert one(spark, text.normalize(F.lit(given))) == wanted
    assert one(spark, text.normalize(F.lit("a\x01b"))) is None


def test_tokens_and_modes(spark):
    assert one(spark, text.tokenize(F.lit("One, two--THREE 4"))) == ["one", "two", "three", "4"]
    assert one(spark, text.whitespace_mode(F.lit("  a \n b "), "collapse-whitespace")) == "a b"
    assert one(spark, text.whitespace_mode(F.lit("  a \n b "), "trim")) == "a \n b"
    with pytest.raises(ValueError):
        text.whitespace_mode(F.lit(""), "other")


def test_identity_is_length_prefixed_bytes(spark):
    row = table(spark, assertion("é", "p", "o", context=[("k", "v")]))
    got = row.select(text.canonical_identity(F.col("subject"), F.col("predicate"), F.col("object"), F.col("context"), F.col("qualifiers"), F.col("polarity"))).first()[0]
    assert got == "subject:9:entity:é|predicate:1:p|object:8:entity:o|context:18:key:1:k|value:1:v||qualifiers:0:|polarity:8:positive|"


def test_labels(spark):
    for given, wanted in {"ok": True, " ": False, "": False, "a\nb": False}.items():
        assert one(spark, text.valid_label(F.lit(given))) is wanted
    assert one(spark, text.valid_label(F.lit(None).cast("string"))) is False
    assert one(spark, text.predicate_local(text.predicate_full(F.lit("part-of")))) == "part-of"


# Time.
def at(s, n=0):
    return temporal.instant(F.lit(s), F.lit(n))


def test_instants(spark):
    assert one(spark, temporal.instant_text(at(1, 5))) == "unix:1.000000005"
    assert one(spark, temporal.instant_text(at(-1, 500_000_000))) == "unix:-0.500000000"
    assert one(spark, temporal.instant_text(temporal.instant_of_micros(F.lit(-1_500_000)))) == "unix:-1.500000000"


def test_contains_is_three_valued(spark):
    closed = temporal.during("inclusive", at(1), "exclusive", at(3))
    assert [one(spark, temporal.contains(closed, at(s))) for s in (0, 1, 2, 3)] == [False, True, True, False]
    vague = temporal.validity("interval", F.lit("unknown"), F.lit(None), F.lit("inclusive"), at(3))
    assert one(spark, temporal.contains(vague, at(2))) is None
    assert one(spark, temporal.contains(vague, at(4))) is False
    assert one(spark, temporal.contains(temporal.from_on(at(2)), at(9))) is True


def test_valid_at_and_overlap(spark):
    assert one(spark, temporal.valid_at(temporal.at(at(5)), at(5))) is True
    assert one(spark, temporal.valid_at(temporal.approximately(at(5)), at(5))) is False
    assert one(spark, temporal.valid_at(temporal.unknown(), at(5))) is False
    wanted = temporal.during("inclusive", at(5), "inclusive", at(7))
    assert one(spark, temporal.overlaps(temporal.approximately(at(6)), wanted)) is True
    assert one(spark, temporal.overlaps(temporal.during("inclusive", at(1), "exclusive", at(5)), wanted)) is False
    assert one(spark, temporal.overlaps(temporal.during("inclusive", at(1), "inclusive", at(5)), wanted)) is True
    assert one(spark, temporal.overlaps(temporal.validity("interval", F.lit("unknown"), F.lit(None), F.lit("inclusive"), at(6)), wanted)) is False


def test_disjointness_needs_proof(spark):
    a = temporal.during("inclusive", at(1), "exclusive", at(3))
    assert one(spark, temporal.definitely_disjoint(a, temporal.during("inclusive", at(3), "inclusive", at(4)))) is True
    assert one(spark, temporal.definitely_disjoint(a, temporal.at(at(9)))) is True
    assert one(spark, temporal.definitely_disjoint(a, temporal.approximately(at(9)))) is False
    assert one(spark, temporal.definitely_disjoint(a, temporal.unknown())) is False
    assert one(spark, temporal.definitely_disjoint(temporal.at(at(1)), temporal.at(at(2)))) is True


def test_intervals(spark):
    assert one(spark, temporal.valid_interval(temporal.during("inclusive", at(2), "exclusive", at(2)))) is False
    assert one(spark, temporal.valid_interval(temporal.at(at(2)))) is True
    assert one(spark, temporal.open_direction(temporal.until(at(2)))) == "before"
    assert one(spark, temporal.allen_relation(temporal.during("inclusive", at(1), "inclusive", at(2)), temporal.during("inclusive", at(2), "inclusive", at(3)))) == "meets"
    assert all(temporal.ALLEN_INVERSE[b] == a for a, b in temporal.ALLEN_INVERSE.items())


# Filters and requests.
def test_not_of_a_missing_attribute_is_true(spark):
    rows = candidates(table(spark, assertion("a", "p", "b", publication=None)), "lookup")
    assert rows.where(f.Not(f.Publication("published")).column()).count() == 1
    assert rows.where(f.Not(f.ValidAt(1)).column()).count() == 1
    assert rows.where(f.ValidityUnknown().column()).count() == 1


@pytest.mark.parametrize("bad", [f.And(()), f.Or(()), f.Not(f.And(())), f.Context(" ", "x"), f.Context("k", "\0"), f.SemanticType("")])
def test_filters_are_checked(bad):
    with pytest.raises(f.FilterError):
        bad.validate()


@pytest.mark.parametrize(
    "bad",
    [
        Lookup("entity", "a", Options(limit=0)), Lookup("entity", "a", Options(cursor="x", offset=1)), Lookup("entity", "a", Options(cursor=" ")), Retrieval("lexical", ("text", " ")),
        Retrieval("conceptual", ("entity", "x")), Retrieval("relational", ("entity", "x")), Retrieval("other", ("entity", "x")), Traversal("entity", "x", budget=Budget(max_edges=0)),
    ],
)
def test_requests_are_checked(bad):
    with pytest.raises(QueryError):
        plan(bad)


def test_index_advice():
    assert plan(Lookup("entity", "a")).index == "optional"
    assert plan(Retrieval("exact", ("entity", "a"))).index == "optional"
    assert plan(Retrieval("relational", ("predicate", "p"))).index == "preferred"
    assert Retrieval.semantic(("concept", "c")).expansion == "controlled"


def test_pages(spark):
    access = SparkAccess(table(spark, *[assertion("a", "p", f"o{i}") for i in range(5)]))
    first = page(Lookup("entity", "a", Options(limit=2)), access)
    assert (first.total_matches, first.returned) == (5, 2) and first.next_cursor
    second = page(Lookup("entity", "a", Options(limit=3, cursor=first.next_cursor)), access)
    assert second.next_cursor is None and second.items.count() == 3
    shown = [x.stable_key for x in first.items.orderBy("position").collect()] + [x.stable_key for x in second.items.orderBy("position").collect()]
    assert shown == sorted(shown) and len(set(shown)) == 5
    assert page(Lookup("entity", "a", Options(offset=5)), access).items.count() == 0
    for bad in (Options(offset=6), Options(cursor="score=1;position=0"), Options(cursor=first.next_cursor.replace("score=", "score=1"))):
        with pytest.raises(QueryError):
            page(Lookup("entity", "a", bad), access)


def test_filter_rank_nodes_are_not_executable(spark):
    with pytest.raises(QueryError):
        execute(Plan("lookup", Operator("filter"), Options(), "optional"), SparkAccess(table(spark)))
    with pytest.raises(QueryError):
        Plan("lookup", Operator("composite"), Options(), "optional").validate()


# Graph.
def walk(spark, rows, relations, start, bounds, direction="forward"):
    known = table(spark, *rows)
    found = graph.paths(graph.edges(known), spark.createDataFrame(relations, RELATIONS), ("entity", start), bounds, direction)
    return [(x["end"]["id"], x["keys"]) for x in found.orderBy("keys").collect()]


CHAIN = [assertion("a", "p", "b", id_="1"), assertion("b", "p", "c", id_="2"), assertion("c", "p", "a", id_="3"), assertion("b", "p", "b", id_="4"), assertion("a", "q", "c", id_="0")]
PLAIN = [("p", None, False, False), ("q", "iq", True, False)]


def test_paths_are_cycle_safe_preorder(spark):
    assert walk(spark, CHAIN, PLAIN, "a", graph.Bounds(5)) == [("a", []), ("c", ["0"]), ("b", ["1"]), ("c", ["1", "2"])]
    assert walk(spark, CHAIN, PLAIN, "a", graph.Bounds(0)) == [("a", [])]
    assert walk(spark, CHAIN, PLAIN, "a", graph.Bounds(5, max_results=0)) == []
    assert walk(spark, CHAIN, PLAIN, "a", graph.Bounds(5, max_results=2)) == [("a", []), ("c", ["0"])]


def brute(rows, start, depth, max_edges):
    """Depth-first walk that counts every examined edge."""
    edges = sorted((x["assertion_id"], x["subject"]["id"], x["object"]["id"]) for x in rows)
    out, work = [], [0]

    def visit(node, keys, seen):
        out.append((node, keys))
        if len(keys) >= depth or work[0] >= max_edges:
            return
        for key, s, o in edges:
            if node not in (s, o):
                continue
            if work[0] >= max_edges:
                break
            work[0] += 1
            if s == node and o not in seen:
                visit(o, [*keys, key], seen | {o})

    visit(start, [], {start})
    return out


@pytest.mark.parametrize("budget", [1, 2, 3, 4, 5, 6, 8, 20])
def test_edge_budget_counts_examined_edges(spark, budget):
    assert walk(spark, CHAIN, PLAIN, "a", graph.Bounds(4, max_edges=budget)) == brute(CHAIN, "a", 4, budget)


def test_budgets_of_a_hub(spark):
    """A hub of 10^5 edges at depth six: what a level keeps is bounded by the edge budget, and the walk is the depth-first one."""
    n = 100_000
    id_ = F.lpad(F.col("id").cast("string"), 7, "0")
    rows = spark.range(n).select(
        F.concat(F.lit("e"), id_).alias("edge_id"),
        F.struct(F.lit("entity").alias("kind"), F.when(F.col("id") % 2 == 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), (F.col("id") - 1).cast("string"))).alias("id")).alias("source"),
        F.struct(F.lit("entity").alias("kind"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("n"), ((F.col("id") * 7) % n - (F.col("id") * 7) % 2).cast("string"))).alias("id")).alias("target"),
        F.lit("p").alias("predicate"), F.lit("positive").alias("polarity"),
    )
    budget = 2_000
    found = graph.paths(rows, spark.createDataFrame(PLAIN, RELATIONS), ("entity", "hub"), graph.Bounds(6, max_edges=budget)).collect()
    edges = [(x.edge_id, x.source.id, x.target.id) for x in rows.collect()]
    incident = {}
    for key, s, o in edges:
        for v in {s, o}:
            incident.setdefault(v, []).append((key, s, o))
    out, work = [], [0]

    def visit(v, keys, seen):
        out.append(keys)
        if len(keys) >= 6 or work[0] >= budget:
            return
        for key, s, o in incident[v]:
            if work[0] >= budget:
                break
            work[0] += 1
            if s == v and o not in seen:
                visit(o, [*keys, key], seen | {o})

    visit("hub", [], {"hub"})
    assert sorted(x["keys"] for x in found) == sorted(out) and len(out) > 500 and max(map(len, out)) > 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_node_and_expansion_budgets(spark, n):
    """Both cut the depth-first order: after n distinct nodes, and after n paths whose edges were examined."""
    rows = [*CHAIN, assertion("c", "p", "d", id_="5"), assertion("a", "p", "e", id_="6"), assertion("e", "p", "f", id_="7")]
    every = brute(rows, "a", 3, 10_000)
    reached, wanted = set(), []
    for end, keys in every:
        reached.add(end)
        if len(reached) > n:
            break
        wanted.append((end, keys))
    assert walk(spark, rows, PLAIN, "a", graph.Bounds(3, max_edges=10_000, max_nodes=n)) == wanted
    expanded = [keys for _, keys in every if len(keys) < 3][:n]
    assert walk(spark, rows, PLAIN, "a", graph.Bounds(3, max_expansion=n)) == [(end, keys) for end, keys in every if not keys or keys[:-1] in expanded]


def test_graph_accessors(spark):
    known = graph.edges(table(spark, *CHAIN))
    assert [x.id for x in graph.node(known, "entity", "b").collect()] == ["b"] and graph.node(known, "concept", "b").isEmpty()
    assert [x.target.id for x in graph.edge(known, "2").collect()] == ["c"] and graph.edge(known, "99").isEmpty()


def test_traversal_results_and_explanation(spark):
    access = SparkAccess(table(spark, *CHAIN), spark.createDataFrame(PLAIN, RELATIONS))
    request = Traversal("entity", "a", budget=Budget(max_depth=5, max_results=2), options=Options(visibility=f.Visibility("all", None, True, True, True)))
    assert execute(plan(request), access).count() == 2
    got = page(request, access)
    assert (got.total_matches, got.returned) == (4, 2)
    assert got.explanation == {"summary": "traversal query", "expansion": "none", "reasoning": "none", "index": "optional", "profile": "general", "truncated": True}
    whole = page(Traversal("entity", "a", options=request.options), access).explanation
    assert whole["truncated"] is False


def test_inverse_needs_a_declaration(spark):
    assert walk(spark, CHAIN, PLAIN, "c", graph.Bounds(1), "inverse") == [("c", []), ("a", ["0"])]
    known = graph.steps(graph.edges(table(spark, *CHAIN)), spark.createDataFrame(PLAIN, RELATIONS), "inverse").collect()
    assert [(x["edge_id"], x["step"]["predicate"]) for x in known] == [("0", "iq")]  # the declared inverse goes before symmetry


def test_graph_errors(spark):
    with pytest.raises(graph.GraphError):
        walk(spark, CHAIN, PLAIN, "nowhere", graph.Bounds(1))
    known = graph.edges(table(spark, *CHAIN))
    with pytest.raises(graph.GraphError):
        graph.register_edges(known, graph.nodes_of(known), known.where("edge_id = '1'"))
    assert graph.edges(table(spark, CHAIN[0], CHAIN[0])).count() == 1


# Reasoning.
X, Y, Z = r.Var("x"), r.Var("y"), r.Var("z")
TRANSITIVE = r.Rule("t", "transitive", (r.Pattern(X, r.Text("p"), Y), r.Pattern(Y, r.Text("p"), Z)), r.Pattern(X, r.Text("p"), Z))


def registry(*rules):
    out = r.Registry()
    for rule in rules:
        out.activate(rule)
    return out


def test_reasoning_is_one_hop(spark):
    known = table(spark, *[assertion(a, "p", b) for a, b in ("ab", "bc", "cd")])
    done = reasoning.reason(known, registry(TRANSITIVE), "deep")
    assert sorted((x.subject.id, x.object.id) for x in done.derived.collect()) == [("a", "c"), ("b", "d")]
    assert done.status == "complete" and {x.status for x in done.derived.collect()} == {"provisional"}
    assert reasoning.closure(TRANSITIVE, known).count() == 6


def test_premises_are_positive_and_accepted(spark):
    rule = r.Rule("i", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("ip"), X))
    known = table(spark, assertion("a", "p", "b", "provisional"), assertion("a", "p", "c", polarity="negative"), assertion("a", "p", "d", "known"))
    assert [x.subject.id for x in reasoning.derive([rule], known).collect()] == ["d"]


def test_goal_filters_the_assertions_themselves(spark):
    """A goal on the conclusion's predicate takes the premises away."""
    rule = r.Rule("i", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("ip"), X))
    known = table(spark, assertion("a", "p", "b"))
    assert reasoning.reason(known, registry(rule), "basic", r.Pattern(X, r.Text("ip"), Y)).derived.count() == 0
    assert reasoning.reason(known, registry(rule), "basic", r.Pattern(X, r.Text("p"), Y)).derived.count() == 1


def test_result_limit_and_half_budget(spark):
    rule = r.Rule("i", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("ip"), X))
    done = reasoning.reason(table(spark, *[assertion(f"s{i:03}", "p", "o") for i in range(101)]), registry(rule), "basic")
    assert done.status == "incomplete" and done.derived.count() == 100
    many = [assertion(f"s{i:03}", "p", "o", context=[("n", "1")], id_=f"x{i:03}") for i in range(600)]
    same = r.Rule("c", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("seen"), Y))
    done = reasoning.reason(table(spark, *many), registry(same), "basic")
    assert (done.status, done.derived.count()) == ("incomplete", 1)


def test_own_budgets(spark):
    rule = r.Rule("i", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("ip"), X))
    known = table(spark, *[assertion(f"s{i}", "p", "o") for i in range(6)])
    messages = {}
    for budgets in (r.Budgets(4, 20, 3, 20, 1, 10), r.Budgets(4, 20, 10, 20, 1, 4), r.Budgets(4, 20, 10, 11, 1, 10), r.Budgets(4, 11, 10, 20, 1, 10), r.Budgets(4, 20, 10, 20, 1, 10)):
        done = reasoning.reason(known, registry(rule), "basic", budgets=budgets)
        messages[done.message] = (done.status, done.derived.count(), done.applications)
    assert messages == {
        "derived-assertion budget exceeded": ("incomplete", 3, 3),
        "result limit exceeded; derived output truncated": ("incomplete", 4, 4),
        "expansion budget exceeded": ("incomplete", 6, 6),
        "execution budget exhausted during premise matching": ("incomplete", 6, 6),
        None: ("complete", 6, 6),
    }
    for wrong in (r.Budgets(65, 20, 10, 20, 1, 10), r.Budgets(4, 20, 0, 20, 1, 10)):
        with pytest.raises(r.RuleError):
            reasoning.reason(known, registry(rule), "basic", budgets=wrong)


def test_context_and_qualifiers_merge(spark):
    known = table(spark, assertion("a", "p", "b", context=[("k", "1"), ("m", "x")], qualifiers=[("q", "1")]), assertion("b", "p", "c", context=[("k", "2"), ("m", "x")], qualifiers=[("q", "1"), ("r", "2")]))
    got = reasoning.derive([TRANSITIVE], known).first()
    assert [tuple(e) for e in got.context] == [("k", "1"), ("m", "x"), ("premise.1.k", "2")]
    assert [tuple(e) for e in got.qualifiers] == [("q", "1"), ("r", "2")]


def test_time_budget(spark):
    done = reasoning.reason(table(spark, assertion("a", "p", "b"), assertion("b", "p", "c")), registry(TRANSITIVE), "deep", seconds=0)
    assert (done.status, done.derived.count()) == ("incomplete", 0)


def test_ranking_provider(spark):
    rows = candidates(table(spark, assertion("a", "p", "b"), assertion("a", "p", "c", id_="zz")), "lookup")
    by_id = lambda c: F.when(c["reference"]["id"] == "zz", 5000).otherwise(1)
    found = top(rows, Options(score=by_id)).orderBy("position").collect()
    assert [x.score for x in found] == [5000, 1]


def test_conflicts(spark):
    known = table(spark, assertion("a", "p", "b"), assertion("a", "p", "b", polarity="negative"), assertion("a", "p", "c"))
    assert reasoning.conflicts(known).count() == 1


@pytest.mark.parametrize(
    "bad",
    [
        r.Rule(" ", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("p"), X)),
        r.Rule("r", "inverse", (), r.Pattern(Y, r.Text("p"), X)),
        r.Rule("r", "transitive", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("p"), X)),
        r.Rule("r", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Z, r.Text("p"), X)),
        r.Rule("r", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Obj("entity", "e"), X)),
        r.Rule("r", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("p"), X), scope=r.Scope(max_depth=0)),
        r.Rule("r", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("p"), X), (r.Equal(Z, X),)),
        r.Rule("r", "inverse", (r.Pattern(X, r.Text("p"), Y),), r.Pattern(Y, r.Text("p"), X), bindings=(("z", None),)),
    ],
)
def test_rules_are_checked(bad):
    with pytest.raises(r.RuleError):
        bad.validate()


def test_rule_lifecycle():
    reg = r.Registry()
    reg.register(TRANSITIVE)
    assert reg.eligible() == []
    with pytest.raises(r.RuleError):
        reg.move("t", "activated")
    for state in ("approved", "versioned", "activated"):
        reg.move("t", state)
    assert reg.eligible() == [TRANSITIVE]
    reg.move("t", "deactivated")
    assert reg.eligible() == []


# Resolution.
def test_decisions(spark):
    profiles = spark.createDataFrame(
        [("e1", ["Alpha One"], ["A1"], ["x"], ["k"]), ("e2", ["alpha  one"], [], ["y"], ["k"]), ("e3", ["Beta"], [], ["z"], ["m"])],
        "entity_id string, names array<string>, aliases array<string>, identifiers array<string>, context_keys array<string>",
    )
    inputs = spark.createDataFrame(
        [("tie", "ALPHA-ONE", None, []), ("id", "", "x", []), ("weak", "none", None, ["m"]), ("none", "none", None, []), ("blank", " ", None, []), ("alias", "A1", None, [])],
        "input_id string, text string, identifier string, context_keys array<string>",
    )
    got = {x.input_id: (x.decision, x.entity_id) for x in resolution.resolve(inputs, profiles).collect()}
    assert got == {"tie": ("ambiguous", None), "id": ("resolved", "e1"), "weak": ("unresolved", None), "none": ("unknown", None), "blank": ("unknown", None), "alias": ("resolved", "e1")}
    assert one(spark, resolution.circular(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) is True


# Contradictions.
def test_contradiction_records(spark):
    known = table(spark, assertion("a", "p", "b"), assertion("a", "p", "b", polarity="negative"), assertion("a", "p", "c"))
    found = contradiction.detect(known, ["p"])
    assert sorted(x.kind for x in found.collect()) == sorted(contradiction.KINDS)
    records = contradiction.records(found)
    with pytest.raises(contradiction.ContradictionError):
        contradiction.insert(records, records)
    assert contradiction.current_view(known, records).count() == 0
    done = records
    for x in records.collect():
        done = contradiction.update_status(done, x.contradiction_id, "dismissed")
    assert contradiction.current_view(known, done).count() == 3


# Ontology.
def test_taxonomy(spark):
    classes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "key string, label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    assert {x.key for x in ontology.descendants(edges, "c").collect()} == {"a", "b"}
    assert ontology.add_edge(classes, edges, "a", "b")[1] is False
    for bad in (("a", "a"), ("c", "a"), ("a", "zz")):
        with pytest.raises(ontology.OntologyError):
            ontology.add_edge(classes, edges, *bad)
    with pytest.raises(ontology.OntologyError):
        ontology.add(classes, classes.where("key = 'a'"))
    snapshots = ontology.Snapshots()
    snapshots.register("v1", edges.limit(0))
    snapshots.activate("v1")
    with pytest.raises(ontology.OntologyError):
        snapshots.register("v2", edges)


def test_seed(spark):
    from factloom.sources import seed

    good = '{"name": "n", "classes": [{"key": "a", "label": "A"}, {"key": "b", "label": "B"}], "taxonomy": [{"child": "a", "parent": "b"}]}'
    classes, edges = seed.parse(spark.createDataFrame([(good,)], "value string"))
    assert (classes.count(), edges.count()) == (2, 1)
    for bad in ("{", good.replace('"parent": "b"', '"parent": "z"'), good.replace('"key": "b"', '"key": "a"')):
        with pytest.raises(ontology.OntologyError):
            seed.parse(spark.createDataFrame([(bad,)], "value string"))


# Ingestion.
def test_json_decoding(spark):
    from factloom.sources import json_source

    payloads = ['{"id": 7, "x": "a"}', '[{"id": "k"}, {"id": null}, {"id": true}]', "[1]", "3", "{", "[]"]
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "n int, payload string").withColumn("captured_at", F.current_timestamp())
    raw = json_source.capture(raw, operation="o", source_id="s", source_class="structured", artifact="a", content_type="application/json", version="1")
    got = sorted((x.n, x.ordinal if x.ordinal is not None else -1, x.record_key, x.locator, x.error) for x in json_source.decode(raw, "id").collect())
    assert got == [
        (0, 0, "7", None, None), (1, 0, "k", "/0", None), (1, 1, "record-1", "/1", None), (1, 2, "record-2", "/2", None),
        (2, -1, None, None, "record-not-an-object"), (3, -1, None, None, "unsupported-root"), (4, -1, None, None, "malformed-json"),
    ]


def test_pipeline_plan(spark):
    run = ingestion.Pipeline()
    run.stage("normalization", lambda df: df.withColumn("x", F.col("x") + 1))
    run.hook("normalization", "b", lambda df: df.withColumn("x", F.col("x") * 10))
    run.hook("normalization", "a", lambda df: df.withColumn("x", F.col("x") - 3))
    assert run.plan()[2:5] == ["normalization", "a", "b"]
    assert run.run(spark.createDataFrame([(5,)], "x int")).first().x == 30
    with pytest.raises(ingestion.IngestionError):
        run.hook("publication", "a", lambda df: df)


def test_stage_log(spark):
    rows = [
        ("r", "c", 1, "raw-capture", 1, "succeeded", 0, 1, False, None),
        ("r", "c", 2, "normalization", 1, "succeeded", 1, 2, False, "stage-out-of-order"),
        # What was refused changes nothing: the second stage is still to come, and may be tried again until it is done.
        ("r", "c", 3, "raw-validation", 1, "failed", 2, 3, False, None),
        ("r", "c", 4, "raw-validation", 2, "skipped", 3, 4, False, None),
        ("r", "c", 5, "raw-validation", 3, "succeeded", 4, 5, False, "stage-out-of-order"),
        ("r", "c", 6, "normalization", 1, "succeeded", 5, 6, False, None),
        ("r", "c", 7, "other", 1, "succeeded", 6, 7, False, "unknown-stage"),
        ("r", "d", 1, "raw-capture", 0, "succeeded", 0, 1, False, "invalid-attempt"),
        ("r", None, 1, "raw-capture", 1, "succeeded", 0, 1, False, None),
        ("r", None, 2, "raw-validation", 1, "succeeded", 0, 1, False, None),
        ("r", "e", 1, "raw-capture", 1, "succeeded", 2, 1, True, "invalid-time-range"),
        ("r", "e", 2, "raw-validation", 1, "succeeded", 2, 3, False, "after-terminal-state"),
    ]
    log = spark.createDataFrame(rows, "run_id string, candidate string, seq int, stage string, attempt int, outcome string, started int, ended int, terminal boolean, expected string")
    found = ingestion.check_log(log).collect()
    assert len(found) == len(rows) and all(x.code == x.expected for x in found)
    steps = ("raw-capture", "own-hook", "raw-validation")
    assert [x.code for x in ingestion.check_log(log.where("candidate = 'c' AND seq < 3"), steps).orderBy("seq").collect()] == [None, "unknown-stage"]


def test_withdrawals_and_corrections(spark):
    done = spark.createDataFrame([("s", "k", "1", 0, "c1", "published"), ("s", "k", "2", 0, "c2", "blocked")], "source_id string, record_key string, version string, ordinal int, candidate string, outcome string")
    assert ingestion.withdraw(done, done, "agent", "wrong").count() == 1
    with pytest.raises(ingestion.IngestionError):
        ingestion.withdraw(done, done, "agent", " ")
    pairs = spark.createDataFrame([("c1", "c9"), ("c1", "c1"), ("c2", "c9")], "candidate string, successor string")
    assert sorted(str(x.code) for x in ingestion.corrections(done, pairs).collect()) == ["None", "prior-not-published", "successor-must-differ"]


def test_subgraph_codes(spark):
    kinds = "candidate string, kind string, id string, valid boolean, subject struct<kind:string,id:string>, object struct<kind:string,id:string>, assertion_ids array<string>"
    rows = [("c", "entity", "a", True, None, None, None), ("c", "assertion", "x", True, ("entity", "a"), ("concept", "zz"), None), ("d", "entity", "a", True, None, None, None), ("d", "entity", "a", True, None, None, None), ("e", "contradiction", "k", True, None, None, ["x", "y"])]
    nothing = spark.createDataFrame([], "candidate string, assertion_id string, evidence_id string")
    walk_ = spark.createDataFrame([("c", "s", "1", "a", True)], "candidate string, source_id string, value string, entity_id string, declared boolean")
    found = ingestion.subgraph_findings(spark.createDataFrame(rows, kinds), nothing, walk_, spark.createDataFrame([("assertion", "y")], "kind string, id string"))
    got = {x.candidate: x.subgraph_code for x in ingestion.subgraph_codes(found).collect()}
    assert got == {"c": "unknown-assertion-concept", "d": "duplicate-entity", "e": "unknown-contradiction-assertion"}


# Metadata, versions.
def test_confidence(spark):
    basis = F.array(F.lit("b"))
    cases = [("numeric", 0.5, True), ("numeric", 1.5, False), ("numeric", float("nan"), False), ("numeric", None, False), ("unknown", None, True), ("qualitative", None, False)]
    for form, score, wanted in cases:
        assert one(spark, metadata.confidence_valid(F.lit(form), F.lit(score).cast("double"), F.lit(None).cast("string"), basis)) is wanted


def test_migrations(spark):
    start = spark.createDataFrame([(1,)], "x int")
    step = lambda a, b, ok=True: versioning.Migration(a, b, lambda df: df.withColumn("x", F.col("x") + 1), lambda df: ok)
    active = []
    assert versioning.migrate(start, versioning.plan([step(2, 3), step(1, 2)], 1, 3), active.append).first().x == 3 and len(active) == 1
    with pytest.raises(versioning.MigrationError):
        versioning.plan([step(1, 2), step(3, 4)], 1, 4)
    with pytest.raises(versioning.MigrationError):
        versioning.migrate(start, [step(1, 2, False)], active.append)
    assert len(active) == 1


def test_far_instants_are_exact(spark):
    for us, wanted in ((253402300799999999, "unix:253402300799.999999000"), (-1, "unix:-0.000001000"), (-62135596800000001, "unix:-62135596800.000001000")):
        assert one(spark, temporal.instant_text(temporal.instant_of_micros(F.lit(us)))) == wanted


# States and runs.
def test_refused_steps_leave_the_state(spark):
    rows = [("a", 1, "received"), ("a", 2, "published"), ("a", 3, "normalized"), ("b", 1, "mapped"), ("b", 2, "received"), ("c", 5, "nonsense"), ("d", 2, "blocked"), ("d", 1, "received"), ("d", 3, "normalized")]
    events = spark.createDataFrame(rows, "candidate string, seq int, state string")
    got = {(x.candidate, x.seq): (x.before, x.allowed) for x in ingestion.transitions(events, ingestion.CANDIDATE_STEPS, ["candidate"], "seq").collect()}
    assert got == {
        ("a", 1): (None, True), ("a", 2): ("received", False), ("a", 3): ("received", True), ("b", 1): (None, False), ("b", 2): (None, True), ("c", 5): (None, False),
        ("d", 1): (None, True), ("d", 2): ("received", True), ("d", 3): ("blocked", False),
    }
    now = {x.candidate: x.state for x in ingestion.current_states(events, ingestion.CANDIDATE_STEPS, ["candidate"], "seq").collect()}
    assert now == {"a": "normalized", "b": "received", "d": "blocked"}


def test_long_logs_fold_event_by_event(spark):
    import random

    r, names = random.Random(3), list(ingestion.GOVERNANCE_STEPS)
    events = [(c, i, r.choice(names[:4])) for c in "xy" for i in range(700)]
    got = {(x.candidate, x.seq): (x.before, x.allowed) for x in ingestion.transitions(spark.createDataFrame(events, "candidate string, seq int, state string"), ingestion.GOVERNANCE_STEPS, ["candidate"], "seq").collect()}
    state = dict.fromkeys("xy")
    for c, i, to in events:
        good = to == names[0] if state[c] is None else to in ingestion.GOVERNANCE_STEPS[state[c]]
        assert got[c, i] == (state[c], good)
        state[c] = to if good else state[c]


def test_runs(spark):
    run = ingestion.Run("op", "s", "structured", "1")
    rows = spark.createDataFrame([("s", "k1", "1", 0, "structured"), ("s", "k2", "1", 0, "structured")], "source_id string, record_key string, version string, ordinal int, source_class string")
    with pytest.raises(ingestion.IngestionError):
        run.register(rows)
    run.begin()
    known = run.register(rows)
    assert {x.state for x in known.collect()} == {"received"} and known.count() == 2
    for bad in (rows, rows.withColumn("version", F.lit("2")), rows.withColumn("source_class", F.lit("other")), rows.withColumn("source_id", F.lit("t")), rows.withColumn("record_key", F.lit("new"))):
        with pytest.raises(ingestion.IngestionError):
            run.register(bad, known)
    assert run.register(rows.limit(1).withColumn("record_key", F.lit("k3")), known).count() == 3
    with pytest.raises(ingestion.IngestionError):
        run.finish("completed", known)
    with pytest.raises(ingestion.IngestionError):
        run.finish("running", known)
    run.finish("completed-with-issues", known)
    for late in (run.begin, lambda: run.fail("x"), lambda: run.register(rows), lambda: run.finish("failed", known)):
        with pytest.raises(ingestion.IngestionError):
            late()
    other = ingestion.Run("op", "s", "structured", None)
    other.begin()
    assert other.register(rows.withColumn("version", F.lit(None).cast("string"))).count() == 2
    with pytest.raises(ingestion.IngestionError):
        other.fail(" ")
    other.fail("no reader")
    assert (other.state, other.error) == ("failed", "no reader")
    done = ingestion.Run("op", "s", "structured", "1")
    done.begin()
    done.finish("completed", known.withColumn("state", F.lit("synchronized")))
    assert done.state == "completed"
    with pytest.raises(ingestion.IngestionError):
        ingestion.Run(" ", "s", "structured", "1")


# Plans that count or skip pairs agree with those that list them.
def test_functional_conflicts_are_counted(spark):
    import random

    r, rows = random.Random(5), []
    for i in range(120):
        start, kind, size = r.randrange(12), r.choice(["inclusive", "exclusive"]), r.randrange(4)
        v = {
            0: None,
            1: ("instant", "inclusive", start, "inclusive", start),
            2: ("interval", kind, start, r.choice(["inclusive", "exclusive"]), start + 1 + size),
            3: ("open-ended", kind, start, "open", None),
            4: ("open-ended", "open", None, kind, start),
            5: ("approximate", "inclusive", start, "inclusive", start),
            6: ("unknown", "unknown", None, "unknown", None),
            7: ("interval", "unknown", None, kind, start),
        }[r.randrange(8)]
        time = v and {"tag": v[0], "start_kind": v[1], "start": None if v[2] is None else {"s": v[2], "n": 0}, "end_kind": v[3], "end": None if v[4] is None else {"s": v[4], "n": 0}}
        rows.append(assertion(f"s{r.randrange(4)}", "p", f"o{r.randrange(6)}", id_=f"a{i:03}", validity=time, context=[("k", str(r.randrange(2)))], polarity=r.choice(["positive"] * 5 + ["negative"])))
    known = table(spark, *rows)
    listed = contradiction.detect(known, ["p"]).where("kind = 'functional-value-conflict'").join(known.select(F.col("assertion_id").alias("left_id"), "subject", "context"), "left_id")
    wanted = {(x.subject.id, x.context[0].v): x["count"] for x in listed.groupBy("subject", "context").count().collect()}
    got = {(x.subject.id, x.context[0].v): x.pairs for x in contradiction.functional_conflicts(known, ["p"]).collect()}
    assert got == wanted and len(got) > 4
    assert contradiction.functional_conflicts(known, []).count() == 0


@pytest.mark.parametrize("threshold,margin", [(7, 1), (5, 3), (9, 4), (3, 1), (7, 0)])
def test_decisions_without_weak_pairs(spark, threshold, margin):
    import random

    r = random.Random(threshold)
    some = lambda letters: [x for x in letters if r.random() < 0.4]
    profiles = [(f"e{i}", [r.choice("ABCDEF")], [r.choice("GHIJ")], some("kl"), some("mn"), some("op")) for i in range(25)]
    inputs = [(f"i{i}", r.choice(["a", "b", "c", "G", "zz", " "]), some("kl"), some("mn"), some("op")) for i in range(60)]
    known = spark.createDataFrame(profiles, "entity_id string, names array<string>, aliases array<string>, lexical_keys array<string>, language_keys array<string>, context_keys array<string>")
    given = spark.createDataFrame(inputs, "input_id string, text string, lexical_keys array<string>, language_keys array<string>, context_keys array<string>")
    wanted = {x.input_id: (x.decision, x.entity_id) for x in resolution.decide(given, resolution.candidates(given, known), threshold, margin).collect()}
    assert {x.input_id: (x.decision, x.entity_id) for x in resolution.resolve(given, known, threshold, margin).collect()} == wanted
    assert len({d for d, _ in wanted.values()}) >= 2


def test_independent_premises_need_permission(spark):
    from dataclasses import replace

    rule = r.Rule("two", "conditional", (r.Pattern(X, r.Text("p"), Y), r.Pattern(Z, r.Text("q"), r.Var("w"))), r.Pattern(X, r.Text("both"), Z))
    known = table(spark, assertion("a", "p", "b"), assertion("c", "q", "d"))
    with pytest.raises(r.RuleError):
        reasoning.derive([rule], known)
    assert reasoning.derive([replace(rule, independent=True)], known).count() == 1


def test_traces_name_what_they_were_derived_from(spark):
    known = table(spark, assertion("a", "p", "b"), assertion("b", "p", "c"))
    trace = reasoning.reason(known, registry(TRANSITIVE), "deep", snapshot="s1", version=7).derived.first().traces[0]
    assert (trace.rule_id, trace.profile, trace.snapshot, trace.input_version, trace.depth) == ("t", "deep", "s1", 7, 0)


def test_stream_and_batch_machines_agree(spark):
    rows = [("a", 1, "received"), ("a", 2, "mapped"), ("a", 3, "normalized"), ("b", 1, "normalized"), ("b", 2, "received")]
    events = spark.createDataFrame(rows, "candidate string, seq bigint, state string")
    from factloom.streaming import ingest

    state = type("S", (), {"exists": False, "update": lambda self, x: None})
    by_stream = {}
    for c in "ab":
        for out in ingest._judge((c,), iter([events.where(F.col("candidate") == c).toPandas()]), state()):
            by_stream |= {(x.candidate, x.seq): (x.before, x.allowed) for x in out.itertuples()}
    assert by_stream == {(x.candidate, x.seq): (x.before, x.allowed) for x in ingestion.transitions(events, ingestion.CANDIDATE_STEPS, ["candidate"], "seq").collect()}
