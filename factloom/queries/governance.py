"""Queries of ontology, ingestion, index, storage, metadata and text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import temporal, text
from factloom.operators import index, ingestion, metadata, ontology, versioning
from factloom.operators.lineage import checkpoint_folder as _folder
from factloom.queries.registry import register
from factloom.sources import fixture, json_source, store
from factloom.streaming import ingest as streaming

_facts = fixture.duckdb_facts
_table = fixture.table


# Ontology: region <- nation <- customer and supplier as a class tree.
_EDGES = """WITH e AS (SELECT 'nation-' || n_nationkey AS child, 'region-' || n_regionkey AS parent FROM nation UNION SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
    UNION SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier)"""


def _edges(spark, sf_dir):
    pairs = [("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey")]
    out = None
    for child, c, parent, p in pairs:
        rows = _table(spark, sf_dir, child).select(F.concat(F.lit(f"{child}-"), c).alias("child"), F.concat(F.lit(f"{parent}-"), p).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


@register("taxonomy_descendants", f"{_EDGES} SELECT child AS key FROM e WHERE parent = 'region-1' UNION SELECT b.child FROM e a JOIN e b ON b.parent = a.child WHERE a.parent = 'region-1'")
def taxonomy_descendants(spark, sf_dir):
    return ontology.descendants(_edges(spark, sf_dir), "region-1")


@register("taxonomy_reachable", f"{_EDGES}, r AS (SELECT child, parent FROM e UNION SELECT a.child, b.parent FROM e a JOIN e b ON a.parent = b.child) SELECT child AS descendant, parent AS ancestor FROM r")
def taxonomy_reachable(spark, sf_dir):
    return ontology.reachable(_edges(spark, sf_dir))


@register("taxonomy_parents_children", f"{_EDGES} SELECT 'parent' AS side, parent AS key FROM e WHERE child = 'nation-3' UNION ALL SELECT 'child', child FROM e WHERE parent = 'nation-3'")
def taxonomy_parents_children(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    up = ontology.parents(edges, "nation-3").select(F.lit("parent").alias("side"), F.col("parent").alias("key"))
    return up.unionByName(ontology.children(edges, "nation-3").select(F.lit("child").alias("side"), F.col("child").alias("key")))


@register(
    "ontology_report",
    """SELECT 'taxonomy-cycle' AS code, 'region-0' AS subject UNION ALL SELECT 'taxonomy-cycle', 'nation-' || n_nationkey FROM nation WHERE n_nationkey = 0
    UNION ALL SELECT 'missing-taxonomy-class', 'region-' || r_regionkey || '>world' FROM region WHERE r_regionkey > 0
    UNION ALL SELECT 'missing-range-class', 'located-in' UNION ALL SELECT 'missing-constraint-class', 'region-2' UNION ALL SELECT 'invalid-constraint', 'region-1' UNION ALL SELECT 'duplicate-class', 'region-4'""",
)
def ontology_report(spark, sf_dir):
    """A class tree with one cycle (region-0 below nation-0, which is put below region-0), and one fault of each other kind."""
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    classes = region.select(F.concat(F.lit("region-"), "r_regionkey").alias("key")).unionByName(nation.select(F.concat(F.lit("nation-"), "n_nationkey").alias("key")))
    classes = classes.unionByName(classes.where("key = 'region-4'"))
    up = region.select(F.concat(F.lit("region-"), "r_regionkey").alias("child"), F.when(F.col("r_regionkey") == 0, "nation-0").otherwise("world").alias("parent"))
    tree = nation.where("n_nationkey > 0").select(F.concat(F.lit("nation-"), "n_nationkey").alias("child"), F.lit("region-3").alias("parent"))
    loop = nation.where("n_nationkey = 0").select(F.lit("nation-0").alias("child"), F.lit("region-0").alias("parent"))
    properties = spark.createDataFrame([("located-in", ["region-1"], ["galaxy"]), ("part-of", ["region-1"], ["region-2"])], "key string, domain array<string>, range array<string>")
    constraints = spark.createDataFrame(
        [("region-1", "cardinality", 3, 2, None), ("region-2", "disjoint-with", None, None, "nowhere"), ("region-3", "cardinality", 0, None, None)], "owner string, kind string, low int, high int, other string"
    )
    return ontology.report(classes, properties, up.unionByName(tree).unionByName(loop), constraints)


@register("ontology_domain_range", "SELECT p_partkey, p_type IN ('PROMO', 'SMALL') AS in_domain FROM part")
def ontology_domain_range(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", ontology.in_domain(F.array(F.lit("PROMO"), F.lit("SMALL")), F.col("p_type")).alias("in_domain"))


@register("semantic_types", "SELECT p_partkey, CASE WHEN 'brand-' || p_brand < 'name-' || p_name THEN p_type || ',brand-' || p_brand || ',name-' || p_name END AS types FROM part")
def semantic_types(spark, sf_dir):
    types = ontology.semantic_types(F.col("p_type"), F.array(F.concat(F.lit("name-"), "p_name"), F.col("p_type"), F.concat(F.lit("brand-"), "p_brand"), F.concat(F.lit("brand-"), "p_brand")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(types, ",").alias("types"))


# Ingestion over events: source events, key event_id, version the day, mode by value.
_REC = """rec AS (SELECT 'events' AS source_id, 'user-' || user_id AS record_key, 'day-' || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) AS version, event_id, event_type, value, user_id FROM events)"""


def _records(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    day = F.concat(F.lit("day-"), F.expr("ts_us div 86400000000"))
    return rows.select(F.lit("events").alias("source_id"), F.concat(F.lit("user-"), "user_id").alias("record_key"), day.alias("version"), "event_id", "event_type", "value", "user_id", F.lit(0).alias("ordinal"))


@register("source_dedup", f"WITH {_REC} SELECT event_id, row_number() OVER (PARTITION BY record_key, version ORDER BY event_id) = 1 AS first_seen FROM rec")
def source_dedup(spark, sf_dir):
    return ingestion.source_dedup(_records(spark, sf_dir), "event_id").select("event_id", "first_seen")


@register(
    "semantic_dedup",
    f"WITH {_REC}, w AS (SELECT event_id, record_key, version, first_value(record_key || '@' || version || '#' || event_id) OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id) AS n FROM rec) SELECT event_id, CASE WHEN n > 1 THEN f END AS duplicate_of FROM w",
)
def semantic_dedup(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("version", F.concat_ws("#", "version", "event_id"))
    rows = rows.withColumn("ids", F.array(F.col("event_type"), F.concat(F.lit("bucket-"), F.col("user_id") % 10), F.col("event_type")))
    found = ingestion.semantic_dedup(rows, "ids", "event_id")
    return found.select("event_id", F.when(F.col("duplicate_of").isNotNull(), F.concat_ws("@", "duplicate_of.record_key", "duplicate_of.version")).alias("duplicate_of"))


@register(
    "validation_status",
    f"""WITH {_REC}, s AS (SELECT record_key, version, max(CASE WHEN value > 400 THEN 4 WHEN event_type = 'error' AND value > 200 THEN 3 WHEN value > 100 THEN 2 ELSE 0 END) AS worst FROM rec GROUP BY record_key, version)
    SELECT record_key, version, CASE worst WHEN 4 THEN 'blocked' WHEN 3 THEN 'quarantined' WHEN 0 THEN 'valid' ELSE 'valid-with-warnings' END AS status FROM s""",
)
def validation_status(spark, sf_dir):
    rows = _records(spark, sf_dir)
    code = F.when(F.col("value") > 400, "too-large").when((F.col("event_type") == "error") & (F.col("value") > 200), "bad-error").when(F.col("value") > 100, "large")
    found = rows.select(*ingestion.KEY, code.alias("code")).where("code IS NOT NULL")
    policy = spark.createDataFrame([("too-large", "fatal"), ("large", "warning")], "code string, severity string")
    judged = ingestion.with_policy(found, policy)
    return ingestion.validation_status(judged, by=rows).select("record_key", "version", "status")


_GATE = f"""WITH {_REC}, g AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'candidate-mismatch' WHEN value > 450 THEN 'validation-blocked' WHEN value > 400 THEN 'validation-quarantined'
    WHEN event_id % 7 = 0 THEN 'approval-target-mismatch' WHEN event_id % 5 = 0 THEN 'not-approved'
    WHEN event_type = 'error' OR (event_type = 'view' AND user_id % 2 = 0) THEN 'authenticity-not-permitted' WHEN user_id % 2 = 1 AND event_id % 3 = 0 THEN 'curation-required' END AS approval_code FROM rec)"""


def _gated(spark, sf_dir):
    rows = _records(spark, sf_dir)
    rules = spark.createDataFrame([("odd", True, False, False, True)], "source_class string, allows_unverified boolean, allows_disputed boolean, allows_non_authentic boolean, curation_required boolean")
    key = F.col("event_id").cast("string")
    rows = rows.withColumns({
        "candidate": key,
        "source_class": F.when(F.col("user_id") % 2 == 1, "odd").otherwise("even"),
        "validation_candidate": F.when(F.col("event_id") % 11 == 0, "other").otherwise(key),
        "validation_status": F.when(F.col("value") > 450, "blocked").when(F.col("value") > 400, "quarantined").otherwise("valid"),
        "decision_candidate": F.when(F.col("event_id") % 7 == 0, "other").otherwise(key),
        "outcome": F.when(F.col("event_id") % 5 == 0, "rejected").otherwise("approved"),
        "authenticity": F.when(F.col("event_type") == "error", "disputed").when(F.col("event_type") == "view", "unverified").otherwise("authentic"),
        "curation": F.when(F.col("event_id") % 3 == 0, "skipped").otherwise("performed"),
    }).withColumn("decision_class", F.col("source_class"))
    return ingestion.with_rules(rows, rules, {"allows_unverified": False, "allows_disputed": False, "allows_non_authentic": False, "curation_required": False})


@register("approval_gate", f"{_GATE} SELECT event_id, approval_code FROM g")
def approval_gate(spark, sf_dir):
    return ingestion.approval_gate(_gated(spark, sf_dir)).select("event_id", "approval_code")


@register(
    "publication_gate",
    f"""{_GATE} SELECT event_id, CASE WHEN approval_code = 'candidate-mismatch' THEN approval_code WHEN user_id % 13 = 0 THEN 'invalid-subgraph/unknown-entity' WHEN user_id % 17 = 0 THEN 'reviewed-subgraph-mismatch'
    WHEN user_id % 19 = 0 THEN 'missing-source-authenticity' WHEN approval_code IS NOT NULL THEN 'approval/' || approval_code WHEN event_id % 23 = 0 THEN 'index-not-ready' WHEN event_id % 29 = 0 THEN 'index-reference-mismatch' END AS publication_code FROM g""",
)
def publication_gate(spark, sf_dir):
    rows = _gated(spark, sf_dir).withColumns({
        "subgraph_code": F.when(F.col("user_id") % 13 == 0, "unknown-entity"),
        "revision": F.lit("r1"),
        "validation_revision": F.lit("r1"),
        "approval_revision": F.when(F.col("user_id") % 17 == 0, "r0").otherwise("r1"),
        "recorded_authenticity": F.when(F.col("user_id") % 19 != 0, F.col("authenticity")),
        "readiness": F.when(F.col("event_id") % 23 == 0, "pending").otherwise("ready"),
        "index_source": F.col("source_id"),
        "index_key": F.when(F.col("event_id") % 29 == 0, "other").otherwise(F.col("record_key")),
    })
    return ingestion.publication_gate(rows).select("event_id", "publication_code")


_STATES = ("received", "normalized", "mapped", "resolved", "published")


# The state machine event by event: a refused step leaves the state.
_MACHINE = """WITH RECURSIVE s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'received' WHEN 'click' THEN 'normalized' WHEN 'view' THEN 'mapped' WHEN 'purchase' THEN 'resolved' ELSE 'published' END AS state,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    w AS (SELECT user_id, event_id, n, state, CAST(NULL AS VARCHAR) AS before, state = 'received' AS allowed, CASE WHEN state = 'received' THEN state END AS after FROM s WHERE n = 1
      UNION ALL SELECT user_id, event_id, n, state, before, ok, CASE WHEN ok THEN state ELSE before END FROM
      (SELECT s.*, w.after AS before, CASE WHEN w.after IS NULL THEN s.state = 'received' ELSE (w.after = 'received' AND s.state = 'normalized') OR (w.after = 'normalized' AND s.state = 'mapped') OR (w.after = 'mapped' AND s.state = 'resolved') END AS ok
       FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1) x)"""


@register("candidate_transitions", f"{_MACHINE} SELECT event_id, before, state, allowed FROM w")
def candidate_transitions(spark, sf_dir):
    return ingestion.transitions(_stated(_table(spark, sf_dir, "events")), ingestion.CANDIDATE_STEPS, ["candidate"], "seq").select(F.col("seq").alias("event_id"), "before", "state", "allowed")


@register("candidate_current_states", f"{_MACHINE} SELECT CAST(user_id AS VARCHAR) AS candidate, max_by(after, n) AS state FROM w GROUP BY user_id HAVING max_by(coalesce(after, ''), n) <> ''")
def candidate_current_states(spark, sf_dir):
    return ingestion.current_states(_stated(_table(spark, sf_dir, "events")), ingestion.CANDIDATE_STEPS, ["candidate"], "seq")


def _stated(events):
    names = dict(zip(("signup", "click", "view", "purchase"), _STATES))
    state = F.lit("published")
    for kind, name in names.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    return events.select(F.col("user_id").cast("string").alias("candidate"), F.col("event_id").alias("seq"), state.alias("state"))


@register(
    "governance_transitions",
    """WITH t(f, t) AS (VALUES ('awaiting-validation', 'quarantined'), ('awaiting-validation', 'blocked'), ('awaiting-validation', 'awaiting-approval'), ('awaiting-validation', 'rejected'), ('quarantined', 'awaiting-validation'),
      ('quarantined', 'awaiting-approval'), ('quarantined', 'rejected'), ('quarantined', 'blocked'), ('awaiting-approval', 'approved'), ('awaiting-approval', 'rejected'), ('awaiting-approval', 'quarantined'), ('awaiting-approval', 'blocked'), ('approved', 'withdrawn')),
    s(i, name) AS (VALUES (0, 'awaiting-validation'), (1, 'quarantined'), (2, 'awaiting-approval'), (3, 'approved'), (4, 'blocked'), (5, 'rejected'), (6, 'withdrawn'))
    SELECT e.event_id, EXISTS (SELECT 1 FROM t WHERE t.f = a.name AND t.t = b.name) AS allowed FROM events e JOIN s a ON a.i = e.event_id % 7 JOIN s b ON b.i = e.user_id % 7""",
)
def governance_transitions(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("awaiting-validation", "quarantined", "awaiting-approval", "approved", "blocked", "rejected", "withdrawn")])
    at = lambda c: F.element_at(names, (F.col(c) % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", ingestion.allowed(ingestion.GOVERNANCE_STEPS, at("event_id"), at("user_id")).alias("allowed"))


@register("run_completion", "SELECT 'run-' || (user_id % 25) AS run_id, bool_and(event_type <> 'error' OR value < 300) AS complete FROM events GROUP BY user_id % 25")
def run_completion(spark, sf_dir):
    state = F.when((F.col("event_type") != "error") | (F.col("value") < 300), "synchronized").otherwise("blocked")
    return ingestion.run_complete(_table(spark, sf_dir, "events").select(F.concat(F.lit("run-"), F.col("user_id") % 25).alias("run_id"), state.alias("state")))


@register("reprocess_delta", f"WITH {_REC} SELECT event_id FROM rec WHERE value > 250")
def reprocess_delta(spark, sf_dir):
    """Records whose content differs from the previous version's: those above a value were changed."""
    rows = _records(spark, sf_dir).withColumn("record_key", F.col("event_id").cast("string"))
    now = rows.withColumn("content", F.when(F.col("value") > 250, "new").otherwise("old"))
    return ingestion.reprocess(now, "delta", previous=rows.withColumn("content", F.lit("old"))).select("event_id")


@register(
    "subgraph_missing_refs",
    """WITH a AS (SELECT l_orderkey % 50 AS c, l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS n FROM lineitem)
    SELECT 'batch-' || c AS candidate, 'unknown-assertion-entity' AS code, 'part-' || p AS subject FROM a WHERE p % 10 = 0 GROUP BY c, p""",
)
def subgraph_missing_refs(spark, sf_dir):
    """Batches of order lines as subgraphs: parts whose number ends in 0 are declared nowhere."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    batch = F.concat(F.lit("batch-"), F.col("l_orderkey") % 50)
    ref = lambda kind, column: F.struct(F.lit("entity").alias("kind"), F.concat(F.lit(f"{kind}-"), column).alias("id"))
    ids = F.expr("cast(array() as array<string>)")
    assertions = lines.select(batch.alias("candidate"), F.lit("assertion").alias("kind"), F.concat_ws(">", "l_orderkey", "l_partkey").alias("id"), F.lit(True).alias("valid"), ref("order", "l_orderkey").alias("subject"), ref("part", "l_partkey").alias("object"), ids.alias("assertion_ids"), F.lit("").alias("content"))
    orders = lines.select(batch.alias("candidate"), "l_orderkey").distinct()
    entities = orders.select("candidate", F.lit("entity").alias("kind"), F.concat(F.lit("order-"), "l_orderkey").alias("id"), F.lit(True).alias("valid"), F.lit(None).cast("struct<kind:string,id:string>").alias("subject"), F.lit(None).cast("struct<kind:string,id:string>").alias("object"), ids.alias("assertion_ids"), F.lit("").alias("content"))
    existing = _table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.lit("entity").alias("kind"), F.concat(F.lit("part-"), "p_partkey").alias("id"))
    supports = spark.createDataFrame([], "candidate string, assertion_id string, evidence_id string")
    crosswalk = spark.createDataFrame([], "candidate string, source_id string, value string, entity_id string, declared boolean")
    return ingestion.subgraph_findings(assertions.unionByName(entities), supports, crosswalk, existing).select("candidate", "code", "subject")


# JSON sources.
@register("json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS record_key, CASE WHEN event_id % 10 = 0 THEN 'unsupported-content-type' END AS error FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, 'unsupported-content-type' FROM events WHERE event_id % 10 = 0")
def json_decode(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"), F.col("ts").alias("captured_at"))
    kind = F.when(F.col("event_id") % 10 == 0, "text/plain").otherwise("Application/JSON; charset=utf-8")
    raw = json_source.capture(rows, operation="import", source_id="events", source_class="machine-generated", artifact="events.parquet", content_type=kind, version="1")
    return json_source.decode(raw, "k").select("event_id", "record_key", "error")


@register("content_type_gate", "SELECT page_id, page_id % 3 <> 2 AS is_json FROM pages")
def content_type_gate(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "application/ld+json").when(F.col("page_id") % 3 == 1, " APPLICATION/JSON;v=1").otherwise("text/html")
    return _table(spark, sf_dir, "pages").select("page_id", json_source.is_json(kind).alias("is_json"))


# Index.
_TOKENS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


def _texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.concat(F.lit("doc-"), "doc_id").alias("reference"), "text")


@register("index_postings", f"WITH t AS (SELECT 'doc-' || doc_id AS doc, unnest({_TOKENS}) AS term FROM documents) SELECT doc, count(DISTINCT term) AS terms FROM t WHERE term <> '' GROUP BY doc")
def index_postings(spark, sf_dir):
    found = index.postings(_texts(spark, sf_dir)).groupBy("ref").agg(F.count(F.lit(1)).alias("terms"))
    return found.select(F.element_at(F.split("ref", "\x1f"), 2).alias("doc"), "terms")


@register(
    "lexical_score",
    f"""WITH q AS (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark), d AS (SELECT DISTINCT 'doc-' || doc_id AS doc, term FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) x),
    s AS (SELECT item_id, doc, count(*) AS score, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc) AS place FROM q JOIN d USING (term) WHERE term <> '' GROUP BY item_id, doc)
    SELECT item_id, doc, score, CAST(place AS INTEGER) AS place FROM s WHERE place <= 10""",
)
def lexical_score(spark, sf_dir):
    """The ten best documents for each benchmark text (the report's limit)."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index.hits(index.search(index.postings(_texts(spark, sf_dir)), queries), 10)
    return found.select(F.col("query_id").alias("item_id"), F.element_at(F.split("ref", "\x1f"), 2).alias("doc"), "score", "place")


@register("index_forward", "SELECT 'entity' AS target_kind, 'part-' || p_partkey AS reference, sha256('entity' || chr(31) || 'part-' || p_partkey) AS index_id FROM part")
def index_forward(spark, sf_dir):
    return index.forward(_table(spark, sf_dir, "part").select(F.lit("entity").alias("target_kind"), F.concat(F.lit("part-"), "p_partkey").alias("reference")))


@register("index_reverse", "SELECT 'part-' || p_partkey AS reference, sha256('entity' || chr(31) || 'part-' || p_partkey) AS index_id FROM part")
def index_reverse(spark, sf_dir):
    """Every index id taken back to its reference."""
    targets = _table(spark, sf_dir, "part").select(F.lit("entity").alias("target_kind"), F.concat(F.lit("part-"), "p_partkey").alias("reference"))
    return index.forward(targets).select("index_id").join(index.reverse(targets), "index_id").select("reference", "index_id")


@register(
    "match_explanation",
    f"""WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) x), d AS (SELECT DISTINCT 'doc-' || doc_id AS doc, term FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) x)
    SELECT item_id, doc, 'matched ' || count(*) || ' terms' AS summary, string_agg(term, ',' ORDER BY term) AS terms FROM q JOIN d USING (term) WHERE term <> '' GROUP BY item_id, doc""",
)
def match_explanation(spark, sf_dir):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index.explained(_texts(spark, sf_dir), queries)
    return found.select(F.col("query_id").alias("item_id"), F.element_at(F.split("ref", "\x1f"), 2).alias("doc"), "summary", F.array_join("matched_terms", ",").alias("terms"))


@register("index_persisted", "SELECT 'part-' || p_partkey AS reference, sha256('entity' || chr(31) || 'part-' || p_partkey) AS index_id, CAST(7 AS BIGINT) AS version FROM part")
def index_persisted(spark, sf_dir):
    """The forward map written with its state and read again."""
    targets = _table(spark, sf_dir, "part").select(F.lit("entity").alias("target_kind"), F.concat(F.lit("part-"), "p_partkey").alias("reference"))
    folder = f"{_folder(spark)}/index-{uuid.uuid4().hex}"
    index.persist(index.forward(targets).select("reference", "target_kind", "index_id"), index.IndexState("forward", True, version=7), folder)
    table, state = index.load(spark, "forward", folder)
    return table.select("reference", "index_id", F.lit(state.version).cast("long").alias("version"))


@register("index_sync", "SELECT 'part-' || p_partkey AS reference FROM part WHERE p_partkey % 3 <> 1")
def index_sync(spark, sf_dir):
    """A map of two thirds of the parts after a batch that writes the last third and removes one."""
    targets = _table(spark, sf_dir, "part").select(F.lit("entity").alias("target_kind"), F.concat(F.lit("part-"), "p_partkey").alias("reference"), "p_partkey")
    start = index.forward(targets.where("p_partkey % 3 <> 2"))
    return index.synchronised(start, targets.where("p_partkey % 3 = 2"), targets.where("p_partkey % 3 = 1")).select("reference")


# Storage and versions: events in time order, a day is a version, a user a record.
@register(
    "recovery_replay",
    """WITH d AS (SELECT 'user-' || user_id AS id, event_type, event_id, epoch_us(ts) // 86400000000 AS day FROM events)
    SELECT id, max_by(event_type, event_id) AS content, max(day) AS version FROM d GROUP BY id""",
)
def recovery_replay(spark, sf_dir):
    """A snapshot after ten days with the journal of the other days over it equals the last write of each user."""
    rows = _table(spark, sf_dir, "events").select(F.expr("ts_us div 86400000000").alias("version"), F.col("event_id").alias("seq"), F.lit("user").alias("kind"), F.concat(F.lit("user-"), "user_id").alias("id"), F.col("event_type").alias("content"))
    rows = rows.withColumn("base", F.col("version") - 1)
    first = rows.agg(F.min("version")).first()[0]
    tenth = first + 9
    snapshot = rows.where(F.col("version") <= tenth).groupBy("kind", "id").agg(F.max_by("content", F.struct("version", "seq")).alias("content"), F.max("version").alias("version"))
    return store.recover(snapshot, tenth, rows).select("id", "content", "version")


@register("snapshot_read", "SELECT 'nation-' || n_nationkey AS id, n_name AS content FROM nation")
def snapshot_read(spark, sf_dir):
    """Two commits; the snapshot of the first doesn't see the second."""
    kept = store.VersionedStore(spark, f"{_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = _table(spark, sf_dir, "nation").select(F.lit("entity").alias("kind"), F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.col("n_name").alias("content"), F.lit("created").alias("change"), F.lit(0).cast("bigint").alias("seq"))
    first = kept.commit(rows, 0)
    pinned = kept.snapshot(first)
    kept.commit(rows.withColumns({"content": F.lit("changed"), "change": F.lit("updated")}), first)
    return pinned.read().select("id", "content")


@register("store_current_state", "SELECT 'nation-' || n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END AS content, CAST(CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS version FROM nation")
def store_current_state(spark, sf_dir):
    kept = store.VersionedStore(spark, f"{_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = _table(spark, sf_dir, "nation").select("n_regionkey", F.lit("entity").alias("kind"), F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.col("n_name").alias("content"), F.lit("created").alias("change"), F.lit(0).cast("bigint").alias("seq"))
    version = kept.commit(rows, 0)
    kept.commit(rows.where("n_regionkey = 1").withColumns({"content": F.lit("changed"), "change": F.lit("updated")}), version)
    return kept.state().select("id", "content", "version")


@register("journal_committed", "SELECT event_id AS number FROM events WHERE event_id % 4 <> 0")
def journal_committed(spark, sf_dir):
    """Prepared entries without a commit, and torn lines, are left out."""
    rows = _table(spark, sf_dir, "events").select("event_id")
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    prepares = rows.select(F.to_json(F.struct(F.col("event_id").alias("number"))).alias("value"), F.concat(number, F.lit(".prepare")).alias("file"))
    commits = rows.where("event_id % 4 <> 0").select(F.to_json(F.struct(F.col("event_id").alias("number"))).alias("value"), F.concat(number, F.lit(".commit")).alias("file"))
    torn = rows.where("event_id % 4 = 0").select(F.concat(F.lit('{"number":'), F.col("event_id").cast("string")).alias("value"), F.concat(number, F.lit(".commit")).alias("file"))
    return store.committed(prepares.unionByName(commits).unionByName(torn)).select("number")


@register("latest_changes", "SELECT 'user-' || user_id AS target_id, max_by(event_type, event_id) AS kind, max(event_id) AS seq FROM events GROUP BY user_id")
def latest_changes(spark, sf_dir):
    changes = _table(spark, sf_dir, "events").select(F.lit("user").alias("target_kind"), F.concat(F.lit("user-"), "user_id").alias("target_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return versioning.latest(changes).select("target_id", "kind", "seq")


@register(
    "compatibility_rollup",
    """WITH r AS (SELECT 'pair-' || user_id AS pair, list_extract(['schema', 'ontology', 'rules', 'index', 'storage', 'api'], CAST(event_id % 6 + 1 AS BIGINT)) AS dimension, event_id % 6 AS n, CASE WHEN value > 480 THEN 'incompatible' WHEN value > 300 THEN 'migration-required' ELSE 'compatible' END AS level FROM events)
    SELECT pair, bool_and(level = 'compatible') AS all_compatible, bool_or(level = 'incompatible') AS any_incompatible, min_by(CASE WHEN level = 'incompatible' THEN dimension END, CASE WHEN level = 'incompatible' THEN n END) AS first_incompatible FROM r GROUP BY pair""",
)
def compatibility_rollup(spark, sf_dir):
    names = F.array(*[F.lit(d) for d in versioning.DIMENSIONS])
    rows = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("pair-"), "user_id").alias("pair"),
        F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("dimension"),
        F.when(F.col("value") > 480, "incompatible").when(F.col("value") > 300, "migration-required").otherwise("compatible").alias("level"),
    )
    return versioning.compatibility(rows)


# Metadata.
@register("evidence_validity", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'missing-location' WHEN event_id % 4 = 2 THEN 'missing-inputs' WHEN event_id % 4 = 3 AND user_id % 2 = 0 THEN 'self-dependency' END AS code FROM events")
def evidence_validity(spark, sf_dir):
    k, none = F.col("event_id") % 4, F.expr("cast(array() as array<string>)")
    own = F.concat(F.lit("e-"), F.col("event_id").cast("string"))
    inputs = F.when(k == 2, none).otherwise(F.array(F.when(F.col("user_id") % 2 == 0, own).otherwise(F.lit("e-other"))))
    code = metadata.evidence_code(own, F.when(k < 2, "direct").otherwise("derived"), F.when(k == 0, F.array(F.lit("page"))).otherwise(none), inputs)
    return _table(spark, sf_dir, "events").select("event_id", code.alias("code"))


@register("evidence_support", f"{_facts('supply')}, l AS (SELECT aid, unnest(evidence) AS line FROM facts) SELECT aid AS assertion_id, line AS evidence_id, 'supports' AS role, CAST(NULL AS VARCHAR) AS code FROM l")
def evidence_support(spark, sf_dir):
    known = fixture.assertions(spark, sf_dir, "supply")
    links = known.select("assertion_id", F.explode("evidence_ids").alias("evidence_id"), F.lit("supports").alias("role"))
    return metadata.support_links(known, links.select("evidence_id").distinct(), links)


@register("verification_latest", "SELECT 'user-' || user_id AS evidence_id, max_by(event_type, event_id) AS outcome, count(*) AS verifications FROM events GROUP BY user_id")
def verification_latest(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("evidence_id"), F.col("event_type").alias("outcome"), F.col("ts_us").alias("verified_at"), F.col("event_id").alias("verification_id"))
    return metadata.latest_verification(rows)


@register("lineage_append", "SELECT DISTINCT 'n' || user_id AS from_id, 'n' || (event_id % 100) AS to_id, event_type AS kind FROM events WHERE user_id <> event_id % 100")
def lineage_append(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("n"), "user_id").alias("from_id"), F.concat(F.lit("n"), F.col("event_id") % 100).alias("to_id"), F.col("event_type").alias("kind"))
    known = metadata.append_lineage(spark.createDataFrame([], "from_id string, to_id string, kind string"), rows.where("event_id % 2 = 0").drop("event_id"))
    return metadata.append_lineage(known, rows.drop("event_id"))


@register("audit_append", "SELECT DISTINCT 'user-' || user_id AS target_id, event_type AS action FROM events")
def audit_append(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("target_id"), F.col("event_type").alias("action"))
    return metadata.append_audit(rows.limit(0), rows)


@register("provenance_append", "SELECT 'user-' || user_id AS target_id, event_type AS activity_id, count(*) > 0 AS recorded FROM events GROUP BY user_id, event_type")
def provenance_append(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("target_id"), F.col("event_type").alias("activity_id"), F.lit(True).alias("recorded"))
    return metadata.append_history(rows.where("activity_id = 'click'").distinct(), rows)


@register("origin_rules", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'version-without-source' WHEN event_id % 5 = 0 THEN 'locator-without-reference' END AS code FROM events")
def origin_rules(spark, sf_dir):
    at = lambda n: F.when(F.col("event_id") % n != 0, "x")
    return _table(spark, sf_dir, "events").select("event_id", metadata.origin_code(at(3), at(5), F.lit("v"), F.lit("/1")).alias("code"))


@register(
    "authority_check",
    f"""{_facts('suppliers', 'nations')} SELECT si AS subject_id, auth AS reliability, CASE WHEN si LIKE '%3' THEN 'target-mismatch' WHEN oi = 'nation-4' THEN 'target-mismatch' WHEN auth IS NULL THEN 'no-dimension' END AS code FROM facts""",
)
def authority_check(spark, sf_dir):
    """Authorities whose owner is another assertion or a source, those that say nothing (nations), and good ones."""
    rows = fixture.assertions(spark, sf_dir, "suppliers", "nations")
    owner = F.when(F.col("subject.id").endswith("3"), "other").otherwise(F.col("assertion_id"))
    kind = F.when(F.col("object.id") == "nation-4", "source").otherwise("assertion")
    code = metadata.authority_code(kind, owner, F.lit("assertion"), F.col("assertion_id"), F.col("authority"))
    return rows.select(F.col("subject.id").alias("subject_id"), F.get("authority.value", F.lit(0)).alias("reliability"), code.alias("code"))


@register("confidence_range", "SELECT event_id, value / 400 <= 1 AS valid FROM events")
def confidence_range(spark, sf_dir):
    valid = metadata.confidence_valid(F.lit("numeric"), F.col("value") / 400, F.lit(None).cast("string"), F.array(F.lit("measured")))
    return _table(spark, sf_dir, "events").select("event_id", valid.alias("valid"))


@register("epistemic_subset", f"{_facts('orders', 'labels')} SELECT DISTINCT status, status IN ('known', 'disputed') AS epistemic FROM facts")
def epistemic_subset(spark, sf_dir):
    return fixture.assertions(spark, sf_dir, "orders", "labels").select("status", metadata.is_epistemic(F.col("status")).alias("epistemic")).distinct()


@register("relationship_vocabulary", "SELECT * FROM (VALUES ('part-of', 'has-part'), ('located-in', 'location-of'), ('placed-by', 'placed'), ('contains', 'contained-in'), ('supplied-by', 'supplies'), ('instance-of', 'has-instance')) t(inverse, predicate)")
def relationship_vocabulary(spark, sf_dir):
    return metadata.reversed_relationships(fixture.relationships(spark)).select("predicate", "inverse")


# Text and time.
@register("text_tokenize", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT doc_id, count(*) AS tokens FROM t WHERE term <> '' GROUP BY doc_id")
def text_tokenize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).cast("long").alias("tokens")).where("tokens > 0")


@register("text_whitespace_modes", "SELECT p_partkey, p_name || ' ' AS preserved, p_name AS trimmed, regexp_replace(p_name || ' x', ' +', ' ', 'g') AS collapsed FROM part")
def text_whitespace_modes(spark, sf_dir):
    padded = F.concat("p_name", F.lit(" "))
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        text.whitespace_mode(padded, "preserve").alias("preserved"),
        text.whitespace_mode(padded, "trim").alias("trimmed"),
        text.whitespace_mode(F.concat(F.lit("\t"), padded, F.lit(" \n x ")), "collapse-whitespace").alias("collapsed"),
    )


@register("canonical_identity", f"{_facts('orders')} SELECT si AS subject_id, aid AS assertion_id FROM facts")
def canonical_identity(spark, sf_dir):
    return fixture.assertions(spark, sf_dir, "orders").select(F.col("subject.id").alias("subject_id"), "assertion_id")


@register("label_validation", "SELECT doc_id, strpos(text, chr(10)) = 0 AS valid FROM documents")
def label_validation(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.valid_label(F.col("text")).alias("valid"))


@register("allen_inverse", "SELECT * FROM (VALUES ('before', 'after'), ('after', 'before'), ('meets', 'met-by'), ('met-by', 'meets'), ('overlaps', 'overlapped-by'), ('overlapped-by', 'overlaps'), ('starts', 'started-by'), ('started-by', 'starts'), ('during', 'contains'), ('contains', 'during'), ('finishes', 'finished-by'), ('finished-by', 'finishes'), ('equals', 'equals')) t(relation, inverse)")
def allen_inverse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in temporal.ALLEN_INVERSE], "relation string")
    return rows.select("relation", temporal.allen_inverse(F.col("relation")).alias("inverse"))


@register(
    "interval_contains",
    f"{_facts('events')} SELECT aid AS assertion_id, CASE WHEN tag = 'unknown' THEN NULL ELSE s_us <= 1704499200000000 AND (e_us IS NULL OR 1704499200000000 < e_us) END AS found FROM facts",
)
def interval_contains(spark, sf_dir):
    """Three-valued: null where a boundary is unknown."""
    when = temporal.instant(F.lit(1704499200))
    return fixture.assertions(spark, sf_dir, "events").select("assertion_id", temporal.contains(F.col("validity"), when).alias("found"))


@register("instant_far", "SELECT event_id, 'unix:' || (253402300799 - event_id) || '.' || '999999000' AS text FROM events")
def instant_far(spark, sf_dir):
    """Instants at the far end of the calendar, where a double has no room for microseconds."""
    us = F.lit(253402300799999999).cast("bigint") - F.col("event_id") * 1_000_000
    return _table(spark, sf_dir, "events").select("event_id", temporal.instant_text(temporal.instant_of_micros(us)).alias("text"))


@register("instant_text", "SELECT event_id, 'unix:' || (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || '000' AS text FROM events")
def instant_text(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", temporal.instant_text(temporal.instant_of_micros(F.col("ts_us"))).alias("text"))


# Streaming forms of the ingestion stages, over everything that is there; they equal the batch result.
def _stream(spark, sf_dir):
    return streaming.read(spark, sf_dir, "events.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


@register("streaming_source_dedup", "SELECT DISTINCT 'user-' || user_id AS record_key, event_type AS version FROM events")
def streaming_source_dedup(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.lit("events").alias("source_id"), F.concat(F.lit("user-"), "user_id").alias("record_key"), F.col("event_type").alias("version"))
    return streaming.run_available(streaming.source_dedup(rows), _folder(spark)).select("record_key", "version")


@register("streaming_candidate_transitions", f"{_MACHINE} SELECT CAST(user_id AS VARCHAR) AS candidate, event_id AS seq, before, state, allowed FROM w")
def streaming_candidate_transitions(spark, sf_dir):
    """The candidate state machine; a refused step leaves the state, so the result isn't a window over neighbours."""
    return streaming.run_available(streaming.transitions(_stated(_stream(spark, sf_dir))), _folder(spark))
