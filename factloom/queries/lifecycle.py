"""Queries of what happens to candidates, publications, indexes and stored tables over time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import temporal
from factloom.operators import index, ingestion, ontology, resolution, versioning
from factloom.operators.lineage import checkpoint_folder
from factloom.queries.registry import register
from factloom.sources import fixture, store

_table = fixture.table


# Time.
@register(
    "interval_order",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_id % 2 = 0 ELSE false END AS ordered,
    CASE event_id % 4 WHEN 0 THEN 'after' WHEN 1 THEN 'before' END AS direction FROM events""",
)
def interval_order(spark, sf_dir):
    """Intervals that end after, at or before their start, and the direction of those that are open on one side."""
    k, instant = F.col("event_id") % 3, lambda us: temporal.instant_of_micros(us)
    start, end = instant(F.col("ts_us")), instant(F.col("ts_us") + 1 - k)
    kind = F.when(F.col("event_id") % 2 == 0, "inclusive").otherwise("exclusive")
    ordered = temporal.valid_interval(temporal.validity("interval", kind, start, F.lit("inclusive"), end))
    side = F.col("event_id") % 4
    left, right = F.when(side == 1, "open").when(side == 2, "unknown").otherwise("exclusive"), F.when(side == 0, "open").otherwise("inclusive")
    direction = temporal.open_direction(temporal.validity("open-ended", left, start, right, end))
    return _table(spark, sf_dir, "events").select("event_id", ordered.alias("ordered"), direction.alias("direction"))


# Ingestion.
_FOLLOWS = """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    m AS (SELECT user_id, event_id, i, CASE WHEN event_id % 17 = 0 THEN 0 ELSE least(12, (i + 2) // 3 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) END AS number,
      event_id % 11 AS attempt, event_id % 7 - 1 AS took, event_id % 4 <> 0 AS done, event_id % 997 = 0 AS terminal FROM l),
    j AS MATERIALIZED (SELECT *, CASE WHEN attempt < 1 THEN 'invalid-attempt' WHEN took < 0 THEN 'invalid-time-range' WHEN number = 0 THEN 'unknown-stage'
      WHEN coalesce(max(terminal::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'after-terminal-state' END AS own FROM m),
    w AS (SELECT user_id, event_id, i, CASE WHEN own IS NOT NULL THEN own WHEN number <> 1 THEN 'stage-out-of-order' END AS code,
        CASE WHEN own IS NULL AND number = 1 AND done THEN 1 ELSE 0 END AS reached FROM j WHERE i = 1
      UNION ALL SELECT j.user_id, j.event_id, j.i, CASE WHEN own IS NOT NULL THEN own WHEN number <> reached + 1 THEN 'stage-out-of-order' END,
        CASE WHEN own IS NULL AND number = reached + 1 AND done THEN reached + 1 ELSE reached END FROM w JOIN j ON j.user_id = w.user_id AND j.i = w.i + 1)"""


@register("stage_log", f"{_FOLLOWS} SELECT event_id, code FROM w")
def stage_log(spark, sf_dir):
    """Each user's events as stage executions: three a stage, with jumps, failures, unknown stages and terminal states."""
    rows = _table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    number = F.least(F.lit(12), F.floor((F.col("i") + 2) / 3).cast("int") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    names = F.array(*[F.lit(s) for s in ingestion.STAGES])
    log = rows.select(
        "event_id", F.lit("r").alias("run_id"), F.col("user_id").alias("candidate"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 17 == 0, "other").otherwise(F.element_at(names, number)).alias("stage"), (F.col("event_id") % 11).alias("attempt"),
        F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "skipped").otherwise("succeeded").alias("outcome"),
        F.lit(0).alias("started"), (F.col("event_id") % 7 - 1).alias("ended"), (F.col("event_id") % 997 == 0).alias("terminal"),
    )
    return ingestion.check_log(log).select("event_id", "code")


def _publications(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "published").otherwise("blocked")
    return rows.select("o_orderkey", F.lit("orders").alias("source_id"), F.col("o_orderkey").cast("string").alias("record_key"), F.lit("1").alias("version"), F.lit(0).alias("ordinal"), F.concat(F.lit("order-"), "o_orderkey").alias("candidate"), outcome.alias("outcome"))


@register("publications_withdrawn", "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, 'withdrawn' AS outcome, 'obsolete' AS reason FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def publications_withdrawn(spark, sf_dir):
    published = _publications(spark, sf_dir)
    return ingestion.withdraw(published, published.where("o_orderkey % 3 = 0"), "editor", "obsolete").select("record_key", "outcome", "reason")


@register(
    "publication_corrections",
    """SELECT 'order-' || o_orderkey AS candidate, 'order-' || (o_orderkey + o_orderkey % 2) AS successor,
    CASE WHEN o_orderstatus <> 'F' THEN 'prior-not-published' WHEN o_orderkey % 2 = 0 THEN 'successor-must-differ' END AS code FROM orders""",
)
def publication_corrections(spark, sf_dir):
    published = _publications(spark, sf_dir)
    pairs = published.select("candidate", F.concat(F.lit("order-"), F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("successor"))
    return ingestion.corrections(published, pairs)


@register("pipeline_stages", "SELECT p_partkey, lower(trim(p_name)) || '!' AS name FROM part WHERE p_partkey % 4 <> 0")
def pipeline_stages(spark, sf_dir):
    """Two stages and a hook, declared in another order than the plan's."""
    run = ingestion.Pipeline()
    run.hook("source-deduplication", "mark", lambda df: df.withColumn("name", F.concat("name", F.lit("!"))))
    run.stage("source-deduplication", lambda df: df.where("p_partkey % 4 <> 0"))
    run.stage("normalization", lambda df: df.withColumn("name", F.lower(F.trim("name"))))
    return run.run(_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("name")))


# Resolution and ontology.
@register("circular_evidence", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 7 = l_suppkey % 7 AS circular FROM lineitem")
def circular_evidence(spark, sf_dir):
    """Evidence that rests on an assertion which is being resolved."""
    active, rests = F.array(F.col("l_suppkey") % 7, F.lit(-1)), F.array(F.lit(-2), F.col("l_partkey") % 7)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", resolution.circular(active, rests).alias("circular"))


@register("constraint_structure", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size BETWEEN 5 AND 30 WHEN 1 THEN p_partkey % 2 = 0 ELSE p_partkey % 5 <> 0 END AS valid FROM part")
def constraint_structure(spark, sf_dir):
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "cardinality").when(k == 1, "disjoint-with").otherwise("extension")
    other = F.when(k == 1, F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("a")).otherwise(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("x"))
    valid = ontology.valid_constraint(kind, F.col("p_size") - 5, F.lit(25) + F.when(F.col("p_size") > 30, -26).otherwise(0), F.lit("a"), other)
    return _table(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"))


@register("taxonomy_edge_added", "SELECT 'nation-' || n_nationkey AS child, 'region-' || n_regionkey AS parent FROM nation UNION ALL SELECT 'region-0', 'region-1'")
def taxonomy_edge_added(spark, sf_dir):
    """A new edge between known classes, and one that is there already."""
    edges = _table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("child"), F.concat(F.lit("region-"), "n_regionkey").alias("parent"))
    classes = edges.select(F.col("child").alias("key")).unionByName(edges.select(F.col("parent").alias("key"))).distinct()
    edges, _ = ontology.add_edge(classes, edges, "region-0", "region-1")
    return ontology.add_edge(classes, edges, "region-0", "region-1")[0]


# Indexes, store and migrations.
@register(
    "search_index_synced",
    """WITH t AS (SELECT 'doc-' || doc_id AS doc, unnest(regexp_split_to_array(lower(CASE WHEN doc_id % 5 = 1 THEN 'fresh words' ELSE text END), '[^\\p{L}\\p{N}]+')) AS term FROM documents WHERE doc_id % 5 <> 0)
    SELECT doc, count(DISTINCT term) AS terms, bool_or(term = 'fresh') AS fresh FROM t WHERE term <> '' GROUP BY doc""",
)
def search_index_synced(spark, sf_dir):
    """Postings after a commit that removes some documents and gives others a new text."""
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("source"), F.concat(F.lit("doc-"), "doc_id").alias("reference"), "text")
    changed = texts.where("doc_id % 5 < 2").withColumns({"removed": F.col("doc_id") % 5 == 0, "text": F.lit("fresh words")})
    synced = index.search_sync(index.postings(texts), changed.select("source", "reference", "removed"), changed.select("source", "reference", "text"))
    rows = synced.select(F.element_at(F.split("ref", "\x1f"), 2).alias("doc"), "term")
    return rows.groupBy("doc").agg(F.count_distinct("term").alias("terms"), F.bool_or(F.col("term") == "fresh").alias("fresh"))


@register("store_point_read", "SELECT 'nation-3' AS id, 'second' AS content, CAST(2 AS BIGINT) AS version UNION ALL SELECT 'nation-4', n_name, 1 FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'nation-3', n_name, 1 FROM nation WHERE n_nationkey = 3")
def store_point_read(spark, sf_dir):
    """A changed record, an unchanged one, and the changed one as of the version before; the change is a transaction's."""
    kept = store.VersionedStore(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = _table(spark, sf_dir, "nation").select(F.lit("entity").alias("kind"), F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.col("n_name").alias("content"), F.lit("created").alias("change"), F.lit(0).cast("bigint").alias("seq"))
    first = kept.commit(rows, 0)
    change = store.Transaction.begin(kept)
    change.stage("entity", "nation-3", "second")
    change.commit()
    found = kept.read("entity", "nation-3").unionByName(kept.read("entity", "nation-4")).unionByName(kept.read("entity", "nation-3", first))
    return found.select("id", "content", "version")


@register("migration_applied", "SELECT c_custkey, c_mktsegment AS segment, c_acctbal < 0 AS overdrawn FROM customer")
def migration_applied(spark, sf_dir):
    """Two steps given out of order, each verified before the next one."""
    rename = versioning.Migration(1, 2, lambda df: df.withColumnRenamed("c_mktsegment", "segment"), lambda df: "segment" in df.columns)
    derive = versioning.Migration(2, 3, lambda df: df.select("c_custkey", "segment", (F.col("c_acctbal") < 0).alias("overdrawn")), lambda df: df.where("overdrawn IS NULL").isEmpty())
    return versioning.migrate(_table(spark, sf_dir, "customer"), versioning.plan([derive, rename], 1, 3), lambda _: None)
