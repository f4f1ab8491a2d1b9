"""Queries of checks, records and reports: validity rules, adapters, runs, coverage, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import temporal, text
from factloom.operators import index, ingestion, metadata, ontology, resolution, versioning
from factloom.operators.lineage import checkpoint_folder
from factloom.queries.registry import register
from factloom.sources import fixture, json_source
from factloom.streaming import ingest as streaming

_facts = fixture.duckdb_facts
_table = fixture.table


# Text.
@register(
    "text_matches",
    """SELECT p_partkey, p_partkey % 3 = 0 AS matched FROM part""",
)
def text_matches(spark, sf_dir):
    """A name against another spelling of it, against another name, and against one with a control character."""
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("!"))).when(k == 1, F.concat("p_name", F.lit(" x"))).otherwise(F.concat("p_name", F.lit("\x02")))
    return _table(spark, sf_dir, "part").select("p_partkey", text.normalized_match(F.col("p_name"), other).alias("matched"))


@register("span_validation", "SELECT event_id, event_id % 5 < user_id % 7 AND event_id % 4 <> 3 AS valid FROM events")
def span_validation(spark, sf_dir):
    units = F.array(*[F.lit(u) for u in ("byte", "scalar", "token", "page")])
    unit = F.element_at(units, (F.col("event_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", text.valid_span(F.col("event_id") % 5, F.col("user_id") % 7, unit).alias("valid"))


@register("predicate_names", "SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def predicate_names(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.lit("made-by")).when(k == 1, text.predicate_full(F.lit("made-by"))).otherwise(F.lit(" "))
    return _table(spark, sf_dir, "part").select("p_partkey", text.valid_predicate(name).alias("valid"))


# Time.
@register("instant_validation", "SELECT event_id, value < 400 AS valid FROM events")
def instant_validation(spark, sf_dir):
    nanos = F.when(F.col("value") < 200, 999_999_999).when(F.col("value") < 400, 0).when(F.col("value") < 450, 1_000_000_000).otherwise(-1)
    return _table(spark, sf_dir, "events").select("event_id", temporal.valid_instant(temporal.instant(F.lit(5), nanos)).alias("valid"))


# Sources.
def _records(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "other").otherwise("events").alias("source_id"),
        F.when(F.col("event_id") % 7 == 0, "structured").otherwise("machine-generated").alias("source_class"),
        F.when(F.col("event_id") % 3 == 0, "2").otherwise("1").alias("version"),
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit("k"), "event_id")).alias("record_key"),
        F.when(F.col("event_id") % 13 == 0, "elsewhere").when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 5 == 0, "other").otherwise("events")).alias("external_source"),
    )


def _raw(spark, version="1"):
    rows = spark.createDataFrame([(1, "{}")], "n int, payload string").withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    return json_source.capture(rows, operation="import", source_id="events", source_class="machine-generated", artifact="events.parquet", content_type="application/json", version=version)


@register("records_adapted", "SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 <> 0")
def records_adapted(spark, sf_dir):
    """Records of the captured source, class and version."""
    return json_source.adapted(_records(spark, sf_dir), _raw(spark)).select("event_id")


@register("records_valid", "SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid FROM events")
def records_valid(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", json_source.valid_record().alias("valid"))


@register(
    "source_adapter",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'invalid-record-metadata' WHEN event_id % 5 = 0 THEN 'source-mismatch' WHEN event_id % 7 = 0 THEN 'source-class-mismatch'
    WHEN event_id % 3 = 0 THEN 'source-version-mismatch' END AS code FROM events""",
)
def source_adapter(spark, sf_dir):
    """The checks around an adapter whose records are partly of another source, class or version, or not valid."""

    class Adapter:
        source_id, source_class = "events", "machine-generated"

        def decode_payload(self, raw):
            return _records(spark, sf_dir)

    return json_source.decoded_by(Adapter(), _raw(spark))[1].select("event_id", "code")


@register(
    "source_adapter_payloads",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid-raw-material' WHEN event_id % 5 = 0 THEN 'source-mismatch' WHEN event_id % 7 = 0 THEN 'source-class-mismatch' END AS code,
    CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 'key-' || event_id END AS record_key FROM events""",
)
def source_adapter_payloads(spark, sf_dir):
    """Payloads judged before decoding, with the records of those that pass."""
    rows = _records(spark, sf_dir).select("event_id", "source_id", "source_class", F.to_json(F.struct(F.concat(F.lit("key-"), "event_id").alias("k"))).alias("payload"))
    rows = rows.withColumns({"captured_at": F.lit("2024-01-01").cast("timestamp"), "version": F.lit("1"), "operation": F.lit("import"), "content_type": F.lit("application/json")})
    rows = rows.withColumn("artifact", F.when(F.col("event_id") % 11 == 0, "").otherwise("a"))
    payloads, records = json_source.decoded_by(json_source.JsonAdapter("events", "machine-generated", "k"), rows)
    return payloads.select("event_id", "code").join(records.where("code IS NULL").select("event_id", "record_key"), "event_id", "left")


# Ingestion.
@register(
    "run_candidates",
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'events' END AS source_id, event_id % 7 = 0 AS strange, event_id % 3 = 0 AS old, event_id // 2 AS k, value > 250 AS known FROM events)
    SELECT k, strange OR old OR source_id = 'other' AS refused, count(*) AS candidates, count(*) FILTER (WHERE strange OR old OR source_id = 'other') AS mismatches FROM c GROUP BY k, strange OR old OR source_id = 'other'""",
)
def run_candidates(spark, sf_dir):
    """Candidates judged against their run: other sources, classes and versions are refused, and so is the second of a key."""
    run = ingestion.Run("import-1", "events", "machine-generated", "1")
    run.begin()
    rows = _records(spark, sf_dir).withColumns({"k": F.floor(F.col("event_id") / 2), "ordinal": F.lit(0)}).withColumn("record_key", F.col("k").cast("string"))
    judged = run.judged(rows)
    bad = F.coalesce(F.col("code") == "candidate-run-mismatch", F.lit(False))
    return judged.groupBy("k", bad.alias("refused")).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(bad, 1)).alias("mismatches"))


@register("structural_findings", "SELECT event_id, 'invalid-record-key' AS code FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'invalid-ordinal' FROM events WHERE event_id % 4 = 0 AND event_id > 0")
def structural_findings(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("ordinal", F.when(F.col("event_id") % 4 == 0, -F.col("event_id")).otherwise(F.col("event_id")).cast("int"))
    return ingestion.structural_findings(rows).select(F.abs("ordinal").cast("long").alias("event_id"), "code")


@register("subgraph_objects", "SELECT 'batch-' || (l_orderkey % 50) AS candidate, count(*) AS objects FROM lineitem GROUP BY l_orderkey % 50")
def subgraph_objects(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("batch-"), F.col("l_orderkey") % 50).alias("candidate"))
    return ingestion.object_counts(rows)


@register("subgraph_empty", "SELECT 'nation-' || n_nationkey AS candidate, 'empty-subgraph' AS code FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey <= 20)")
def subgraph_empty(spark, sf_dir):
    """Nations as candidates with their first customers as records: those without one have an empty subgraph."""
    none = F.lit(None).cast("struct<kind:string,id:string>")
    records = _table(spark, sf_dir, "customer").where("c_custkey <= 20").select(
        F.concat(F.lit("nation-"), "c_nationkey").alias("candidate"), F.lit("entity").alias("kind"), F.concat(F.lit("customer-"), "c_custkey").alias("id"), F.lit(True).alias("valid"),
        none.alias("subject"), none.alias("object"), F.expr("cast(array() as array<string>)").alias("assertion_ids"),
    )
    supports = spark.createDataFrame([], "candidate string, assertion_id string, evidence_id string")
    crosswalk = spark.createDataFrame([], "candidate string, source_id string, value string, entity_id string, declared boolean")
    candidates = _table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("candidate"))
    found = ingestion.subgraph_findings(records, supports, crosswalk, spark.createDataFrame([], "kind string, id string"), candidates)
    return found.select("candidate", "code")


@register(
    "sync_status",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'synchronized' WHEN event_id % 5 < 3 THEN 'retryable' ELSE 'terminal' END AS status, event_type <> 'error' AS ready FROM events""",
)
def sync_status(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") != "view", "failed")
    ready = F.when(F.col("event_type") == "error", F.lit(None)).otherwise("ready")
    return _table(spark, sf_dir, "events").select("event_id", ingestion.sync_status(outcome, F.col("event_id") % 5).alias("status"), ingestion.readiness_gate(ready).alias("ready"))


# Indexes.
@register("index_coverage", "SELECT 'update' AS side, 'part-' || p_partkey AS reference FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'change', 'part-' || p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 0")
def index_coverage(spark, sf_dir):
    """Updates and changes that don't meet: parts divisible by 5 weren't changed, those divisible by 7 weren't updated."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.lit("entity").alias("target_kind"), F.concat(F.lit("part-"), "p_partkey").alias("reference"))
    extra, missing = index.coverage(rows.where("p_partkey % 7 <> 0 OR p_partkey % 5 = 0"), rows.where("p_partkey % 5 <> 0"))
    return extra.select(F.lit("update").alias("side"), "reference").unionByName(missing.select(F.lit("change").alias("side"), "reference"))


_TOKENS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@register(
    "index_provider",
    f"""WITH q AS (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark), d AS (SELECT DISTINCT 'doc-' || doc_id AS doc, term FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) x)
    SELECT item_id, doc, count(*) AS score FROM q JOIN d USING (term) WHERE term <> '' GROUP BY item_id, doc""",
)
def index_provider(spark, sf_dir):
    """A search provider over postings, as an external one would be asked."""
    texts = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.concat(F.lit("doc-"), "doc_id").alias("reference"), "text")
    provider: index.SearchProvider = index.PostingsProvider(index.postings(texts))
    found = provider.search(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.select(F.col("query_id").alias("item_id"), F.element_at(F.split("ref", "\x1f"), 2).alias("doc"), "score")


# Resolution.
@register("resolve_explicit", "SELECT p_name AS input_id, CASE WHEN p_name < 'm' THEN 'rejected' ELSE 'provisional' END AS decision, CAST(NULL AS VARCHAR) AS entity_id FROM (SELECT DISTINCT p_name FROM part) x")
def resolve_explicit(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("input_id")).distinct()
    return resolution.explicit(names.where("input_id < 'm'"), "rejected").unionByName(resolution.explicit(names.where("input_id >= 'm'"), "provisional"))


# Metadata and vocabulary.
@register("activity_validation", "SELECT event_id, event_id % 3 <> 1 AND event_type <> 'view' AS valid FROM events")
def activity_validation(spark, sf_dir):
    k = F.col("event_id") % 3
    ended = F.when(k == 0, F.col("ts_us") + 5).when(k == 1, F.col("ts_us") - 5)
    described = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", metadata.activity_valid(F.col("ts_us"), ended, described).alias("valid"))


@register(
    "confidence_assessment",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'qualitative' ELSE 'numeric' END AS form, CASE WHEN event_id % 3 = 0 THEN value / 400 END AS score,
    CASE WHEN event_id % 3 = 1 THEN event_type END AS label, CASE WHEN event_id % 2 = 0 THEN 'e1,e2' ELSE '' END AS evidence FROM events
    WHERE (event_id % 3 <> 0 OR value <= 400) AND (event_id % 2 = 0 OR event_id % 5 <> 0)""",
)
def confidence_assessment(spark, sf_dir):
    """Assessments with a basis and a value in range; the others have no record."""
    k = F.col("event_id") % 3
    form = F.when(k == 0, "numeric").when(k == 1, "qualitative").otherwise("unknown")
    evidence = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("e2"), F.lit("e1"), F.lit("e2")))
    because = F.when(F.col("event_id") % 5 != 0, "checked")
    record = metadata.confidence_assessment(form, F.col("value") / 400, F.col("event_type"), evidence, F.lit(None).cast("array<string>"), because)
    rows = _table(spark, sf_dir, "events").select("event_id", record.alias("x")).where("x IS NOT NULL")
    return rows.select("event_id", "x.form", "x.score", "x.label", F.array_join("x.basis.evidence_ids", ",").alias("evidence"))


@register("relationship_codes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'self-inverse' WHEN 2 THEN 'conflicting-characteristics' WHEN 3 THEN 'invalid-predicate' END AS code FROM part")
def relationship_codes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 3, " ").otherwise(F.col("p_name"))
    inverse = F.when(k == 1, F.col("p_name"))
    traits = F.when(k == 2, F.array(F.lit("symmetric"), F.lit("asymmetric"))).otherwise(F.array(F.lit("symmetric")))
    return _table(spark, sf_dir, "part").select("p_partkey", metadata.relationship_code(name, inverse, traits).alias("code"))


@register("relationships_registered", "SELECT * FROM (VALUES ('part-of'), ('located-in'), ('placed-by'), ('contains'), ('supplied-by'), ('performed'), ('instance-of'), ('has-quality'), ('same-name-as'), ('made-by')) t(predicate)")
def relationships_registered(spark, sf_dir):
    known = fixture.relationships(spark)
    new = spark.createDataFrame([("made-by", "semantic", False, None, False, "")], known.schema)
    return metadata.register_relationships(known, new).select("predicate")


@register("relationship_compositions", "SELECT * FROM (VALUES ('located-in', 'part-of', 'located-in', true), ('located-in', 'owned-by', 'owned-by', false)) t(first, second, result, registered)")
def relationship_compositions(spark, sf_dir):
    rules = spark.createDataFrame([("located-in", "part-of", "located-in"), ("located-in", "owned-by", "owned-by")], "first string, second string, result string")
    return metadata.compositions(rules, fixture.relationships(spark))


# Ontology.
@register("property_validation", "SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def property_validation(spark, sf_dir):
    k, nothing = F.col("p_partkey") % 3, F.expr("cast(array() as array<string>)")
    domain = F.when(k == 1, nothing).otherwise(F.array("p_type"))
    range_ = F.when(k == 2, F.lit(None)).otherwise(F.array("p_brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", ontology.valid_property(domain, range_).alias("valid"))


@register("context_rule", "SELECT event_id, event_id % 3 <> 1 AS valid FROM events")
def context_rule(spark, sf_dir):
    """A dimension with two values is not valid; an extension may have as many as it likes."""
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    k = F.col("event_id") % 3
    context = F.when(k == 0, F.array(pair("language", F.lit("en")), pair("domain", F.col("event_type"))))
    context = context.when(k == 1, F.array(pair("language", F.lit("en")), pair("language", F.lit("de"))))
    context = context.otherwise(F.array(pair("note", F.lit("a")), pair("note", F.lit("b"))))
    return _table(spark, sf_dir, "events").select("event_id", ontology.valid_context(context).alias("valid"))


@register("lexical_mappings", "SELECT 'form-' || p_name AS lexical_form, 'type-' || p_type AS concept, p_partkey % 2 = 0 AS mediated FROM part WHERE p_partkey % 5 <> 0")
def lexical_mappings(spark, sf_dir):
    ref = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    sense = F.array(F.struct(F.lit("sense").alias("k"), F.lit("s1").alias("v")))
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("assertion_id"),
        F.when(F.col("p_partkey") % 5 == 0, ref("entity", F.col("p_name"))).otherwise(ref("lexical-form", F.concat(F.lit("form-"), "p_name"))).alias("subject"),
        ref("concept", F.concat(F.lit("type-"), "p_type")).alias("object"),
        F.when(F.col("p_partkey") % 2 == 0, sense).otherwise(F.expr("cast(array() as array<struct<k:string,v:string>>)")).alias("qualifiers"),
    )
    return ontology.lexical_mappings(rows).select("lexical_form", "concept", "mediated")


# Versions and recovery.
_DAYS = "d AS (SELECT 'user-' || user_id AS id, event_type, event_id, epoch_us(ts) // 86400000000 AS day FROM events)"


@register("journal_replayed", f"WITH {_DAYS} SELECT id AS target, max_by(event_type, event_id) AS content, max(day) AS version FROM d WHERE day > (SELECT min(day) + 3 FROM d) GROUP BY id")
def journal_replayed(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("target"), F.col("event_type").alias("content"), F.expr("ts_us div 86400000000").alias("version"), F.col("event_id").alias("seq"))
    return versioning.replayed(rows, rows.agg(F.min("version")).first()[0] + 3)


@register("chain_breaks", "SELECT event_id AS version, event_id - 2 AS base FROM events WHERE event_id % 4 = 3 AND event_id > (SELECT min(event_id) + 1 FROM events)")
def chain_breaks(spark, sf_dir):
    """Every commit follows the one before; those after a lost one (every fourth) have a base that isn't there."""
    rows = _table(spark, sf_dir, "events").where("event_id % 4 <> 1").select(F.col("event_id").alias("version"), F.when(F.col("event_id") % 4 == 3, F.col("event_id") - 2).when(F.col("event_id") % 4 == 2, F.col("event_id") - 2).otherwise(F.col("event_id") - 1).alias("base"))
    return versioning.chain_breaks(rows)


@register(
    "recovery_commit_codes",
    """SELECT event_id AS version, CASE event_id % 6 WHEN 1 THEN 'empty-change-set' WHEN 2 THEN 'change-set-base-mismatch' WHEN 3 THEN 'parent-mismatch' WHEN 4 THEN 'change-set-mismatch' WHEN 5 THEN 'record-not-in-change-set' END AS code FROM events""",
)
def recovery_commit_codes(spark, sf_dir):
    k, own = F.col("event_id") % 6, F.concat(F.lit("set-"), "event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    commits = rows.select(
        F.col("event_id").alias("version"), (F.col("event_id") - 1).alias("base"), (F.col("event_id") - F.when(F.col("k") == 3, 2).otherwise(1)).alias("parent"), own.alias("change_set"),
        (F.col("event_id") - F.when(F.col("k") == 2, 3).otherwise(1)).alias("change_set_base"), F.when(F.col("k") == 4, "set-0").otherwise(own).alias("named_change_set"),
    )
    changes = rows.where("k <> 1").select(own.alias("change_set"), F.lit("entity").alias("kind"), F.concat(F.lit("x"), "event_id").alias("id"))
    records = rows.where("k <> 1").select(F.col("event_id").alias("version"), F.lit("entity").alias("kind"), F.concat(F.when(F.col("k") == 5, "y").otherwise("x"), "event_id").alias("id"))
    return versioning.commit_codes(commits, changes, records)


# Streaming.
@register("streaming_windowed_counts", "SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windowed_counts(spark, sf_dir):
    """Events by hour and type in event-time windows; in one run over everything nothing is late, and complete mode shows all."""
    stream = streaming.read(spark, sf_dir, "events.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    timed = stream.select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    counts = streaming.windowed_counts(timed, "at", "1 hour", "1 day", "event_type")
    found = streaming.run_complete(counts, checkpoint_folder(spark))
    return found.select(F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "event_type", "n")
