"""Queries of the request model: access, filters, visibility, ranking, order and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators import index
from factloom.operators.lineage import checkpoint_folder
from factloom.operators.access import SparkAccess, candidates
from factloom.plans import filters as f
from factloom.plans.query import Budget, Lookup, Operator, Options, Retrieval, Traversal, execute, plan, scored, visible
from factloom.queries.registry import register
from factloom.sources import fixture

#: Relational base 860 and a path relevance of 100; evidence and authority parts as in the score.
_KEY = "'assertion:' || aid"


def _score(base: int, scholarly: bool = False, historical: bool = False, extra: int = 0) -> str:
    part = "10 * least(10, len(evidence)) + CASE WHEN auth IS NULL THEN 0 ELSE 8 END"
    return f"{base} + 100 + {2 if scholarly else 1} * ({part})" + (" + CASE WHEN tag IS NULL THEN 0 ELSE 20 END" if historical else "") + f" + {extra}"


def _item(where: str, match: str, score: str, order: str = "score DESC, stable_key", limit: int = 50, offset: int = 0, groups: tuple = ("supply",)) -> str:
    return f"""{fixture.duckdb_facts(*groups)},
    m AS (SELECT {_KEY} AS stable_key, '{match}' AS match_type, CAST({score} AS BIGINT) AS score FROM facts WHERE {where}),
    r AS (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS position, * FROM m)
    SELECT position, stable_key, match_type, score FROM r WHERE position >= {offset} AND position < {offset + limit}"""


_SHOWN = ("position", "stable_key", "match_type", "score")
_PUBLIC = "publication = 'published' AND inference NOT IN ('inferred', 'machine-generated') AND status <> 'disputed'"


def _run(spark, sf_dir, request, *groups, **access):
    found = SparkAccess(fixture.assertions(spark, sf_dir, *groups), **access)
    return execute(plan(request), found).select(*_SHOWN)


def _asked(name, request, sql, *groups):
    register(name, sql)(lambda spark, sf_dir: _run(spark, sf_dir, request, *groups))


# Access: lookup and the retrieval modes.
_asked("lookup_object", Lookup("entity", "supplier-7"), _item(f"(si = 'supplier-7' OR oi = 'supplier-7') AND {_PUBLIC}", "lookup", _score(1000), groups=("supply", "suppliers")), "supply", "suppliers")
_asked("retrieve_exact", Retrieval("exact", ("entity", "part-11")), _item(f"(si = 'part-11' OR oi = 'part-11') AND {_PUBLIC}", "exact", _score(950), groups=("supply", "types")), "supply", "types")
_asked("retrieve_conceptual", Retrieval("conceptual", ("concept", "type-PROMO")), _item(f"oi = 'type-PROMO' AND {_PUBLIC}", "conceptual", _score(880), groups=("types",)), "types")
_asked("retrieve_relational", Retrieval("relational", ("predicate", "supplied-by")), _item(f"pred = 'supplied-by' AND {_PUBLIC}", "relational", _score(860)), "supply")


@register("lookup_assertion", f"{fixture.duckdb_facts('nations')} SELECT {_KEY} AS stable_key, CAST({_score(1000)} AS BIGINT) AS score, status FROM facts WHERE aid = (SELECT min(aid) FROM facts)")
def lookup_assertion(spark, sf_dir):
    known = fixture.assertions(spark, sf_dir, "nations")
    least = known.agg(F.min("assertion_id")).first()[0]
    return execute(plan(Lookup("assertion", least)), SparkAccess(known)).select("stable_key", "score", "status")


@register(
    "retrieve_lexical",
    """WITH q AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM benchmark WHERE item_id = 3),
    d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents)
    SELECT DISTINCT 'reference:doc-' || doc_id AS stable_key, 'lexical' AS match_type, CAST(920 AS BIGINT) AS score FROM d JOIN q USING (t) WHERE t <> ''""",
)
def retrieve_lexical(spark, sf_dir):
    texts = fixture.table(spark, sf_dir, "documents").select(F.struct(F.lit("reference").alias("kind"), F.concat(F.lit("doc-"), "doc_id").alias("id")).alias("reference"), "text")
    text = fixture.table(spark, sf_dir, "benchmark").where("item_id = 3").first()["text"]
    found = SparkAccess(fixture.assertions(spark, sf_dir, "nations"), texts=texts).retrieve(Retrieval("lexical", ("text", text)))
    return scored(found, "general").select("stable_key", "match_type", "score")


@register(
    "retrieve_semantic_expanded",
    f"{fixture.duckdb_facts('types')} SELECT {_KEY} AS stable_key, CAST({_score(1000, extra=50)} AS BIGINT) AS score FROM facts WHERE oi LIKE 'type-%'",
)
def retrieve_semantic_expanded(spark, sf_dir):
    known = fixture.assertions(spark, sf_dir, "types")
    taxonomy = known.select(F.col("object.id").alias("child"), F.lit("type-any").alias("parent")).distinct()
    found = SparkAccess(known, taxonomy=taxonomy).retrieve(Retrieval.semantic(("concept", "type-any")))
    return scored(found, "semantic").select("stable_key", "score")


@register(
    "composite_union_all",
    f"""{fixture.duckdb_facts('types', 'supply')}, m AS (SELECT aid FROM facts WHERE si = 'part-5' OR oi = 'part-5' UNION ALL SELECT aid FROM facts WHERE pred = 'instance-of')
    SELECT 'assertion:' || aid AS stable_key, count(*) AS copies FROM m GROUP BY aid""",
)
def composite_union_all(spark, sf_dir):
    children = (Operator("lookup", Lookup("entity", "part-5")), Operator("retrieval", Retrieval("relational", ("predicate", "instance-of"))))
    from factloom.plans.query import collect

    found = collect(Operator("composite", children=children), SparkAccess(fixture.assertions(spark, sf_dir, "types", "supply")))
    return scored(found, "general").groupBy("stable_key").agg(F.count(F.lit(1)).alias("copies"))


@register(
    "result_projection",
    f"""{fixture.duckdb_facts('orders')}, m AS (SELECT *, {_KEY} AS stable_key, CAST({_score(1000, historical=True)} AS BIGINT) AS score FROM facts WHERE oi = 'customer-17'),
    r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, stable_key) - 1 AS INTEGER) AS position, * FROM m)
    SELECT position, stable_key, 'lookup' AS match_type, score, CAST(1000 AS BIGINT) AS match_quality, CAST(100 AS BIGINT) AS path_relevance, CAST(0 AS BIGINT) AS evidence_support,
      CAST(0 AS BIGINT) AS authority_metadata, CAST(1 AS BIGINT) AS temporal_relevance, 'none' AS path_key, 0 AS path_length, status, publication, inference,
      'score=' || score || ';reference=' || stable_key || ';match=lookup;path=none;position=' || position AS cursor FROM r""",
)
def result_projection(spark, sf_dir):
    options = Options(visibility=f.Visibility("all", None, True, True, True), ranking="historical", limit=1000)
    return execute(plan(Lookup("entity", "customer-17", options)), SparkAccess(fixture.assertions(spark, sf_dir, "orders")))


# Filters: each as a count-free list of keys.
_SEEN = f.Visibility("everything", None, True, True, True)


def _filtered(name: str, condition: f.Filter, where: str, *groups: str, visibility: f.Visibility = _SEEN) -> None:
    sql = f"{fixture.duckdb_facts(*groups)} SELECT {_KEY} AS stable_key, status, publication FROM facts WHERE {where}"

    @register(name, sql)
    def run(spark, sf_dir):
        condition.validate()
        rows = candidates(fixture.assertions(spark, sf_dir, *groups), "lookup")
        kept = visible(rows, Options(filter=condition, visibility=visibility))
        return kept.select(F.concat_ws(":", "reference.kind", "reference.id").alias("stable_key"), "status", "publication")


_DAY, _LATER = 820454400, 852076800  # 1996-01-01 and 1997-01-01
_JAN2, _JAN3 = 1704153600, 1704240000  # 2024-01-02 and 2024-01-03
_US = 1_000_000
_OVERLAP = "tag <> 'unknown' AND NOT (e_us IS NOT NULL AND (e_us < {a} OR (e_us = {a} AND (e_kind = 'exclusive')))) AND NOT (s_us IS NOT NULL AND s_us >= {b})"
_filtered("filter_all", f.All(), "true", "nations")
_filtered("filter_none", f.Nothing(), "false", "nations")
_filtered("filter_source", f.Source("suppliers"), "source_id = 'suppliers'", "suppliers", "nations")
_filtered("filter_authority", f.Authority("source-reliability", "high"), "auth = 'high'", "suppliers", "nations")


@register("filter_evidence", f"{fixture.duckdb_facts('lines', 'supply')} SELECT {_KEY} AS stable_key, pred AS predicate FROM facts WHERE list_contains(evidence, (SELECT min(list_extract(evidence, 1)) FROM facts))")
def filter_evidence(spark, sf_dir):
    """Assertions that rest on the first of all evidence ids."""
    known = fixture.assertions(spark, sf_dir, "lines", "supply")
    least = known.agg(F.min(F.get("evidence_ids", F.lit(0)))).first()[0]
    kept = visible(candidates(known, "lookup"), Options(filter=f.Evidence(least), visibility=_SEEN))
    return kept.select(F.concat_ws(":", "reference.kind", "reference.id").alias("stable_key"), "predicate")


_filtered("filter_valid_at", f.ValidAt(_JAN2), f"(tag = 'instant' AND s_us = {_JAN2 * _US}) OR (tag IN ('interval', 'open-ended') AND s_us <= {_JAN2 * _US} AND (e_us IS NULL OR {_JAN2 * _US} < e_us))", "events")
_filtered("filter_valid_at_instant", f.ValidAt(_DAY), f"s_us = {_DAY * _US}", "orders")
_filtered("filter_valid_during", f.ValidDuring(("inclusive", _JAN2), ("exclusive", _JAN3)), _OVERLAP.format(a=_JAN2 * _US, b=_JAN3 * _US), "events")
_filtered("filter_valid_during_closed", f.ValidDuring(("inclusive", _DAY), ("inclusive", _LATER)), f"e_us >= {_DAY * _US} AND s_us <= {_LATER * _US}", "lines")
_filtered("filter_validity_unknown", f.ValidityUnknown(), "tag IS NULL OR tag = 'unknown'", "events", "nations")
_filtered("filter_epistemic", f.Epistemic("known"), "status = 'known'", "orders", "nations")
_filtered("filter_publication", f.Publication("withdrawn"), "publication = 'withdrawn'", "orders")
_filtered("filter_context", f.Context("priority", "1-URGENT"), "ck = 'priority' AND cv = '1-URGENT'", "orders", "nations")
_filtered("filter_relationship", f.Relationship("located-in"), "pred = 'located-in'", "customers", "suppliers", "segments")
_filtered("filter_semantic_type", f.SemanticType("segment-BUILDING"), "sem = 'segment-BUILDING'", "customers", "segments")
_filtered("filter_entity_subject", f.Entity("subject", "entity", "nation-3"), "si = 'nation-3'", "nations", "customers")
_filtered("filter_entity_object", f.Entity("object", "entity", "nation-3"), "oi = 'nation-3'", "nations", "customers")
_filtered("filter_entity_either", f.Entity("either", "entity", "nation-3"), "si = 'nation-3' OR oi = 'nation-3'", "nations", "customers")
_filtered(
    "filter_and_or_not_null_safe",
    f.And((f.Or((f.Source("suppliers"), f.Source("customers"))), f.Not(f.Authority("source-reliability", "low")), f.Not(f.SemanticType("segment-BUILDING")))),
    "source_id IN ('suppliers', 'customers') AND coalesce(auth, '') <> 'low' AND coalesce(sem, '') <> 'segment-BUILDING'",
    "suppliers", "customers", "nations",
)

# Visibility presets over orders (disputed, withdrawn) and events (machine-generated).
_NOT_MACHINE = "publication = 'published' AND inference NOT IN ('inferred', 'machine-generated')"
_filtered("visibility_public", f.All(), _PUBLIC, "orders", "events", visibility=f.PUBLIC)
_filtered("visibility_scholarly", f.All(), _NOT_MACHINE, "orders", "events", visibility=f.SCHOLARLY)
_filtered("visibility_historical", f.All(), _NOT_MACHINE, "orders", "events", visibility=f.HISTORICAL)
_filtered("visibility_research", f.All(), "publication = 'published'", "orders", "events", visibility=f.RESEARCH)
_filtered("visibility_custom_status", f.All(), f"{_PUBLIC} AND status IN ('known')", "orders", "events", visibility=f.Visibility("known only", statuses=("known",)))

# Ranking profiles over suppliers and orders, by match type.
_BASES = {"general": (1000, 880, 860), "semantic": (1000, 930, 860), "scholarly": (1000, 930, 910), "historical": (1000, 880, 860)}


def _ranked(profile: str) -> None:
    lookup, conceptual, relational = _BASES[profile]
    parts = [
        ("suppliers", "relational", _score(relational, profile == "scholarly", profile == "historical")),
        ("orders", "lookup", _score(lookup, profile == "scholarly", profile == "historical")),
        ("types", "conceptual", _score(conceptual, profile == "scholarly", profile == "historical")),
    ]
    union = " UNION ALL ".join(f"SELECT {_KEY} AS stable_key, '{match}' AS match_type, CAST({score} AS BIGINT) AS score FROM facts WHERE grp = '{group}'" for group, match, score in parts)
    sql = f"{fixture.duckdb_facts('suppliers', 'orders', 'types')} {union}"

    @register(f"rank_{profile}", sql)
    def run(spark, sf_dir):
        out = None
        for group, match, _ in parts:
            rows = candidates(fixture.assertions(spark, sf_dir, group), match)
            out = rows if out is None else out.unionByName(rows)
        return scored(out, profile).select("stable_key", "match_type", "score")


for _profile in scoring.PROFILES:
    _ranked(_profile)

# Orders and pages over one relational retrieval.
for _ordering, _sql_order in (("relevance", "score DESC, stable_key"), ("path-length", "score DESC, stable_key"), ("reference", "stable_key, score DESC")):
    _asked(
        f"order_{_ordering.replace('-', '_')}",
        Retrieval("relational", ("predicate", "contains"), options=Options(ordering=_ordering, limit=40)),
        _item(f"{_PUBLIC}", "relational", _score(860), _sql_order, 40, groups=("lines",)),
        "lines",
    )
_asked("page_limit", Retrieval("relational", ("predicate", "supplied-by"), options=Options(limit=7)), _item(_PUBLIC, "relational", _score(860), limit=7), "supply")
_asked("page_offset", Retrieval("relational", ("predicate", "supplied-by"), options=Options(limit=20, offset=35)), _item(_PUBLIC, "relational", _score(860), limit=20, offset=35), "supply")


@register("page_cursor", _item(_PUBLIC, "relational", _score(860), limit=15, offset=10))
def page_cursor(spark, sf_dir):
    """The page after the tenth item, by that item's token."""
    access = SparkAccess(fixture.assertions(spark, sf_dir, "supply"))
    first = Retrieval("relational", ("predicate", "supplied-by"), options=Options(limit=10))
    token = execute(plan(first), access).where("position = 9").select("cursor").first()[0]
    after = Retrieval("relational", ("predicate", "supplied-by"), options=Options(limit=15, cursor=token))
    return execute(plan(after), access).select(*_SHOWN)


@register(
    "page_totals",
    f"""{fixture.duckdb_facts('orders')}, m AS (SELECT * FROM facts WHERE oi = 'customer-17' AND {_PUBLIC})
    SELECT count(*) AS total_matches, least(count(*), 3) AS returned FROM m""",
)
def page_totals(spark, sf_dir):
    from factloom.plans.query import page

    result = page(Lookup("entity", "customer-17", Options(limit=3)), SparkAccess(fixture.assertions(spark, sf_dir, "orders")))
    return spark.createDataFrame([(result.total_matches, result.returned)], "total_matches bigint, returned bigint")


@register(
    "traversal_request",
    f"""{fixture.duckdb_facts('nations', 'customers')}, one AS (SELECT aid, oi FROM facts WHERE si = 'customer-3' AND pred = 'located-in'),
    two AS (SELECT one.aid AS a, f.aid AS b, f.oi FROM one JOIN facts f ON f.si = one.oi AND f.pred = 'part-of')
    SELECT 'entity:' || oi AS stable_key, CAST(780 + 90 AS BIGINT) AS score, aid || ':forward:located-in' AS path_key, 1 AS path_length FROM one
    UNION ALL SELECT 'entity:' || oi, CAST(780 + 80 AS BIGINT), a || ':forward:located-in|' || b || ':forward:part-of', 2 FROM two""",
)
def traversal_request(spark, sf_dir):
    access = SparkAccess(fixture.assertions(spark, sf_dir, "nations", "customers"), fixture.relationships(spark))
    request = Traversal("entity", "customer-3", budget=Budget(max_depth=2), options=Options(ordering="path-length"))
    return execute(plan(request), access).where("path_length > 0").select("stable_key", "score", "path_key", "path_length")


@register(
    "traversal_max_results",
    f"""{fixture.duckdb_facts('nations', 'customers')}, one AS (SELECT aid, oi FROM facts WHERE si = 'customer-3' AND pred = 'located-in')
    SELECT 'entity:customer-3' AS stable_key, CAST(780 + 100 AS BIGINT) AS score, 0 AS path_length UNION ALL SELECT 'entity:' || oi, CAST(780 + 90 AS BIGINT), 1 FROM one""",
)
def traversal_max_results(spark, sf_dir):
    """The two best of three paths; totals count all three."""
    access = SparkAccess(fixture.assertions(spark, sf_dir, "nations", "customers"), fixture.relationships(spark))
    request = Traversal("entity", "customer-3", budget=Budget(max_depth=2, max_results=2), options=Options(visibility=_SEEN))
    return execute(plan(request), access).select("stable_key", "score", "path_length")


@register(
    "retrieve_lexical_indexed",
    """WITH q AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM benchmark WHERE item_id = 3),
    d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents)
    SELECT DISTINCT 'reference:doc-' || doc_id AS stable_key, 'lexical' AS match_type FROM d JOIN q USING (t) WHERE t <> ''""",
)
def retrieve_lexical_indexed(spark, sf_dir):
    """The same retrieval over a persisted index: the postings are sorted by term, so only the tokens' row groups are read."""
    texts = fixture.table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.concat(F.lit("doc-"), "doc_id").alias("reference"), "text")
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index.persist(index.postings(texts), index.IndexState("search", False), folder)
    kept, _ = index.load(spark, "search", folder)
    found = kept.select("term", F.struct(F.lit("reference").alias("kind"), F.element_at(F.split("ref", "\x1f"), 2).alias("id")).alias("reference"))
    text = fixture.table(spark, sf_dir, "benchmark").where("item_id = 3").first()["text"]
    access = SparkAccess(fixture.assertions(spark, sf_dir, "nations"), postings=found)
    return scored(access.retrieve(Retrieval("lexical", ("text", text))), "general").select("stable_key", "match_type")
