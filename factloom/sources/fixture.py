"""A fixed projection of the driver's tables into the knowledge model.

The projection is one SQL text for each group of assertions, in a form that Spark and DuckDB both run: ``Dialect``
holds the few spellings that differ. Spark turns the flat rows into assertions; the equivalents read them directly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.functions.text import assertion_id
from factloom.schema import ASSERTION

FLAT = ["grp", "sk", "si", "pred", "ok", "oi", "ck", "cv", "status", "polarity", "tag", "s_kind", "s_us", "e_kind", "e_us", "publication", "inference", "source_id", "auth", "sem", "evidence"]


@dataclass(frozen=True)
class Dialect:
    """``table`` names a source table, ``us`` a timestamp's microseconds, ``distinct`` a sorted distinct list."""

    name: str

    def table(self, name: str) -> str:
        return f"{{{name}}}" if self.name == "spark" else name

    def us(self, column: str) -> str:
        return f"{column}_us" if self.name == "spark" else f"epoch_us({column})"

    def distinct(self, value: str) -> str:
        return f"sort_array(collect_set({value}))" if self.name == "spark" else f"list_sort(list(DISTINCT {value}))"

    def none(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)" if self.name == "spark" else "CAST([] AS VARCHAR[])"


def _row(d: Dialect, grp: str, sk: str, si: str, pred: str, ok: str, oi: str, **more: str) -> str:
    text, number = "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)"
    values = {
        "grp": f"'{grp}'", "sk": f"'{sk}'", "si": si, "pred": f"'{pred}'", "ok": f"'{ok}'", "oi": oi, "ck": text, "cv": text, "status": "'accepted'",
        "polarity": "'positive'", "tag": text, "s_kind": text, "s_us": number, "e_kind": text, "e_us": number, "publication": "'published'", "inference": "'observed'",
        "source_id": f"'{grp}'", "auth": text, "sem": text, "evidence": d.none(),
    } | more
    return ", ".join(f"{values[c]} AS {c}" for c in FLAT)


def flat_sql(d: Dialect, group: str) -> str:
    """The flat rows of one group of assertions."""
    t, us = d.table, d.us
    line = "'line-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
    if group == "nations":
        return f"SELECT {_row(d, group, 'entity', "'nation-' || n_nationkey", 'part-of', 'entity', "'region-' || n_regionkey", status="'known'")} FROM {t('nation')}"
    if group == "customers":
        return f"SELECT {_row(d, group, 'entity', "'customer-' || c_custkey", 'located-in', 'entity', "'nation-' || c_nationkey", sem="'segment-' || c_mktsegment")} FROM {t('customer')}"
    if group == "segments":
        return f"SELECT {_row(d, group, 'entity', "'customer-' || c_custkey", 'instance-of', 'concept', "'segment-' || c_mktsegment", sem="'segment-' || c_mktsegment")} FROM {t('customer')}"
    if group == "suppliers":
        return f"SELECT {_row(d, group, 'entity', "'supplier-' || s_suppkey", 'located-in', 'entity', "'nation-' || s_nationkey", auth="CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END")} FROM {t('supplier')}"
    if group == "orders":
        more = {
            "ck": "'priority'", "cv": "o_orderpriority", "status": "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'known' ELSE 'disputed' END", "tag": "'instant'",
            "s_kind": "'inclusive'", "s_us": us("o_orderdate"), "e_kind": "'inclusive'", "e_us": us("o_orderdate"), "publication": "CASE WHEN o_orderpriority = '5-LOW' THEN 'withdrawn' ELSE 'published' END",
        }
        return f"SELECT {_row(d, group, 'entity', "'order-' || o_orderkey", 'placed-by', 'entity', "'customer-' || o_custkey", **more)} FROM {t('orders')}"
    if group == "lines":
        more = {"tag": "'interval'", "s_kind": "'inclusive'", "s_us": f"min({us('l_shipdate')})", "e_kind": "'inclusive'", "e_us": f"max({us('l_shipdate')})", "evidence": d.distinct(line)}
        return f"SELECT {_row(d, group, 'entity', "'order-' || l_orderkey", 'contains', 'entity', "'part-' || l_partkey", **more)} FROM {t('lineitem')} GROUP BY l_orderkey, l_partkey"
    if group == "supply":
        polarity = "CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END"
        more = {"polarity": "pol", "evidence": d.distinct("line")}
        inner = f"SELECT l_partkey, l_suppkey, {polarity} AS pol, {line} AS line FROM {t('lineitem')}"
        return f"SELECT {_row(d, group, 'entity', "'part-' || l_partkey", 'supplied-by', 'entity', "'supplier-' || l_suppkey", **more)} FROM ({inner}) x GROUP BY l_partkey, l_suppkey, pol"
    if group == "types":
        return f"SELECT {_row(d, group, 'entity', "'part-' || p_partkey", 'instance-of', 'concept', "'type-' || p_type", sem="'type-' || p_type")} FROM {t('part')}"
    if group == "events":
        following = f"lead({us('ts')}) OVER (PARTITION BY user_id ORDER BY {us('ts')}, event_id)"
        inner = f"SELECT event_id, user_id, event_type, value, {us('ts')} AS begin_us, {following} AS next_us FROM {t('events')}"
        more = {
            "ck": "'event'", "cv": "CAST(event_id AS STRING)", "status": "'known'", "tag": "CASE WHEN value < 1 THEN 'unknown' WHEN next_us IS NULL THEN 'open-ended' ELSE 'interval' END",
            "s_kind": "CASE WHEN value < 1 THEN 'unknown' ELSE 'inclusive' END", "s_us": "CASE WHEN value < 1 THEN NULL ELSE begin_us END",
            "e_kind": "CASE WHEN value < 1 THEN 'unknown' WHEN next_us IS NULL THEN 'open' ELSE 'exclusive' END", "e_us": "CASE WHEN value < 1 THEN NULL ELSE next_us END",
            "inference": "CASE WHEN event_type = 'error' THEN 'machine-generated' ELSE 'observed' END",
        }
        return f"SELECT {_row(d, group, 'entity', "'user-' || user_id", 'performed', 'concept', "'event-' || event_type", **more)} FROM ({inner}) x"
    if group == "labels":
        return f"SELECT {_row(d, group, 'reference', "'doc-' || doc_id", 'has-quality', 'concept', "'quality-' || quality", status="CASE WHEN toxic = 1 THEN 'disputed' ELSE 'accepted' END")} FROM {t('labels')}"
    if group == "worlds":
        return f"SELECT {_row(d, group, 'entity', "'region-' || r_regionkey", 'part-of', 'entity', "'world'", status="'known'")} FROM {t('region')}"
    if group == "taxonomy":
        return f"SELECT {_row(d, group, 'concept', "'type-' || p_type", 'subclass-of', 'concept', "'type-any'", status="'known'")} FROM (SELECT DISTINCT p_type FROM {t('part')}) x"
    if group == "traits":
        return f"SELECT {_row(d, group, 'concept', "'type-' || p_type", 'has-trait', 'concept', "'trait-' || (length(p_type) % 3)", ck="'size'", cv="p_type")} FROM (SELECT DISTINCT p_type FROM {t('part')}) x"
    if group == "names":
        inner = f"SELECT p_partkey, p_name, lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS following FROM {t('part')}"
        return f"SELECT {_row(d, group, 'entity', "'part-' || p_partkey", 'same-name-as', 'entity', "'part-' || following", ck="'name'", cv="p_name")} FROM ({inner}) x WHERE following IS NOT NULL"
    raise KeyError(group)


GROUPS = ("nations", "customers", "segments", "suppliers", "orders", "lines", "supply", "types", "events", "labels", "worlds", "taxonomy", "traits", "names")
_TIMES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}
_NEEDS = {"nations": "nation", "customers": "customer", "segments": "customer", "suppliers": "supplier", "orders": "orders", "lines": "lineitem", "supply": "lineitem", "types": "part", "events": "events", "labels": "labels", "worlds": "region", "taxonomy": "part", "traits": "part", "names": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, each timestamp with its microseconds beside it, whatever the session's time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column in _TIMES.get(name, []):
        kind = dict(df.dtypes)[column]
        us = F.unix_micros(column) if kind == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
        df = df.withColumn(f"{column}_us", us)
    return df


def flat(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    out = None
    for group in groups:
        source = _NEEDS[group]
        part = spark.sql(flat_sql(Dialect("spark"), group), **{source: table(spark, sf_dir, source)})
        out = part if out is None else out.unionByName(part)
    return out


def assertions(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    """The assertion table of the named groups."""
    rows = flat(spark, sf_dir, *groups)
    ref = lambda k, i: F.struct(F.col(k).alias("kind"), F.col(i).alias("id"))
    pair = F.array(F.struct(F.col("ck").alias("k"), F.col("cv").alias("v")))
    nothing = F.expr("cast(array() as array<struct<k:string,v:string>>)")
    context = F.when(F.col("ck").isNotNull(), pair).otherwise(nothing)
    valid = F.when(
        F.col("tag").isNotNull(),
        temporal.validity(F.col("tag"), F.col("s_kind"), temporal.instant_of_micros(F.col("s_us")), F.col("e_kind"), temporal.instant_of_micros(F.col("e_us"))),
    )
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.expr("cast(array() as array<string>)"))
    dimension = F.array(F.struct(F.lit("source-reliability").alias("dimension"), F.col("auth").alias("value")))
    fields = {
        "assertion_id": assertion_id(ref("sk", "si"), F.col("pred"), ref("ok", "oi"), context, nothing, F.col("polarity")),
        "subject": ref("sk", "si"),
        "predicate": F.col("pred"),
        "object": ref("ok", "oi"),
        "context": context,
        "qualifiers": nothing,
        "status": F.col("status"),
        "polarity": F.col("polarity"),
        "validity": valid,
        "authority": F.when(F.col("auth").isNotNull(), dimension).otherwise(F.expr("cast(array() as array<struct<dimension:string,value:string>>)")),
        "source_ids": one("source_id"),
        "evidence_ids": F.col("evidence"),
        "semantic_types": one("sem"),
        "publication": F.col("publication"),
        "authenticity": F.lit("authentic"),
        "inference": F.col("inference"),
    }
    return rows.select(*[fields[name].cast(kind).alias(name) for name, kind in ASSERTION.items()])


# The relationship dimension of the projection.
RELATIONSHIPS = [
    ("part-of", "part-whole", False, "has-part", False, "transitive"),
    ("located-in", "hierarchical", False, "location-of", False, "transitive"),
    ("placed-by", "semantic", False, "placed", False, ""),
    ("contains", "part-whole", False, "contained-in", False, ""),
    ("supplied-by", "semantic", True, "supplies", False, "functional"),
    ("performed", "semantic", False, None, False, ""),
    ("instance-of", "conceptual", False, "has-instance", False, ""),
    ("has-quality", "knowledge", False, None, False, ""),
    ("same-name-as", "identity", False, None, True, "symmetric"),
]


def relationships(spark: SparkSession) -> DataFrame:
    """(predicate, family, reversed, inverse, symmetric, characteristics)."""
    return spark.createDataFrame(RELATIONSHIPS, "predicate string, family string, reversed boolean, inverse string, symmetric boolean, characteristics string")


def _component(name: str, value: str) -> str:
    return f"'{name}:' || strlen({value}) || ':' || {value} || '|'"


def duckdb_facts(*groups: str) -> str:
    """``WITH facts AS (...)``: the flat rows of the groups and each one's assertion id ``aid``, in DuckDB's spelling."""
    d = Dialect("duckdb")
    rows = " UNION ALL ".join(flat_sql(d, g) for g in groups)
    context = f"CASE WHEN ck IS NULL THEN '' ELSE {_component('key', 'ck')} || {_component('value', 'cv')} END"
    parts = [("subject", "(sk || ':' || si)"), ("predicate", "pred"), ("object", "(ok || ':' || oi)"), ("context", f"({context})"), ("qualifiers", "''"), ("polarity", "polarity")]
    return f"WITH flat AS ({rows}), facts AS (SELECT *, sha256({' || '.join(_component(n, v) for n, v in parts)}) AS aid FROM flat)"
