"""Loading a seed ontology from JSON: {name, classes: [{key, label}], taxonomy: [{child, parent}]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ontology import OntologyError, duplicates

SCHEMA = "name string, classes array<struct<key:string,label:string>>, taxonomy array<struct<child:string,parent:string>>"


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, edges) from a column ``value`` of JSON texts; a duplicate or unknown key is an error."""
    docs = rows.select(F.from_json("value", SCHEMA).alias("seed"))
    if not docs.where("seed IS NULL OR seed.name IS NULL OR seed.classes IS NULL").isEmpty():
        raise OntologyError("malformed seed")
    classes = docs.select(F.explode("seed.classes").alias("c")).select("c.key", "c.label")
    edges = docs.select(F.explode("seed.taxonomy").alias("t")).select("t.child", "t.parent")
    if not duplicates(classes, "key").isEmpty():
        raise OntologyError("duplicate class key")
    ends = edges.select(F.explode(F.array("child", "parent")).alias("key"))
    if not ends.join(classes, "key", "left_anti").isEmpty():
        raise OntologyError("unknown class key in the taxonomy")
    return classes, edges.distinct()


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse(spark.read.text(path, wholetext=True))
