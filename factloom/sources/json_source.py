"""JSON sources: a capture envelope, the content-type gate, and decoding into source records.

A payload is an object or an array of objects. Every object becomes a record whose key is a scalar field, or
``record-<ordinal>``; array members carry the locator ``/<ordinal>``. What can't be decoded is a row with an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import valid_label

# The source classes; a custom class is any other valid label.
SOURCE_CLASSES = ("structured", "semi-structured", "unstructured", "machine-generated", "human-curated")
ENVELOPE = ["operation", "source_id", "source_class", "artifact", "content_type", "version", "captured_at"]


def capture(payloads: DataFrame, **envelope: str | Column) -> DataFrame:
    """Payloads (column ``payload``) with the capture envelope as columns."""
    return payloads.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in envelope.items()})


def is_json(content_type: Column) -> Column:
    """application/json or a +json type, whatever its case and parameters."""
    kind = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    return F.coalesce(kind.rlike(r"^(application/json|[^/\s]+/[^/\s]+\+json)$"), F.lit(False))


def valid_envelope() -> Column:
    out = F.lit(True)
    for name in ("operation", "source_id", "source_class", "artifact", "version"):
        out = out & valid_label(F.col(name))
    return out & F.col("captured_at").isNotNull()


def scalar_text(value: Column, field: str) -> Column:
    """A string or number field as text; others (and absent ones) are null."""
    found = F.try_variant_get(value, f"$.{field}", "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$"), F.try_variant_get(value, f"$.{field}", "string"))


def decode(raw: DataFrame, key_field: str | None = None, external_field: str | None = None) -> DataFrame:
    """(…envelope, ordinal, record_key, locator, external_id, record, error); ``record`` is the object's JSON text."""
    parsed = raw.withColumn("value", F.try_parse_json("payload"))
    shape = F.schema_of_variant("value")
    array = shape.startswith("ARRAY")
    error = (
        F.when(~valid_envelope(), "invalid-envelope")
        .when(~is_json(F.col("content_type")), "unsupported-content-type")
        .when(F.col("value").isNull(), "malformed-json")
        .when(~(array | shape.startswith("OBJECT")), "unsupported-root")
    )
    judged = parsed.withColumns({"error": error, "is_array": F.coalesce(array, F.lit(False))})
    items = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("variant"))).when(F.col("is_array"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    exploded = judged.select(*[c for c in raw.columns if c != "payload"], "error", "is_array", F.posexplode_outer(items).alias("ordinal", "item"))
    object_ = F.schema_of_variant("item").startswith("OBJECT")
    error = F.coalesce(F.col("error"), F.when(F.col("item").isNull() | ~object_, F.lit("record-not-an-object")))
    # An empty array has no record and no error.
    exploded = exploded.where("NOT (error IS NULL AND is_array AND ordinal IS NULL)").withColumn("error", error)
    named = F.concat(F.lit("record-"), F.col("ordinal").cast("string"))
    key = F.coalesce(scalar_text(F.col("item"), key_field), named) if key_field else named
    external = scalar_text(F.col("item"), external_field) if external_field else F.lit(None).cast("string")
    return exploded.select(
        *[c for c in raw.columns if c != "payload"],
        F.when(F.col("error").isNull(), F.col("ordinal")).alias("ordinal"),
        F.when(F.col("error").isNull(), key).alias("record_key"),
        F.when(F.col("error").isNull() & F.col("is_array"), F.concat(F.lit("/"), F.col("ordinal").cast("string"))).alias("locator"),
        F.when(F.col("error").isNull(), external).alias("external_id"),
        F.when(F.col("error").isNull(), F.to_json("item")).alias("record"),
        "error",
    )


def valid_record() -> Column:
    """Labels present, and an external id only of the record's own source."""
    own = F.col("external_source").isNull() | (F.col("external_source") == F.col("source_id"))
    return valid_label(F.col("record_key")) & valid_label(F.col("source_id")) & F.coalesce(own, F.lit(False))


def adapted(records: DataFrame, raw: DataFrame) -> DataFrame:
    """Records whose source, class and version are those of a captured payload."""
    key = ["source_id", "source_class", "version"]
    return records.join(raw.select(*key).distinct(), key, "left_semi")


class SourceAdapter(Protocol):
    """What turns captured payloads of one source into records (source_id, source_class, version, record_key, external_source,
    ...), one or more rows for each payload."""

    source_id: str
    source_class: str

    def decode_payload(self, raw: DataFrame) -> DataFrame: ...


@dataclass
class JsonAdapter:
    """The adapter over JSON payloads: ``decode`` with a key field."""

    source_id: str
    source_class: str
    key_field: str | None = None

    def decode_payload(self, raw: DataFrame) -> DataFrame:
        return decode(raw, self.key_field).where("error IS NULL").withColumn("external_source", F.lit(None).cast("string"))


def decoded_by(adapter: SourceAdapter, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads with ``code``, records with ``code``): the checks around an adapter's decoding.

    Only payloads of the adapter's own source and class with a whole envelope are decoded; a record's metadata must be valid
    and name its payload's source, class and version. Null codes pass.
    """
    code = (
        F.when(~valid_envelope(), "invalid-raw-material")
        .when(F.col("source_id") != adapter.source_id, "source-mismatch")
        .when(F.col("source_class") != adapter.source_class, "source-class-mismatch")
    )
    judged = raw.withColumn("code", code)
    good = judged.where("code IS NULL").drop("code")
    versions = good.select(F.col("version").alias("raw_version")).distinct()
    found = adapter.decode_payload(good).join(versions, F.col("version") == F.col("raw_version"), "left")
    code = (
        F.when(~valid_record(), "invalid-record-metadata")
        .when(F.col("source_id") != adapter.source_id, "source-mismatch")
        .when(F.col("source_class") != adapter.source_class, "source-class-mismatch")
        .when(F.col("raw_version").isNull(), "source-version-mismatch")
    )
    return judged, found.withColumn("code", code).drop("raw_version")
