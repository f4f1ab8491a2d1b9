"""Personal data by information-theoretic sanitisation, with DataFrame functions alone.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Each distinct value found
is a protected entity. The method asks how strongly the terms of the documents that hold an entity reveal it: over all
documents, with n(t, e) that have term t outside of mentions and e, n(t) that have t anywhere, n(e) that have e, and N in all,

    disclosure(t, e) = log(n(t, e) N / (n(t) n(e))) / log(N / n(e))

is pointwise mutual information as a share of the entity's information content; it is 1 where the term occurs only in
documents with the entity. Terms from ``THRESHOLD`` on, seen with it in ``SUPPORT`` different texts at least, are spans of
kind ``term`` wherever they occur in the documents that hold the entity, and are generalised with it. Documents without the
entity keep them: once every document with both has lost both, none links the term to the entity.

Copies of a text are counted once and weighted. Entities below the support go before terms are paired with them, a hot
entity is split over ``SALTS`` keys, and pairs and the corpus' terms are counted by partial sums before they are joined.

Defined results: null text counts as empty and has no span (``sanitised`` leaves it null); texts of any length are scanned
whole; a null doc_id is kept; copies of one text are one text for the support and as many documents for the other counts;
repeated rows keep a row each with equal results; a disclosure equal to the threshold counts; an empty table gives an empty
result; columns besides doc_id and text are ignored, whatever their names, and ``sanitised`` passes them on (n_chars, where
there is one, follows the new text). Spans count code points, end excluded; kinds may overlap, and replacement merges what
overlaps under the label of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, contained, guarded_spans, let, match_spans, places, rewritten, spans_of_kind, spans_text

KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]
THRESHOLD, SUPPORT, SALTS = 0.9, 3, 16

# The contract's patterns, made linear: a match starts where its first run starts (or where the last match ended), and
# runs that nothing after them can take back are possessive. Their matches are the same.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string of 14 to 19 passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))

    def card(match: Column, _: Column) -> Column:
        n = F.length(_digits(match))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))

    def phone(match: Column, _: Column) -> Column:
        return F.length(_digits(match)).between(10, 15)

    return F.concat(
        guarded_spans(text, r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", EMAIL, 0, lambda *_: F.lit(True)),
        guarded_spans(text, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", IP, 1, lambda m, _: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        guarded_spans(text, r"[0-9](?:[\x20-]?[0-9]){13}", CARD, 2, card),
        guarded_spans(text, r"\+[0-9][\x20().0-9-]", PHONE, 3, phone),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans; what stays keeps its place."""
    return rewritten(text, spans, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _salted(small: DataFrame) -> DataFrame:
    """The rows once for each salt, so that a hot key of the other side is joined in ``SALTS`` parts."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, text, entities, terms, cut), a row for each document, checkpointed.

    The last four are null without a base span. ``terms`` are outside of mentions; ``cut`` are those of them that a
    mention cuts out of a longer term, so the whole text doesn't have them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("valued", base_spans(F.col("text")))
    rows = rows.withColumn("spans", places(F.col("valued")))
    entities = F.array_distinct(F.transform("valued", lambda x: F.lower(x["v"])))
    some = F.size("spans") > 0
    rows = rows.withColumns({"text_key": _text_key(F.col("text")), "entities": F.when(some, entities), "terms": F.when(some, _terms(masked(F.col("text"), F.col("spans"))))})
    cut = F.when(some, F.array_except("terms", _terms(F.col("text"))))
    return checkpointed(rows.select("doc_id", "text_key", "spans", F.when(some, F.col("text")).alias("text"), "entities", "terms", cut.alias("cut")))


def disclosures(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame | None:
    """(text_key, strong) with the terms from the threshold on of some entity the text holds; None where no entity has the
    support."""
    texts = found.where("size(entities) > 0").groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    held = texts.select("text_key", "copies", F.explode("entities").alias("entity"))
    counted = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    frequent = checkpointed(counted.where(F.col("texts") >= support).select("entity", "n_entity"))
    if frequent.isEmpty():
        return None
    known = held.withColumn("salt", _salt("text_key")).join(_salted(frequent), ["entity", "salt"]).groupBy("text_key").agg(F.collect_list(F.struct("entity", "n_entity")).alias("known"))
    holders = checkpointed(texts.join(known, "text_key").select("text_key", "copies", "terms", "known"))
    pairs = holders.select("copies", "known", F.explode("terms").alias("term")).select("copies", "term", F.explode("known").alias("x")).select("copies", "term", "x.*")
    together = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"))
    together = checkpointed(together.where(F.col("texts") >= support))
    whole = docs.where("text IS NOT NULL").select(F.explode(_terms(F.col("text"))).alias("term"))
    n_term = whole.unionByName(found.select(F.explode("cut").alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = max(2, found.count())
    pmi = F.log(F.col("both") * float(total) / (F.col("n_term") * F.col("n_entity")))
    content = F.log(float(total) / F.col("n_entity"))
    disclosure = F.when(content > 0, pmi / F.greatest(content, F.lit(1e-12))).otherwise(F.lit(0.0))
    strong = together.join(n_term, "term").where(disclosure >= threshold).select("entity", "term")
    again = holders.select("text_key", "known", F.explode("terms").alias("term")).select("text_key", "term", F.explode("known.entity").alias("entity"))
    hits = again.withColumn("salt", _salt("text_key")).join(_salted(strong), ["entity", "term", "salt"])
    return hits.groupBy("text_key").agg(F.collect_set("term").alias("strong"))


def _term_spans(text: Column, spans: Column, strong: Column) -> Column:
    """The spans of the given terms, at every place outside of the other spans."""
    found = let(masked(text, spans), lambda t: match_spans(t, TERM, 4, lambda *_: F.lit(True)))
    return places(contained(strong, lambda x: F.lower(x["v"]), found))


def _joined(rows: DataFrame, strong: DataFrame | None, text: str) -> DataFrame:
    """Rows with ``doc_id``, ``text_key`` and ``spans``, the spans of the text's disclosing terms added."""
    if strong is None:
        return rows
    other = _salted(strong.withColumnRenamed("text_key", "__key")).withColumnRenamed("salt", "__part")
    joined = rows.withColumn("__salt", _salt("doc_id", "text_key")).join(other, (F.col("text_key") == F.col("__key")) & (F.col("__salt") == F.col("__part")), "left")
    with_terms = F.when(F.col("strong").isNotNull(), F.concat("spans", _term_spans(F.col(text), F.col("spans"), F.col("strong")))).otherwise(F.col("spans"))
    return joined.withColumn("spans", with_terms).drop("__key", "__salt", "__part", "strong")


def scan(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(doc_id, spans) with spans array<struct<s, k, e>>: base spans and disclosing terms."""
    found = mentions(docs)
    strong = disclosures(docs, found, threshold, support)
    rows = _joined(found.where(F.size("spans") > 0).select("doc_id", "text_key", "spans", "text"), strong, "text")
    return found.where(F.size("spans") == 0).select("doc_id", "spans").unionByName(rows.select("doc_id", "spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by the label of its first."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    return rewritten(text, spans, lambda x: F.element_at(labels, x["k"] + 1))


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; n_chars follows the new text.

    Documents without a base span pass by as they are; only the others meet their terms by a join.
    """
    found = mentions(docs)
    strong = disclosures(docs, found, threshold, support)
    packed = docs.select(F.struct("*").alias("row")).withColumn("spans", places(base_spans(F.col("row.text"))))
    packed = packed.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "text_key": _text_key(F.col("row.text"))})
    clean = packed.where(F.size("spans") == 0).select("row.*")
    dirty = _joined(packed.where(F.size("spans") > 0), strong, "row.text").withColumn("new", replaced(F.col("row.text"), F.col("spans")))
    columns = []
    for field in docs.schema.fields:
        value = F.col("row").getField(field.name)
        if field.name == "text":
            value = F.col("new")
        elif field.name == "n_chars":
            value = F.length("new").cast(field.dataType)
        columns.append(value.alias(field.name))
    return clean.unionByName(dirty.select(*columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["k"] < 4)
    counts = [spans_of_kind(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(spans_text(base, KINDS).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans"), KINDS).alias("spans"))
