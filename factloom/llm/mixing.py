"""Mixing sources to target weights.

Every row gets a hash-random key (MD5 of its id). A source's rows are dealt into ranges of the key, word
counts are summed by range with a partial aggregation, and running sums over a source's ranges tell in which
range its budget ends; only that range is sorted row by row. So a source of any size is cut at its exact
budget without one task seeing more than a range of it, and reruns agree. A budget beyond a source's size
repeats it in whole epochs; the last epoch is cut, inside a document if the budget ends there.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all sources; a
target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared again by weight. In closed
form: with capped sources C, every other target is weight * (total - cap(C)) / weight(not C), where C is a
prefix of the sources in order of cap / weight.

Defined results: null text has size 0 (and takes 0); a null source is a source of its own, last in order; a
source without words has target 0; rows that agree in id and text at the cut share what is left of the
budget evenly, so equal rows take equally; a null doc_id takes the key of the empty id with its text; texts of any length
count whole; an empty table gives an empty result; columns besides doc_id, text and source are ignored by ``mix`` and passed
on by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import WORD, checkpointed

WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Sources whose cuts are broadcast to the rows; beyond it the rows meet them by a shuffle. A cut is under 300 bytes.
BROADCAST_SOURCES = 20_000
#: Hexadecimal digits of the key that name a range: up to 4096 ranges for each source.
RANGE_DIGITS = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """The row's hash-random key; rows of one id are told apart by their text."""
    return F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source"), key_of(F.col("doc_id"), F.col("text")).alias("key"), words_of(F.col("text")).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source, so windows over all are small."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(weights, F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("long")).withColumn("cap", F.lit(MAX_EPOCHS) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    here, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(here), F.lit(0)).alias("capped_before"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(here), F.lit(0))).alias("weight_left"),
        F.sum("source_size").over(all_rows).alias("total"),
    )
    # A source is capped when its share of what the ones before leave is at least its cap.
    capped = F.col("cap").cast("double") * F.col("weight_left") <= F.col("weight").cast("double") * (F.col("total") - F.col("capped_before"))
    filled = filled.withColumn("capped", capped)
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * rest.cast("double") / left.cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def cuts(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words, cut_rows): whole epochs, and in the next one the
    key at which the budget ends, with the words it leaves for the rows of that key and how many they are."""
    ranges = rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("words"))
    ranges = checkpointed(ranges)
    budgets = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    budgets = budgets.withColumn("budget", F.floor("target").cast("long"))
    budgets = budgets.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    budgets = checkpointed(budgets.withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size")))
    in_source = Window.partitionBy("source").orderBy("range")
    running = ranges.withColumn("before", F.sum("words").over(in_source) - F.col("words"))
    ends = running.join(budgets.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where("before <= left AND left < before + words").select(F.col("s").alias("source"), "range", (F.col("left") - F.col("before")).alias("left_here"))
    last = rows.alias("r").join(_small(checkpointed(ends)).alias("e"), same_range())
    last = last.groupBy(F.col("r.source").alias("source"), "left_here", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    running = last.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("key")) - F.col("words"))
    cut = running.where("before <= left_here AND left_here < before + words")
    cut = cut.select(F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("left_here") - F.col("before")).alias("cut_words"), F.col("n").alias("cut_rows"))
    return _small(checkpointed(budgets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left")))


def _small(by_source: DataFrame) -> DataFrame:
    """A table of a row for each source, marked for broadcast if it is within the limit."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def same_range() -> Column:
    return F.col("r.source").eqNullSafe(F.col("e.source")) & (F.substring("r.key", 1, RANGE_DIGITS) == F.col("e.range"))


def taken(key: Column, size: Column) -> Column:
    """Words taken of a row, given its source's cut."""
    last = F.when(F.col("cut_key").isNull() | (key > F.col("cut_key")), F.lit(0)).when(key < F.col("cut_key"), size).otherwise(F.least(size, F.expr("cut_words div cut_rows")))
    return (F.col("epochs") * size + last).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each input row."""
    rows = checkpointed(sized(docs))
    found = rows.join(cuts(rows).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "size", "source_size", "target", taken(F.col("key"), F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: a row for every epoch a document is taken in, the last cut where the budget ends.

    A document cut inside keeps its first words, joined by single spaces; n_chars follows the new text.
    """
    plan = cuts(checkpointed(sized(docs)))
    packed = docs.select(F.struct("*").alias("row"))
    key, size = key_of(F.col("row.doc_id"), F.col("row.text")), words_of(F.col("row.text"))
    found = packed.withColumn("key", key).withColumn("size", size).join(plan, F.col("row.source").eqNullSafe(F.col("source")))
    found = found.withColumn("rest", taken(F.col("key"), F.col("size")) - F.col("epochs") * F.col("size"))
    copies = F.concat(
        F.array_repeat(F.lit(True), F.col("epochs").cast("int")),
        F.when(F.col("rest") > 0, F.array(F.col("rest") == F.col("size"))).otherwise(F.expr("cast(array() as array<boolean>)")),
    )
    # A document without words can't be taken by words: it stays once.
    found = found.withColumn("copies", F.when(F.col("size") == 0, F.array(F.lit(True))).otherwise(copies))
    found = found.withColumn("whole", F.explode("copies"))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("rest").cast("int")), " ")
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(short)
    columns = []
    for field in docs.schema.fields:
        value = F.col("row").getField(field.name)
        if field.name == "text":
            value = text
        elif field.name == "n_chars":
            value = F.when(F.col("whole"), value).otherwise(F.length(text).cast(field.dataType))
        columns.append(value.alias(field.name))
    return found.select(*columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS capped_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left,
             sum(source_size) OVER () AS total FROM w
      WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) * weight_left <= CAST(weight AS DOUBLE) * (total - capped_before) AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE)
             * CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT z.*, g.source_size, g.target, g.epochs, CAST(floor(g.target) AS BIGINT) - g.epochs * g.source_size AS budget,
             CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
             - CAST(sum(z.size) OVER (PARTITION BY z.source, k) AS BIGINT) AS before, count(*) OVER (PARTITION BY z.source, k) AS n
      FROM sized z JOIN g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + CASE WHEN before + n * size <= budget THEN size WHEN before >= budget THEN 0 ELSE least(size, (budget - before) // n) END AS BIGINT) AS taken FROM r
"""
