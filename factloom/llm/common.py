"""Shared pieces of the training-data operators: checkpoints, Arrow batches and native span arithmetic."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.arrays import let, running
from factloom.operators.lineage import checkpoint_folder as shared_folder

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch; with the byte limit below a Python worker holds a bounded slice of a partition.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20
#: Binary logarithm of the characters in a part of a text that is cut at many places.
PART_BITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch hands to a Python worker, in rows and in bytes.

    These are settings of the whole session and stay set: every operator of this subpackage with Python workers sets the
    same two values before it builds its plan, and other Arrow work of the session only gets smaller batches by them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder: like a checkpoint, but columns are compressed and read
    apart, for wide or large tables that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input comes in fewer parts than there are cores (one small file); a larger input
    stays as it is read. For work that costs much more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def raw_bytes(column: pa.Array) -> Iterator[memoryview]:
    """Each value of a binary Arrow array as a view, without copying."""
    if not len(column):
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    places = memoryview(offsets).cast("q" if wide else "i")[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for start, end in zip(places, places[1:]):
        yield view[start:end]


def match_spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches with the matched text, built from native functions alone.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches, so running
    lengths give the places (code points, end exclusive). ``keep`` maps (match, group) to a condition.
    Result: array<struct<s int, k int, e int, v string>>, in order of place.
    """
    fields = {"m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "g": F.split(text, pattern, -1)}
    if group:
        fields["v"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def measured(x: Column) -> Column:
        def part(m: Column, i: Column) -> Column:
            ok = keep(m, F.get(x["v"], i) if group else m)
            return F.struct(m.alias("m"), F.length(m).alias("long"), (F.length(F.get(x["g"], i)) + F.length(m)).alias("step"), ok.alias("ok"))

        return F.transform(x["m"], part)

    def summed(parts: Column) -> Column:
        return F.struct(parts.alias("p"), running(F.transform(parts, lambda p: p["step"]), F.lit(0), lambda a, b: a + b).alias("ends"))

    def placed(x: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            end = F.get(x["ends"], i)
            return F.struct((end - p["long"]).alias("s"), F.lit(kind).alias("k"), end.alias("e"), p["m"].alias("v"), p["ok"].alias("ok"))

        good = F.filter(F.transform(x["p"], span), lambda y: y["ok"])
        return F.transform(good, lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e"), y["v"].alias("v")))

    return let(let(let(F.struct(*[c.alias(name) for name, c in fields.items()]), measured), summed), placed)


#: Type of a list of spans with the matched text.
VALUED = "array<struct<s:int,k:int,e:int,v:string>>"


def guarded_spans(text: Column, hint: str, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """``match_spans`` only where the cheap necessary condition ``hint`` holds; elsewhere an empty array."""
    return F.when(text.rlike(hint), match_spans(text, pattern, kind, keep, group)).otherwise(F.expr(f"cast(array() as {VALUED})"))


def places(spans: Column) -> Column:
    """The spans without the matched text: array<struct<s, k, e>>."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def merged(spans: Column) -> Column:
    """Groups of overlapping spans as one span each, of the first one's kind: array<struct<s, k, e>> in order of place."""

    def reached(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: y["e"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return F.struct(x.alias("x"), ends.alias("ends"))

    def heads(x: Column) -> Column:
        numbered = F.transform(x["x"], lambda y, i: F.struct(y["s"].alias("s"), y["k"].alias("k"), i.alias("i")))
        first = F.filter(numbered, lambda y: (y["i"] == 0) | (y["s"] >= F.get(x["ends"], y["i"] - 1)))
        return F.struct(first.alias("first"), x["ends"].alias("ends"))

    def ended(x: Column) -> Column:
        def one(y: Column, i: Column) -> Column:
            until = F.coalesce(F.get(x["first"], i + 1)["i"], F.size(x["ends"])) - 1
            return F.struct(y["s"].alias("s"), y["k"].alias("k"), F.get(x["ends"], until).alias("e"))

        return F.transform(x["first"], one)

    return let(let(let(F.array_sort(spans), reached), heads), ended)


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text given as its ``text_parts``."""
    first = F.shiftright(start, PART_BITS)
    n = F.greatest(F.shiftright(end - 1, PART_BITS) - first + 1, F.lit(0))
    near = F.array_join(F.slice(parts, first + 1, n), "")
    return F.substring(near, start - F.shiftleft(first, PART_BITS) + 1, end - start)


def text_parts(text: Column) -> Column:
    """A text in parts of 2**PART_BITS characters. A place of a string is found by counting characters from its start; in
    parts, what is cut out at many places costs no more than a part each."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PART_BITS}}}"), F.lit(0))


def rewritten(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """The text with ``new`` of each group of overlapping spans in its place."""

    def joined(x: Column) -> Column:
        def piece(y: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(x["m"], i - 1)["e"])
            return F.concat(cut(x["t"], before, y["s"]), new(y))

        pieces = F.transform(x["m"], piece)
        return F.concat(F.array_join(pieces, ""), cut(x["t"], F.element_at(x["m"], -1)["e"], x["n"]))

    whole = let(F.struct(merged(spans).alias("m"), text_parts(text).alias("t"), F.length(text).alias("n")), joined)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def contained(values: Column, word: Callable[[Column], Column], spans: Column) -> Column:
    """The spans whose ``word`` is among the values, which are dealt into lists by a hash so that each span asks a short one."""

    def dealt(v: Column) -> Column:
        n = F.least(F.floor(F.size(v) / 8).cast("int") + 1, F.lit(1024))
        return let(n, lambda k: F.struct(k.alias("n"), F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.filter(v, lambda y: F.pmod(F.hash(y), k) == i)).alias("lists")))

    def asked(x: Column) -> Column:
        return F.filter(spans, lambda y: let(word(y), lambda w: F.array_contains(F.get(x["lists"], F.pmod(F.hash(w), x["n"])), w)))

    return let(let(values, dealt), asked)


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    lines = F.transform(
        F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    )
    return F.array_join(lines, ",")


def spans_of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")
