"""Entity resolution: ten match signals by one equi-join, deterministic ranking, threshold and margin decision.

Both sides become rows (signal, key); a signal holds where keys meet. One join and one aggregation replace the
comparison of every input with every profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import normalize
from factloom.operators.lineage import cut

#: Signals and their priorities.
PRIORITY = {
    "exact-identifier": 10,
    "exact-alias": 9,
    "source-identifier": 8,
    "normalized-name-or-alias": 7,
    "transliteration": 6,
    "lexical": 5,
    "language": 4,
    "semantic-relationship": 3,
    "context": 2,
    "graph-neighborhood": 1,
}
THRESHOLD, MARGIN = 7, 1
#: Key sets of a profile or an input, by signal.
SETS = {"lexical": "lexical_keys", "language": "language_keys", "semantic-relationship": "semantic_keys", "context": "context_keys", "graph-neighborhood": "neighborhood_keys"}


def _rows(signal: str, keys: Column) -> Column:
    return F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(F.lit(signal).alias("signal"), k.alias("key")))


def _set(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")) if name in df.columns else F.expr("cast(array() as array<string>)")


def _pair_keys(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.concat_ws("\x1f", p["source_id"], p["value"]))


def _one(value: Column) -> Column:
    return F.filter(F.array(value), lambda x: x.isNotNull())


def _nonempty(keys: Column) -> Column:
    return F.filter(keys, lambda k: k.isNotNull() & (k != ""))


def profile_keys(profiles: DataFrame) -> DataFrame:
    """(entity_id, signal, key) of profiles (entity_id, names, aliases, identifiers, source_identifiers, transliterations, key sets)."""
    names, aliases = _set(profiles, "names"), _set(profiles, "aliases")
    identifiers = F.concat(_one(F.col("entity_id")), _set(profiles, "identifiers"))
    sources = F.col("source_identifiers") if "source_identifiers" in profiles.columns else F.expr("cast(array() as array<struct<source_id:string,value:string>>)")
    parts = [
        _rows("exact-identifier", identifiers),
        _rows("exact-alias", aliases),
        _rows("source-identifier", _pair_keys(F.coalesce(sources, F.expr("cast(array() as array<struct<source_id:string,value:string>>)")))),
        _rows("normalized-name-or-alias", _nonempty(F.transform(F.concat(names, aliases), normalize))),
        _rows("transliteration", _nonempty(F.transform(_set(profiles, "transliterations"), normalize))),
        *[_rows(signal, _set(profiles, name)) for signal, name in SETS.items()],
    ]
    return profiles.select("entity_id", F.explode(F.array_distinct(F.concat(*parts))).alias("x")).select("entity_id", "x.signal", "x.key").distinct()


def input_keys(inputs: DataFrame) -> DataFrame:
    """(input_id, signal, key) of inputs (input_id, text, identifier, source_id, value, transliteration, key sets)."""
    has = lambda name: F.col(name) if name in inputs.columns else F.lit(None).cast("string")
    text = F.col("text")
    normal = normalize(text)
    source = F.when(has("source_id").isNotNull() & has("value").isNotNull(), F.concat_ws("\x1f", has("source_id"), has("value")))
    parts = [
        _rows("exact-identifier", _one(has("identifier"))),
        _rows("exact-alias", _one(F.when(normal != "", text))),
        _rows("source-identifier", _one(source)),
        _rows("normalized-name-or-alias", _nonempty(F.array(normal))),
        _rows("transliteration", _nonempty(F.array(normalize(has("transliteration"))))),
        *[_rows(signal, _set(inputs, name)) for signal, name in SETS.items()],
    ]
    return inputs.select("input_id", F.explode(F.array_distinct(F.concat(*parts))).alias("x")).select("input_id", "x.signal", "x.key")


def _priority(signal: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), signal)


def candidates(inputs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(input_id, entity_id, signals, priorities, primary): signals of all profiles of an entity together."""
    met = input_keys(inputs).join(profile_keys(profiles), ["signal", "key"]).select("input_id", "entity_id", "signal").distinct()
    found = met.groupBy("input_id", "entity_id").agg(F.collect_set("signal").alias("signals"))
    priorities = F.reverse(F.array_sort(F.transform("signals", _priority)))
    return found.withColumn("signals", F.array_sort("signals")).withColumn("priorities", priorities).withColumn("primary", F.coalesce(F.array_max("priorities"), F.lit(0)))


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with their place, the best of an input first, and the primary of the one after."""
    order = Window.partitionBy("input_id").orderBy(F.desc("primary"), F.desc("priorities"), F.asc("entity_id"))
    return found.withColumn("place", F.row_number().over(order)).withColumn("next_primary", F.lead("primary").over(order))


def decide(inputs: DataFrame, found: DataFrame, threshold: int = THRESHOLD, margin: int = MARGIN) -> DataFrame:
    """(input_id, decision, entity_id): unknown, unresolved, ambiguous or resolved; an entity only where resolved."""
    best = ranked(found).where("place = 1")
    joined = inputs.select("input_id").join(best, "input_id", "left")
    decision = (
        F.when(F.col("entity_id").isNull(), "unknown")
        .when(F.col("primary") < threshold, "unresolved")
        .when(F.col("next_primary").isNotNull() & (F.col("primary") - F.col("next_primary") < margin), "ambiguous")
        .otherwise("resolved")
    )
    return joined.select("input_id", decision.alias("decision"), F.when(decision == "resolved", F.col("entity_id")).alias("entity_id"))


def explicit(inputs: DataFrame, decision: str) -> DataFrame:
    """Provisional or rejected decisions made by a person."""
    if decision not in ("provisional", "rejected"):
        raise ValueError(f"{decision!r} is not an explicit decision")
    return inputs.select("input_id", F.lit(decision).alias("decision"), F.lit(None).cast("string").alias("entity_id"))


def circular(active: Column, depends_on: Column) -> Column:
    """Whether evidence depends on an assertion that is being resolved."""
    return F.coalesce(F.arrays_overlap(active, depends_on), F.lit(False))


def resolve(inputs: DataFrame, profiles: DataFrame, threshold: int = THRESHOLD, margin: int = MARGIN) -> DataFrame:
    """(input_id, decision, entity_id), as ``decide`` gives over all ``candidates``, without the pairs that weak signals alone make.

    Keys of a language or a context are shared by many profiles, so their pairs grow with the square of a key. Only pairs with a
    signal from the threshold on are built. Two of them settle an input: with a margin the one's lead over the other decides,
    and weak signals couldn't part a tie. For the others it counts how strong the best signal of any further entity is, which
    the number of entities of each key tells. Without a margin ties go by the weak signals, so all candidates are ranked.
    """
    if margin < 1:
        return decide(inputs, candidates(inputs, profiles), threshold, margin)
    given = input_keys(inputs).withColumn("priority", _priority(F.col("signal")))
    held = profile_keys(profiles)
    strong = given.where(F.col("priority") >= threshold).join(held, ["signal", "key"])
    found = strong.groupBy("input_id", "entity_id").agg(F.max("priority").alias("primary")).withColumn("priorities", F.array("primary"))
    best = cut(ranked(found).where("place = 1").select("input_id", "entity_id", "primary", "next_primary"))
    weak = given.where(F.col("priority") < threshold).join(best.where("next_primary IS NOT NULL"), "input_id", "left_anti")
    weak = weak.join(best.select("input_id", "entity_id"), "input_id", "left")
    sizes = held.groupBy("signal", "key").agg(F.count(F.lit(1)).alias("entities"))
    own = held.select("entity_id", "signal", "key", F.lit(1).alias("own"))
    others = weak.join(sizes, ["signal", "key"]).join(own, ["entity_id", "signal", "key"], "left").where(F.col("entities") > F.coalesce("own", F.lit(0)))
    others = others.groupBy("input_id").agg(F.max("priority").alias("other"))
    joined = inputs.select("input_id").join(best, "input_id", "left").join(others, "input_id", "left")
    following = F.coalesce("next_primary", "other")
    decision = (
        F.when(F.col("entity_id").isNull() & F.col("other").isNull(), "unknown")
        .when(F.col("entity_id").isNull(), "unresolved")
        .when(following.isNotNull() & (F.col("primary") - following < margin), "ambiguous")
        .otherwise("resolved")
    )
    return joined.select("input_id", decision.alias("decision"), F.when(decision == "resolved", F.col("entity_id")).alias("entity_id"))


def crosswalk_conflicts(crosswalk: DataFrame) -> DataFrame:
    """(source_id, value, entities) of external identifiers that name more than one entity."""
    grouped = crosswalk.groupBy("source_id", "value").agg(F.count_distinct("entity_id").alias("entities"))
    return grouped.where("entities > 1")
