"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key divided by its quality weight. A source's target is met by complete epochs first and then
by the documents with the smallest keys, as far as the rest of its budget goes. The sample is a prefix of each source in key
order, so a running sum finds the last key of the prefix, and a comparison with it is all that the documents need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, beside, cut, let, running

#: Share of symbols among words at which the quality weight reaches its least value.
LEAST_QUALITY = 0.05


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + SPACE[1:] + "+")).cast("long")


def quality_weight(text: Column, n_words: Column) -> Column:
    """1 for a text without symbols, less by the symbols for each word, at least ``LEAST_QUALITY``."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(LEAST_QUALITY), 1 - symbols / F.greatest(n_words, F.lit(1)))


def exponential_key(seed: int, quality: Column, *identity: Column) -> Column:
    """-ln(u) / quality, u drawn from a hash of the seed and of what identifies the row: the same on every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(u) / quality


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size`` with ``target``: the sum of all sizes shared by weights that repeat over the sources in code point
    order (null last), none above ``most`` times its source's size, the excess shared anew by weight until none is above."""
    df = sources.withColumn("last", F.col("source").isNull()).withColumn("_s", F.coalesce("source", F.lit("")))
    ranked = running(df, [], ["last", "_s"], [])
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # budget for each unit of weight; a source whose cap lies below its share is full
    while total:
        full = cap <= F.col("weight") * level
        taken, free = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        following = (total - (taken or 0.0)) / free
        if following <= level:
            break
        level = following
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def mix_plan(keyed: DataFrame) -> DataFrame:
    """From ``source, size, key, tie, place`` of all documents: source, source_size, target, epochs and the last ``key, tie, place`` of the fraction."""
    sizes = cut(keyed.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes)
    targets = cut(targets.withColumn("epochs", F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.col("source_size") + 1e-9))).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))))
    order = running(keyed.where("size > 0"), ["source"], ["key", "tie", "place"], ["size"])
    t = targets.select(F.col("source").alias("_source"), "rest")
    inside = order.join(t, order["source"].eqNullSafe(t["_source"])).where(F.col("size_before") + F.col("size") / 2 <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max(F.struct("key", "tie", "place")).alias("last")).select(F.col("source").alias("_last_source"), "last")
    return cut(targets.join(last, targets["source"].eqNullSafe(last["_last_source"]), "left").drop("_last_source", "rest", "weight"))


def mixed(docs: DataFrame, seed: int = 17, text: str = "text", source: str = "source", row_id: str = "doc_id", quality: Column | None = None,
          keep: list[Column] | None = None) -> DataFrame:
    """All documents as ``row`` with size, source, source_size, target and copies (how often the mix takes the document, at most 3).

    Null is a source of its own; texts that are null or hold no word have size 0 and are taken only with complete epochs; a very long
    text is one document like any other. Rows that agree in id, source and text share a key and are told apart by their place, so as
    many of them are taken as the budget asks for. The taken words of a source miss its target by half a document at most. An empty
    table gives no rows.
    """
    t = docs[f"`{text}`"].cast("string")
    drawn = let(word_count(t), lambda n: F.struct(n.alias("size"), (quality if quality is not None else quality_weight(t, n)).cast("double").alias("q")))
    df = beside(docs, keep, source=docs[f"`{source}`"].cast("string"), drawn=drawn, tie=F.xxhash64(F.lit(seed), docs[f"`{row_id}`"], t), place=F.monotonically_increasing_id())
    # written, since places must be the same whenever the rows are read; the words are counted once
    df = cut(df.select("row", "source", "drawn.size", "tie", "place", exponential_key(seed, F.col("drawn.q"), F.col("tie")).alias("key")))
    plan = mix_plan(df.select("source", "size", "key", "tie", "place"))
    p = plan.withColumnRenamed("source", "_source")
    chosen = (F.col("size") > 0) & (F.struct("key", "tie", "place") <= F.col("last"))
    return df.join(p, df["source"].eqNullSafe(p["_source"]), "left").select(
        "row", "source", "size", "source_size", "target", (F.col("epochs") + F.coalesce(chosen.cast("long"), F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 17, **columns: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, all its columns as they were; odd rows as in ``mixed``."""
    return mixed(docs, seed, **columns).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
