"""Secrets, told apart by who owns them.

Strict patterns find the base spans, a wider one finds random-looking tokens. Every candidate value is counted over the whole
corpus by distinct repositories and owners: a value that many owners hold is an example that was copied, one that a single owner
holds in many repositories is that owner's boilerplate (a template's placeholder, say), and one that a single owner holds in few
repositories looks live. Only live-looking wide candidates become spans. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import beside, cut, let

# Patterns and least lengths. Matches of hex and access shorter than the least length can be left out of the search
# itself, since a shorter match holds no longer one; an assignment that is too short uses up its text, so it is dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run of 20 token characters or more, taken for random if it has digits, both cases and many different characters.
RANDOM = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Owners from which on a value is a copied example, and repositories from which on a single owner's value is its boilerplate.
COPIED, SPREAD = 2, 3
#: Matches of a text whose places are added up in one list.
STRETCH = 256
#: Quick tests; a text that fails one holds no match of the kind.
MAYBE = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": HEX, "random": RANDOM}


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: start and end in code points, and the value (of group 2 where the pattern has it).

    Splitting at the matches gives the pieces between them, so a place is the sum of the lengths before it.
    """
    value = 2 if pattern is ASSIGN else 0

    def placed(found: Column, pieces: Column, values: Column) -> Column:
        gap, length = (lambda i: F.length(F.get(pieces, i))), (lambda i: F.length(F.get(found, i)))
        last = F.size(found) - 1

        def run(first: Column, to: Column, at: Column) -> Column:
            """The starts of the matches ``first`` to ``to``, the piece before the first one beginning at ``at``."""
            return F.aggregate(F.sequence(first, to), F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, i: F.struct(
                (a["at"] + gap(i) + length(i)).alias("at"), F.array_append(a["starts"], a["at"] + gap(i)).alias("starts")))["starts"]

        def in_blocks() -> Column:
            # where each block of matches begins; a list that grows by one is copied each time, so lists are kept short
            blocks = F.aggregate(F.sequence(F.lit(0), F.floor(last / STRETCH).cast("int")), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ats")), lambda a, k: F.struct(
                F.aggregate(F.sequence(k * STRETCH, F.least(last, k * STRETCH + STRETCH - 1)), a["at"], lambda at, i: at + gap(i) + length(i)).alias("at"),
                F.array_append(a["ats"], a["at"]).alias("ats")))["ats"]
            return F.flatten(F.transform(blocks, lambda at, k: run(k * STRETCH, F.least(last, k * STRETCH + STRETCH - 1), at)))

        starts = F.when(last < STRETCH, run(F.lit(0), last, F.lit(0))).otherwise(in_blocks())
        return let(starts, lambda at: F.transform(found, lambda m, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), F.get(values, i).alias("value"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, nothing).otherwise(let(F.split(text, pattern, -1), lambda p: let(values, lambda v: placed(m, p, v)))))


def random_looking(value: Column) -> Column:
    return (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= 12))


def _named(kind: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.md5(m["value"].cast("binary")).alias("hash"))


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), keep: list[Column] | None = None) -> DataFrame:
    """``row``, owner, repo and ``found``: kind (its place in ``KINDS``), start, end and a 128-bit hash of the value, in text order."""
    t = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    df = beside(docs, keep, _text=t, owner=docs[f"`{owner}`"].cast("string"), repo=F.to_json(F.struct(*[docs[f"`{c}`"].cast("string").alias(f"c{i}") for i, c in enumerate(repository)])))
    kinds = []
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int,hash:string>>")
    for i, (kind, pattern) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM))):
        found = matches(F.col("_text"), pattern)
        if kind == "assign":
            found = F.filter(found, lambda m: F.length(m["value"]) >= 6)
        if kind == "random":
            found = F.filter(found, lambda m: random_looking(m["value"]))
        named = F.transform(found, _named(i))
        kinds.append(F.when(F.col("_text").rlike(MAYBE[kind]), named).otherwise(nothing))
    return df.select("row", "owner", "repo", F.array_sort(F.concat(*kinds), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """For each hash its number of distinct owners and repositories. A null owner is one owner.

    The distinct triples are formed first and combined before the shuffle, so a value in a third of all rows is a few rows for each task.
    """
    seen = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash")).distinct()
    return seen.groupBy("hash").agg(F.count_distinct(F.coalesce("owner", F.lit("\x00null"))).alias("n_owners"), F.count_distinct("repo").alias("n_repos"))


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied: int = COPIED,
                 spread: int = SPREAD, keep: list[Column] | None = None) -> DataFrame:
    """All documents as ``row`` with ``spans``: kind, start, end, n_owners, n_repos and live, by start and kind.

    A value is live if fewer than ``copied`` owners and fewer than ``spread`` repositories hold it. Base spans are all there, live or
    not; a random-looking token is there if it is live and overlaps no base span. Null and empty texts have no spans, a very long text
    all of its own; repeated rows count once for their owner; an empty table stays empty.
    """
    found = cut(candidates(docs, text, owner, repository, keep).withColumn("rid", F.monotonically_increasing_id()))
    known = ownership(found)
    each = found.where(F.size("found") > 0).select("rid", F.explode("found").alias("x"))
    k = known.withColumnRenamed("hash", "_hash")
    told = each.join(k, each["x.hash"] == k["_hash"]).select("rid", "x.start", "x.kind", "x.end", "n_owners", "n_repos", ((F.col("n_owners") < copied) & (F.col("n_repos") < spread)).alias("live"))
    # base spans that reach into a span come before it and end late, or follow it and start early
    base = F.col("kind") < KINDS.index("random")
    earlier = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach, next_ = F.max(F.when(base, F.col("end"))).over(earlier), F.min(F.when(base, F.col("start"))).over(later)
    covered = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("end"), F.lit(False))
    kept = told.withColumn("covered", covered).where(base | F.col("live") & ~F.col("covered"))
    lists = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("all")).withColumnRenamed("rid", "_rid")  # a row's own spans
    nothing = F.array().cast(lists.schema["all"].dataType)
    out = found.join(lists, found["rid"] == lists["_rid"], "left").select("row", F.coalesce("all", nothing).alias("spans"))
    name = F.array(*[F.lit(k) for k in KINDS])
    return out.withColumn("spans", F.transform("spans", lambda x: F.struct(F.get(name, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                                           x["n_owners"].alias("n_owners"), x["n_repos"].alias("n_repos"), x["live"].alias("live"))))
