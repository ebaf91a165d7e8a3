"""Similarity of column names as Column expressions, so many schemas can be scored in one job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rename_score(a: Column, b: Column) -> Column:
    """Same-place characters, common prefix (0.3), shared words (0.3), containment; at most 1."""
    la, lb = F.length(a), F.length(b)
    longest, shortest = F.greatest(la, lb).cast("double"), F.least(la, lb).cast("double")
    # per place of the shorter text: 1 where the characters agree
    same = F.transform(F.sequence(F.lit(1), shortest.cast("int")),
                       lambda i: F.when(a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)), 1).otherwise(0))
    hits = F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    first_miss = F.array_position(same, 0)
    prefix = F.when(first_miss == 0, shortest).otherwise(first_miss - 1)
    words_a, words_b = F.array_distinct(F.split(a, r"[_\s]")), F.array_distinct(F.split(b, r"[_\s]"))
    shared = F.size(F.array_intersect(words_a, words_b)) / F.greatest(F.size(words_a), F.size(words_b))
    contained = a.contains(b) | b.contains(a)
    score = F.least(F.lit(1.0), hits / longest + prefix / longest * 0.3 + shared * 0.3)
    return F.when(a == b, 1.0).when((la == 0) | (lb == 0), 0.0).when(contained, shortest / longest + 0.2).otherwise(score)


def normal_name(name: Column) -> Column:
    """Lower case without spaces, underscores, dashes and dots."""
    return F.translate(F.lower(name), " _-.", "")


def edit_score(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised names."""
    x, y = normal_name(a), normal_name(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == y) | (longest == 0), 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)
