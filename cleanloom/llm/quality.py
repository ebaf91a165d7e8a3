"""Quality rules judged by host.

Each document is measured and tested by a few rules. The failures are added up by host, the failure rates are shrunk towards
the corpus rate with a beta prior fitted to all hosts, and the verdict on the host goes back to its documents. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import beside, cut, let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
#: Rates are summed as whole numbers of this fraction, so that no order of addition changes a verdict.
UNIT = 10**9
#: Bounds of the prior's weight in documents: never less than two, never so much that no host can fail.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def repeat_words(w: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the list; each word counts once.

    Windows are hashed to 64 bits and sorted with their place, so equal ones are neighbours; the places found, sorted again,
    give the covered words as gaps. n log n for n words, nothing leaves the row.
    """
    n = F.size(w)

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda x, i: F.when(i == F.size(at) - 1, F.lit(size)).otherwise(F.least(F.lit(size), F.get(at, i + 1) - x)))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twice = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda x: x.isNotNull())
        return let(F.sort_array(twice), covered)

    def windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), places))

    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n <= size, F.lit(0)).otherwise(let(hashes, windows)).cast("long")


def measures(text: Column) -> Column:
    """The counts in ``MEASURES`` as a struct of longs; zeros for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def failures(m: Column) -> dict[str, Column]:
    """The rules; each is true where a document with these measures fails."""
    n = m["n_words"]
    return {
        "short": n < 50,
        "repeats": 100 * m["n_repeat_words"] > 50 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "word_length": (m["word_chars"] < 3 * n) | (m["word_chars"] > 12 * n),
    }


BASE_RULES = ("short", "repeats")


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``row`` with all columns of ``docs``, ``host``, ``m`` with the measures and ``failed`` with a flag for each rule."""
    df = beside(docs, host=docs[f"`{host}`"].cast("string"), m=measures(docs[f"`{text}`"].cast("string")))
    return df.select("row", "host", "m", F.struct(*[c.alias(n) for n, c in failures(F.col("m")).items()]).alias("failed"))


def host_verdicts(measured: DataFrame, most: float = 0.5) -> DataFrame:
    """A row for each host that is not null: host, n_docs, host_rate (of its worst rule) and host_failed.

    For each rule the prior is a beta distribution with the mean and the spread of the rates of all hosts (method of moments,
    less the variance that chance gives a host of its size), hosts counting alike so that one large host does not set it. A host fails if for any rule its shrunk rate is above ``most``:
    few documents alone do not fail a host. An empty table gives no hosts.
    """
    rules = [f.name for f in measured.schema["failed"].dataType.fields]
    hosts = cut(measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("failed")[r].cast("long")).alias(r) for r in rules]))
    whole = lambda c: F.round(c * UNIT).cast("decimal(38,0)")
    first = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(whole(1 / F.col("n"))).alias("chance"),
                      *[F.sum(whole(F.col(r) / F.col("n"))).alias(f"{r}_sum") for r in rules],
                      *[F.sum(whole((F.col(r) / F.col("n")) * (F.col(r) / F.col("n")))).alias(f"{r}_squares") for r in rules])
    p = first.first()  # one row

    def rate(r: str) -> Column:
        if not p["hosts"]:
            return F.lit(0.0)
        k = p["hosts"]
        mean = float(p[f"{r}_sum"]) / UNIT / k
        spread = float(p[f"{r}_squares"]) / UNIT / k - mean * mean - mean * (1 - mean) * float(p["chance"]) / UNIT / k
        weight = MOST_PRIOR if spread <= 1e-9 else min(MOST_PRIOR, max(LEAST_PRIOR, mean * (1 - mean) / spread - 1))
        return (F.col(r) + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))

    worst = F.greatest(*[rate(r) for r in rules], F.lit(0.0))
    return hosts.select("host", F.col("n").alias("n_docs"), F.round(worst, 9).alias("host_rate"), (worst > most).alias("host_failed"))


def judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` with base_failed, host_rate, host_failed and kept. Without a host only the document's own rules count.

    The verdicts are a written table, so Spark knows their size and broadcasts them below its own limit; above it the
    sort-merge join splits a host that holds many rows.
    """
    v = cut(verdicts).withColumnRenamed("host", "_host")
    df = measured.join(v, measured["host"] == v["_host"], "left")
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | F.col("failed")[r]
    df = df.withColumns({"base_failed": base, "host_failed": F.coalesce("host_failed", F.lit(False))})
    return df.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host")


def host_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, all their columns as they were.

    A document goes if it fails a base rule or its host fails. Null texts have no words and go; repeated rows are judged alike
    and each count towards their host; null hosts are not hosts; an empty table stays empty.
    """
    m = measured(docs, text, host)
    return judged(m, host_verdicts(m)).where("kept").select("row.*")
