"""Near duplicates by DartMinHash.

A document is a weighted set: its five-word shingles with their counts as weights. Darts are thrown at every unit of weight as a
Poisson process along the rank axis; a document sees the darts below its own rank limit, which lets about k ln k + 2k of them
through whatever its length, and the earliest dart of each of the k coordinates is its signature. Two signatures agree in a
coordinate with the probability of the weighted Jaccard similarity. Signatures are joined by bands, pairs are verified exactly,
and links become classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import beside, cut
from .graph import components
from .hashing import GOLD, mix, uniform

SHINGLE = 5
SIMILAR = 0.8
#: Bands and coordinates in each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 6) ** 32 > 0.9999.
BANDS, ROWS = 32, 6
#: Texts of a bucket in one block.
BLOCK = 512
#: Distinct words whose hashes a worker remembers, and shingles it works on at once.
REMEMBERED, AT_ONCE = 300_000, 1_000_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def units(words: list[str], known: WordHashes) -> np.ndarray:
    """A hash for every unit of weight: the j-th time a shingle comes has the same hash in every document, so the weighted Jaccard
    similarity of two documents is the Jaccard similarity of their units. Fewer words than a shingle are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.zeros(SHINGLE - len(h), np.uint64)])
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = mix(s + h[k: k + n] + GOLD)
    order = np.argsort(s, kind="stable")
    s = s[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return s
    first = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return np.where(nth == 0, s, mix(s + nth.astype(np.uint64) * GOLD))


def signatures(sets: list[np.ndarray], k: int = BANDS * ROWS, fractions: list[np.ndarray] | None = None) -> np.ndarray:
    """The earliest dart of each coordinate (columns) of each set of units (rows). No set may be empty.

    ``fractions`` gives the part of each unit that belongs to the set, for weights that are not whole: darts fall at a place in
    the unit, and those beyond the part are not seen.
    """
    docs = len(sets)
    best, sig = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint64)
    weight = np.array([len(s) if fractions is None else fractions[i].sum() for i, s in enumerate(sets)])
    limit = (k * np.log(k) + 2 * k) / weight
    todo = np.arange(docs)
    while len(todo):
        unit = np.concatenate([sets[i] for i in todo])
        doc = np.repeat(todo, [len(sets[i]) for i in todo])
        part = None if fractions is None else np.concatenate([fractions[i] for i in todo])
        rank, step = np.zeros(len(unit)), np.zeros(1, np.uint64)
        while len(unit):  # the next dart of every unit that is not yet beyond its limit
            step = step + GOLD
            r = mix(unit + step)
            rank = rank - np.log(uniform(r))
            near = rank <= limit[doc]
            unit, doc, rank, r = unit[near], doc[near], rank[near], mix(r[near] + GOLD)
            seen = slice(None)
            if part is not None:
                part = part[near]
                seen = uniform(mix(r + GOLD)) < part
            at = doc[seen] * k + (r[seen] % np.uint64(k)).astype(np.int64)
            ranks, darts = rank[seen], r[seen]
            np.minimum.at(best, at, ranks)
            won = ranks == best[at]
            sig[at[won]] = darts[won]
        empty = np.isinf(best.reshape(docs, k)).any(axis=1)
        todo = np.flatnonzero(empty)  # about one set in eight needs a higher limit
        limit[todo] *= 2
    return sig.reshape(docs, k)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash for each band, different for equal coordinates in different bands."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for r in range(ROWS):
        h = mix(h * GOLD + parts[:, :, r])
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        keys, sizes, bands = [], [], []
        held: list[np.ndarray] = []
        where: list[int] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if held:
                for i, b in zip(where, band_hashes(signatures(held))):
                    bands[i] = b
            held.clear(), where.clear()
            waiting = 0

        for text in batch.column("_text"):
            words = (text.as_py() or "").split()
            keys.append(xxhash.xxh3_128_hexdigest(" ".join(words)))
            u = units(words, known)
            sizes.append(len(u))
            bands.append(np.zeros(0, np.int64))
            if len(u):
                held.append(u)
                where.append(len(bands) - 1)
                waiting += len(u)
                if waiting >= AT_ONCE or len(held) >= 2000:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), batch.column("id"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                                          pa.array(bands, pa.list_(pa.int64()))], names=["rid", "row", "id", "key", "n", "bands"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        found = [units((t.as_py() or "").split(), known).view(np.int64) for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "units"])


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` of texts whose weighted Jaccard similarity is ``least`` or more."""
    u, v = held.select(F.col("key").alias("a"), F.col("units").alias("x")), held.select(F.col("key").alias("b"), F.col("units").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(u, "a").join(v, "b").where(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b")


def _across(entries: DataFrame, held: DataFrame, bands: DataFrame, least: float) -> DataFrame:
    """The links ``a, b`` between texts of one bucket whose ``root`` differs: every such pair is compared, once, and only links come out.

    Only buckets with several roots take part. A large bucket is cut into blocks, and each pair of blocks is a task's work.
    """
    mixed = entries.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y").select(
        F.col("bucket").alias("_bucket"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = entries.join(mixed, entries["bucket"] == mixed["_bucket"]).select("bucket", "key", "n", "root", "blocks", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
    h, b = held.withColumnRenamed("key", "_key"), bands.withColumnRenamed("key", "_other")
    rows = rows.join(h, rows["key"] == h["_key"]).join(b, rows["key"] == b["_other"]).drop("_key", "_other")
    rows = cut(rows)
    one = rows.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.struct("key", "n", "root", "units", "bands").alias("x"))
    two = rows.select(F.col("bucket").alias("_bucket"), F.explode(F.sequence(F.lit(0), "block")).alias("_i"), F.col("block").alias("_j"), F.struct("key", "n", "root", "units", "bands").alias("y"))
    x, y = F.col("x"), F.col("y")
    both = F.size(F.array_intersect(x["units"], y["units"]))
    alike = ((one["bucket"] == two["_bucket"]) & (one["i"] == two["_i"]) & (one["j"] == two["_j"]) & ((F.col("i") < F.col("j")) | (x["key"] < y["key"])) & (x["root"] != y["root"])
             & (F.least(x["n"], y["n"]) / F.greatest(x["n"], y["n"]) >= least) & (F.array_min(F.array_intersect(x["bands"], y["bands"])) == F.col("bucket"))
             & (both / (x["n"] + y["n"] - both) >= least))
    return one.join(two, alike).select(x["key"].alias("a"), y["key"].alias("b"))


def classes(docs: DataFrame, text: str = "text", row_id: str = "doc_id", keep: list | None = None, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The signed rows (``rid, row, id, key, ...``) and for each ``rid`` its class: ``class_id`` (the least id in it, null if all are
    null), ``class_size`` and ``kept``, true for one row of each class, that with the least id.

    Texts with the same words are one class whatever their white space, also those without words (null and empty). Within a
    bucket of a band, texts are compared with the bucket's leader first; members of one class need no comparison with each other,
    and whatever is still in different classes is compared pair by pair, so no link is lost. A group whose members are like its
    leader costs one comparison for each member.
    """
    t = docs[f"`{text}`"].cast("string")
    df = beside(docs, keep, id=docs[f"`{row_id}`"].cast("long"), _text=t).withColumn("rid", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("rid", T.LongType()), df.schema["row"], T.StructField("id", T.LongType()), T.StructField("key", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = cut(df.select("rid", "row", "id", "_text").mapInArrow(_signed, schema))
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    texts = cut(signed.groupBy("key").agg(F.min(first).alias("first"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))

    entries = texts.where("n > 0").select("key", "n", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumnRenamed("bucket", "_bucket")
    entries = cut(entries.join(full, entries["bucket"] == full["_bucket"]).select("bucket", "key", "n", "members"))
    # the text that meets the most others is likely the one the others were copied from; it leads its buckets
    met = entries.groupBy("key").agg(F.sum("members").alias("met")).withColumnRenamed("key", "_key")
    known = entries.join(met, entries["key"] == met["_key"]).drop("_key")
    heads = known.groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("head")).withColumnRenamed("bucket", "_bucket")
    entries = cut(entries.join(heads, entries["bucket"] == heads["_bucket"]).select("bucket", "key", "n", "members", "head"))
    sought = entries.select("key").distinct().join(texts.select("key", F.col("first.rid").alias("_rid")), "key")
    held = signed.select("rid", F.col("row")[text].cast("string").alias("_text")).join(sought, F.col("rid") == F.col("_rid")).select("key", "_text")
    held = cut(held.mapInArrow(_units, "key string, units array<long>"))

    roots = None

    def rooted(frame: DataFrame, key: str, root: str) -> DataFrame:
        if roots is None:
            return frame.withColumn(root, F.col(key))
        r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return frame.join(r, frame[key] == r["_node"], "left").withColumn(root, F.coalesce("_root", key)).drop("_node", "_root")

    def linked(pairs: DataFrame, verified: bool = False) -> None:
        nonlocal roots
        links = pairs if verified else cut(_verified(pairs, held, least))
        between = rooted(rooted(links, "a", "ra"), "b", "rb")
        merged = components(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if roots is None:
            roots = merged
        else:
            m = merged.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            moved = roots.join(m, roots["root"] == m["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
            roots = cut(moved.unionByName(merged))

    led = entries.where("key <> head.key")
    linked(cut(led.groupBy("key").agg(F.max("head").alias("head")).select(F.col("head.key").alias("a"), F.col("key").alias("b"))))
    apart = rooted(rooted(led.select("key", F.col("head.key").alias("leader")).distinct(), "key", "rk"), "leader", "rl").where("rk <> rl")
    linked(cut(apart.select(F.col("leader").alias("a"), F.col("key").alias("b"))))
    linked(cut(_across(rooted(entries.select("bucket", "key", "n"), "key", "root"), held, texts.select("key", "bands"), least)), verified=True)

    named = rooted(texts.select("key", "first", "copies"), "key", "root")
    whole = named.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")).withColumnRenamed("root", "_root")
    named = cut(named.join(whole, named["root"] == whole["_root"]).select(F.col("key").alias("_key"), F.col("head.id").alias("class_id"), "class_size", F.col("head.rid").alias("_head")))
    rows = signed.select("rid", "id", "key")
    return signed, rows.join(named, rows["key"] == named["_key"]).select("rid", "id", "class_id", "class_size", (F.col("rid") == F.col("_head")).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each class, with all its columns. An empty table stays empty."""
    signed, named = classes(docs, text, row_id)
    gone = named.where("NOT kept").select(F.col("rid").alias("_rid"))
    return signed.join(gone, signed["rid"] == gone["_rid"], "left_anti").select("row.*")
