"""Token ids in files of Simple-8b words.

A file of the folder is a Parquet file of pages, and a page holds the ids of whole documents in id order: the 64-bit words, where
each block of ``BLOCK`` ids starts among them, and the id and length of each document. Blocks are packed and unpacked side by
side with numpy. Spark's writer commits the files, so lost executors and repeated tasks leave nothing behind.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import kept_in_worker, partitions

# Ids in a word and bits of each id, by selector. Selector 0 is the escape: the next word is the id itself.
# Selector 1 stands for 240 zeros.
COUNT = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids in a block; the last block of a page may hold fewer.
BLOCK = 1024
#: A page is closed when it holds so many ids; a longer document has a page of its own.
PAGE = 1 << 18
#: Distinct pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 1_200_000
#: Bytes of text that are worked on, and pieces that are encoded, at once.
AT_ONCE, LEARNT = 8_000_000, 20_000
#: Normalizer and pre-tokenizer under which letters and the signs after them have their ids apart, in any case.
FOLDING = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
PAGES = "shard int, page int, first long, n_ids long, doc_ids array<long>, lengths array<long>, offsets binary, words binary"

_POWERS = np.array([1 << i for i in range(64)], np.uint64)
# Letters that have no other form in NFC and one lower case, then signs that are neither letters, digits nor apostrophes.
_PLAIN = re.compile(r"(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)")
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of ids (unsigned), and the place of each block's first word (uint32). Each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    pad = int(COUNT.max())
    padded = np.zeros((blocks, BLOCK + pad), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : n - whole * BLOCK] = ids[whole * BLOCK:]
    bits = _BITS[padded] if int(ids.max()) < len(_BITS) else np.searchsorted(_POWERS, padded, side="right").astype(np.uint8)
    selector = np.where(bits[:, :BLOCK] > 60, 0, 15).astype(np.uint8)
    widest, held = bits, 1  # widest id among the next `held` ids of each place
    for k in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 240):
        widest = np.maximum(widest[:, : widest.shape[1] - (k - held)], widest[:, k - held:])
        held = k
        if widest[:, : BLOCK - k].min() > 60 // k:  # wider than any word of k ids or more, but for the ends of blocks
            break
        for s in np.flatnonzero(COUNT == k):
            fits = widest[:, :BLOCK] <= WIDTH[s]
            selector[:, : fits.shape[1]][fits] = s
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, block = np.zeros(blocks, np.int64), np.arange(blocks)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(block):  # one word of every unfinished block at a time
        s = selector[block, at]
        steps.append((block, at, s))
        at = at + COUNT[s]
        going = at < lengths[block]
        block, at = block[going], at[going]
    block, at, chosen = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(block, kind="stable")
    block, at, chosen = block[order], at[order], chosen[order]
    packed = np.zeros(len(block), np.uint64)
    for s in np.unique(chosen):
        if s == 0 or s == 1:
            packed[chosen == s] = np.uint64(int(s) << 60)
            continue
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), int(s) << 60, np.uint64)
        for j in range(COUNT[s]):
            word |= padded[block[rows], at[rows] + j] << np.uint64(j * WIDTH[s])
        packed[rows] = word
    takes = np.where(chosen == 0, 2, 1)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    words[place] = packed
    words[place[chosen == 0] + 1] = padded[block[chosen == 0], at[chosen == 0]]
    first = np.searchsorted(block, np.arange(blocks))
    return words, place[first].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) packed in the words; blocks without an escape are unpacked together."""
    out = np.zeros(len(offsets) * BLOCK, np.uint64)
    if not n:
        return out[:0]
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets)), ends - offsets)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.zeros(len(offsets), bool)
    escaped[block[selector == 0]] = True
    for b in np.flatnonzero(escaped):
        i, at = int(offsets[b]), b * BLOCK
        limit = min((b + 1) * BLOCK, n)
        while at < limit:
            s, w = int(selector[i]), int(words[i])
            if s == 0:
                i += 1
                values = [int(words[i])]
            else:
                values = [(w >> (j * int(WIDTH[s]))) & ((1 << int(WIDTH[s])) - 1) for j in range(COUNT[s])]
            i += 1
            values = values[: limit - at]
            out[at: at + len(values)] = values
            at += len(values)
    counts = np.where(escaped[block], 0, COUNT[selector])
    total = np.cumsum(counts) - counts
    place = total - total[offsets][block]
    for s in range(2, 16):
        rows = np.flatnonzero((selector == s) & ~escaped[block])
        if not len(rows):
            continue
        mask, word = np.uint64((1 << int(WIDTH[s])) - 1), words[rows]
        start, base = place[rows], block[rows] * BLOCK
        for j in range(COUNT[s]):
            inside = start + j < BLOCK
            out[(base + start + j)[inside]] = ((word >> np.uint64(j * WIDTH[s])) & mask)[inside]
    return out[:n]


def _runs(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs in ``which``, one after another, and their ends after a 0; run k is ``ids[ends[k]:ends[k + 1]]``."""
    counts = np.diff(ends)[which]
    to = np.append(0, np.cumsum(counts))
    return ids[np.repeat(ends[which] - to[:-1], counts) + np.arange(to[-1])], to


class WordIds:
    """uint32 ids of texts, piece by piece: the tokenizer drops white space and never joins over it, so texts are cut at ASCII white
    space, and only distinct words are looked at, in columns.

    Where the tokenizer cuts letters from signs and ignores case (``FOLDING``), a word of plain letters and then signs has the ids of
    its letters in lower case and those of its signs. Any other word is one piece. Each piece is encoded once, all new ones in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # Spark reuses its Python workers, so tokenizer and pieces outlive the task
        self.kept = kept_in_worker("words").setdefault(path, {})
        if not self.kept:
            self.kept["tokenizer"] = Tokenizer.from_file(path)
            self.forget()
        self.tokenizer = self.kept["tokenizer"]
        rules = [json.loads(x.__getstate__()) if x else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.folds = rules == FOLDING and not any(_PLAIN.fullmatch(t) for t in added)

    def forget(self) -> None:
        """Numbers of pieces, the ids of all pieces in that order, and their ends after a 0; piece 0 is empty."""
        self.kept |= {"known": {"": 0}, "ids": np.zeros(0, "<u4"), "ends": np.zeros(2, np.int64)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        known, ids, ends = self.kept["known"], [self.kept["ids"]], [self.kept["ends"]]
        for a in range(0, len(pieces), LEARNT):
            some = pieces[a: a + LEARNT]
            encoded = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ids.append(np.array(encoded.ids, "<u4"))
            starts = np.fromiter((x for x, _ in encoded.offsets), np.int64, len(ids[-1]))
            cuts = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            ends.append(ends[-1][-1] + np.searchsorted(starts, cuts))
        known.update(zip(pieces, range(len(known), len(known) + len(pieces))))
        self.kept |= {"ids": np.concatenate(ids), "ends": np.concatenate(ends)}

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces; new ones are learnt."""
        new = [x for x in pieces if x not in self.kept["known"]]
        if new and len(self.kept["known"]) + len(new) > REMEMBERED:
            self.forget()
            new = [x for x in pieces if x]
        if new:
            self.learn(new)
        return np.fromiter(map(self.kept["known"].__getitem__, pieces), np.int64, len(pieces))

    def cut(self, words: pa.Array) -> list[pa.Array]:
        """The first pieces of all words, the second pieces of all words (or empty)."""
        if not self.folds:
            return [words]
        plain = pc.extract_regex(words, f"^{_PLAIN.pattern}$")
        return [pc.coalesce(pc.utf8_lower(pc.struct_field(plain, 0)), words), pc.fill_null(pc.struct_field(plain, 1), "")]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, none of them null."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        cut = self.cut(words.dictionary)
        pieces = pa.concat_arrays(cut).dictionary_encode()
        numbers = self.numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = _runs(self.kept["ids"], self.kept["ends"], numbers[pieces.indices.to_numpy()].reshape(len(cut), -1).T.ravel())
        ids, ends = _runs(ids, ends[::len(cut)], words.indices.to_numpy())
        return np.split(ids, ends[np.cumsum(pc.list_value_length(split).to_numpy())[:-1]])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts, null ones empty, in portions of at most ``AT_ONCE`` bytes or one longer text."""
    for batch in batches:
        docs, texts, a = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), ""), 0
        ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64))
        while a < len(docs):
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, side="right")) - 1)
            yield docs[a:z], texts.slice(a, z - a)
            a = z


def _pages(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, shard, end = WordIds(path), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        schema = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])
        ids, lengths, held, page, first = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal page, first, ids, lengths, held
            flat = np.concatenate(held)
            words, offsets = pack(flat)
            row = [[shard], [page], [first], [len(flat)], [ids], [lengths], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()]]
            page, first, ids, lengths, held = page + 1, first + len(flat), [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        n = 0
        for doc_id, encoded in ((i, e) for docs, texts in _portions(batches) for i, e in zip(docs, known.encode(texts))):
            size = len(encoded) + 1
            if n and n + size > PAGE:
                yield closed()
                n = 0
            ids.append(doc_id)
            lengths.append(size)
            held += [encoded, end]
            n += size
        if n:
            yield closed()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, row_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every text and writes the ids, ``end_id`` after each document, in ascending id order (null first, then by a hash of the text).

    Null texts are empty: the end id alone. Repeated rows are written as often as they come. An empty table gives an empty folder of pages.
    """
    t = docs[f"`{text}`"].cast("string")
    df = docs.select(docs[f"`{row_id}`"].cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"))
    df = df.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    df.select("doc_id", "text").mapInArrow(_pages(tokenizer, end_id), PAGES).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4").astype(np.int64), row["n_ids"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            parts = [ids[e - k: e] for e, k in zip(ends.tolist(), lengths.tolist())]
            last = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if digest else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                                              pa.array(ends - lengths + row["first"], pa.int64()), pa.array(lengths, pa.int64()), last],
                                             names=["shard", "doc_id", "before", "n_tokens", "ids_crc32" if digest else "ids"])


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids, or with ``digest`` their crc32, from the files."""
    pages = spark.read.schema(PAGES).parquet(folder)
    kind = "ids_crc32 long" if digest else "ids array<long>"
    found = pages.mapInArrow(lambda x: _documents(x, digest), f"shard int, doc_id long, before long, n_tokens long, {kind}")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = pages.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return found.join(base, found["shard"] == base["_shard"]).select(
        "doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", kind.split()[0])
