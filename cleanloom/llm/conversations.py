"""Repair of conversations by a persistent audit of edits.

A conversation should read as user and assistant in turn, after at most one system row: role initials ``(s?(ua)+)?``. Rows are kept,
given another role or deleted, and rows without text are inserted; the cheapest edits win, among equals the ones whose initials
come first in ASCII order.

The audit is a dynamic program over the rows with four states: nothing yet, after ``s``, after ``u``, after ``a``. Each state holds
the best string of edits that leads to it, as a node that points to the string it prolongs, so that all strings share their
beginnings. Nodes know their ancestors at distances 1, 2, 4, ... and a rolling hash of their string; two strings of one cost are
compared at the letter after their longest common prefix, which is searched over those ancestors, and a prefix that only the
hash holds equal is verified letter by letter. Strings that end at one row with one cost never begin one another, since what
the longer one has more would be insertions, which cost something; so the better string stays better whatever follows.

Spark orders the rows, marks faults and streams each conversation through one task: rows wait only until the strings that can still
win agree on their edits. The hash of a repaired text has to pass its rows in order, which no split of the work avoids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows after which edits on which all strings agree are settled, and rows of a conversation whose audit is remembered.
SETTLE, SHORT = 512, 40
#: Remembered audits; all are given up when there are more.
REMEMBERED = 20_000
NONE, S, U, A = range(4)
ENDLESS = 10**18


class Edits:
    """Strings of edits that grow at the end and share their beginnings. Node 0 is the empty string."""

    BASE, MODULUS = 911_382_323, 2**61 - 1

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        n, up, k = len(self.letter), [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.MODULUS)
        self.up.append(up)
        return n

    def ancestor(self, node: int, depth: int) -> int:
        """The beginning of the string with so many letters."""
        far = self.depth[node] - depth
        while far:
            k = far.bit_length() - 1
            node = self.up[node][k]
            far -= 1 << k
        return node

    def before(self, x: int, y: int) -> bool:
        """Whether string x comes before string y in ASCII order."""
        common = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, common), self.ancestor(y, common)
        if a != b:
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            if self.hash[a] != self.hash[b]:
                differ, a, b = (a, b), self.up[a][0], self.up[b][0]
            else:
                differ = None
            while a != b:  # equal by hash, not one node: look at the letters
                if self.letter[a] != self.letter[b]:
                    differ = (a, b)
                a, b = self.up[a][0], self.up[b][0]
            if differ:
                return self.letter[differ[0]] < self.letter[differ[1]]
        return self.depth[x] < self.depth[y]

    def meet(self, x: int, y: int) -> int:
        """The node where two strings part."""
        common = min(self.depth[x], self.depth[y])
        x, y = self.ancestor(x, common), self.ancestor(y, common)
        if x == y:
            return x
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.up[x][0]

    def text(self, node: int, top: int = 0) -> str:
        """The letters from node ``top`` on."""
        out = []
        while node != top:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Audit:
    """The cheapest edits of the rows pushed so far, for every state."""

    def __init__(self):
        self.edits, self.cost, self.node = Edits(), [0, ENDLESS, ENDLESS, ENDLESS], [0, 0, 0, 0]
        self._insert()

    def _best(self, offers: list[tuple[int, int, str]]) -> tuple[int, int]:
        """Cost and node of the cheapest (cost, node, letter), of equals the first in ASCII order; no letter leaves the node as it is."""
        least = min(o[0] for o in offers)
        if least >= ENDLESS:
            return ENDLESS, 0
        best = None
        for cost, node, letter in offers:
            if cost == least:
                new = self.edits.add(node, letter) if letter else node
                if best is None or self.edits.before(new, best):
                    best = new
        return least, best

    def _insert(self) -> None:
        c, n = self.cost, self.node
        c[U], n[U] = self._best([(c[U], n[U], ""), *[(c[s] + INSERT, n[s], "I") for s in (NONE, S, A)]])
        c[A], n[A] = self._best([(c[A], n[A], ""), (c[U] + INSERT, n[U], "I")])

    def push(self, sign: str) -> None:
        """A row by its sign: ``d`` if it has to go, else its role's initial, ``x`` for others, as a capital if truncated."""
        c, n = self.cost, self.node
        offers = [[(c[s] + DELETE, n[s], "D")] for s in range(4)]
        if sign != "d":
            more, role = TRUNCATED if sign.isupper() else 0, sign.lower()
            if role == "s":
                offers[S].append((c[NONE] + more, n[NONE], "K"))
            for s in (NONE, S, A):
                offers[U].append((c[s] + REROLE + more, n[s], "R"))
                if role == "u":
                    offers[U].append((c[s] + more, n[s], "K"))
            offers[A].append((c[U] + REROLE + more, n[U], "R"))
            if role == "a":
                offers[A].append((c[U] + more, n[U], "K"))
        for s, (cost, node) in enumerate([self._best(o) for o in offers]):
            c[s], n[s] = cost, node
        self._insert()
        # whatever follows, ``after a`` can do it too, at no more than a deletion (of a system row that ``nothing yet`` would keep)
        if c[NONE] > c[A] + DELETE:
            c[NONE] = ENDLESS
        if c[S] > c[A]:
            c[S] = ENDLESS

    def settled(self) -> str:
        """The edits on which all strings agree; they are forgotten here."""
        alive = [s for s in range(4) if self.cost[s] < ENDLESS]
        top = self.node[alive[0]]
        for s in alive[1:]:
            top = self.edits.meet(top, self.node[s])
        out = self.edits.text(top)
        old, self.edits, new = self.edits, Edits(), {top: 0}
        for s in alive:
            path = []
            node = self.node[s]
            while node not in new:
                path.append(node)
                node = old.up[node][0]
            for node in reversed(path):
                new[node] = self.edits.add(new[old.up[node][0]], old.letter[node])
            self.node[s] = new[self.node[s]]
        return out

    def finish(self) -> tuple[int, str]:
        """The least cost, and the edits that are not settled yet."""
        cost, node = self._best([(self.cost[s], self.node[s], "") for s in (NONE, A)])
        return cost, self.edits.text(node)


AUDITS: dict[str, tuple[int, str]] = {}


def audit(signs: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    known = AUDITS.get(signs)
    if known is None:
        a = Audit()
        for sign in signs:
            a.push(sign)
        known = a.finish()
        if len(signs) <= SHORT:
            if len(AUDITS) >= REMEMBERED:
                AUDITS.clear()
            AUDITS[signs] = known
    return known


class Conversation:
    """One conversation on its way through a task; ``out`` collects its repaired rows as (place, edit, role, text)."""

    def __init__(self, conv):
        self.conv, self.waiting, self.signs, self.audit, self.state = conv, [], [], None, NONE
        self.counts, self.illegal, self.distinct, self.first, self.last, self.initial = {"b": 0, "d": 0, "t": 0, "k": 0}, 0, 0, None, None, None
        self.letters, self.digest, self.place, self.at, self.out = [], hashlib.sha256(), 0, 0, []

    def push(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        sign = "d" if fault in "bd" else initial if initial in ("s", "u", "a") else "x"
        self.waiting.append((role, text))
        self.signs.append(sign.upper() if fault == "t" else sign)
        if len(self.signs) >= SETTLE:
            self.audit = self.audit or Audit()
            for sign in self.signs:
                self.audit.push(sign)
            self.signs = []
            self.apply(self.audit.settled())

    def apply(self, edits: str) -> None:
        self.letters.append(edits)
        for e in edits:
            if e != "I":
                role, text = self.waiting[self.at]
                self.at += 1
            if e == "D":
                continue
            if e == "K":
                self.state = {"s": S, "u": U, "a": A}[role[:1]]
            else:
                self.state = A if self.state == U else U
                role, text = "assistant" if self.state == A else "user", "" if e == "I" else text
            self.digest.update(f"\n{role}:{text}".encode() if self.place else f"{role}:{text}".encode())
            self.out.append((self.place, e, role, text))
            self.place += 1
        del self.waiting[: self.at]
        self.at = 0

    def finish(self) -> dict:
        if self.audit is None:
            cost, edits = audit("".join(self.signs))
        else:
            for sign in self.signs:
                self.audit.push(sign)
            cost, edits = self.audit.finish()
        self.apply(edits)
        return {"gaps": 0 if self.first is None else self.last - self.first + 1 - self.distinct, "blank": self.counts["b"], "duplicate": self.counts["d"],
                "truncated": self.counts["t"], "illegal": self.illegal, "cost": cost, "audit": "".join(self.letters), "repaired_sha256": self.digest.hexdigest()}


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = [x.split()[0] for x in SUMMARY.split(", ")]
SPACES = " \t\n\x0b\x0c\r"


def repaired(talks: DataFrame, present: Column | None = None, turns: bool = True, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, then for each row of the repaired conversation its ``place`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``, and
    for each conversation one row with null places and a ``summary``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (null first); rows of one turn by role, then text. Null roles and texts count as one space. A row's
    first fault counts: blank, duplicate (role and text came before), truncated (its last character is none of ``.!?``). Rows for
    which ``present`` does not hold only make their conversation known. Conversations without rows have zeros, an empty audit and
    the hash of the empty string; null ids are one conversation, and an empty table gives no rows. Very long texts pass whole,
    repeated rows are duplicates, and other columns take no part. With ``turns=False`` there are summaries only. Rows of a long
    conversation wait in their task until its edits are settled, at most SETTLE rows unless two ways of repair stay equally good.
    """
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    rows = talks.select(talks[f"`{conv_id}`"].alias("conv_id"), talks[f"`{turn}`"].cast("long").alias("turn"), F.coalesce(talks[f"`{role}`"].cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(talks[f"`{text}`"].cast("string"), F.lit(" ")).alias("text"), there.alias("there")).repartition("conv_id")
    rank = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "b").when(F.col("seen") > 1, "d").when(~end.isin(".", "!", "?"), "t").otherwise("k")
    rows = rows.withColumn("seen", rank).withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen").select(
        "conv_id", "turn", "role", "text", "there", "fault")
    names = ["conv_id", "place", "edit", "role", "text", *FIELDS]
    kind = talks.schema[conv_id].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, out, held, schema = None, [], 0, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), schema)], names=names)

        def emit(t: Conversation, last: bool = False) -> None:
            summary = t.finish() if last else None
            if turns:
                out.extend((t.conv, *r, *[None] * len(FIELDS)) for r in t.out)
            t.out.clear()
            if summary:
                out.append((t.conv, None, None, None, None, *[summary[f] for f in FIELDS]))

        for b in batches:
            if schema is None:
                schema = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn_, role_, text_, there_, fault_ in zip(*[c.to_pylist() for c in b.columns]):
                if talk is None or talk.conv != conv:
                    if talk is not None:
                        emit(talk, last=True)
                    talk = Conversation(conv)
                if there_:
                    talk.push(turn_, role_, text_, fault_)
                    held += len(text_)
                    if len(talk.out) >= SETTLE:
                        emit(talk)
                if len(out) >= 4096 or turns and held > 2**24 and out:
                    yield batch()
                    out, held = [], 0
        if talk is not None:
            emit(talk, last=True)
        if out:
            yield batch()

    flat = rows.mapInArrow(walk, f"conv_id {kind}, place long, edit string, role string, text string, {SUMMARY}")
    return flat.select("conv_id", "place", "edit", "role", "text", F.when(F.col("place").isNull(), F.struct(*FIELDS)).alias("summary"))


def damaged(talks: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults planted by the crc32 of ``conv_id:turn`` modulo 20, and ``there``: false for rows that are dropped.

    Nulls are written as one space. 1 empties the text, 2 takes its ``.!?`` out, 3 gives the row twice, 4 sets the role to user.
    """
    one = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(talks[f"`{c}`"].cast("string"), one) for c in (conv_id, turn)])
    what = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(talks[f"`{text}`"].cast("string"), one)
    rows = talks.select(talks[f"`{conv_id}`"].alias("conv_id"), talks[f"`{turn}`"].alias("turn"), F.when(what == 4, "user").otherwise(F.coalesce(talks[f"`{role}`"].cast("string"), one)).alias("role"),
                        F.when(what == 1, "").when(what == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"), (what != 0).alias("there"), (what == 3).alias("twice"))
    return rows.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")
