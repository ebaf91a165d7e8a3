"""Exact dedup, hard negatives and conversation repair against plain Python, on odd rows, empty tables and hot groups."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.llm import conversations, exact, negatives, workload

from .conftest import odd_rows, prose

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


# ---- exact dedup

def plain_groups(rows):
    """(row, keep_id, group_size, sha256) for each (doc_id, text), and the number of groups"""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(BLANK)].append((i, t))
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(*r, best[0], len(g), hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    return collections.Counter(out), groups


@pytest.mark.parametrize("bits,capacity", [(64, 1024), (64, 1), (3, 2), (0, 1)])
def test_exact_dedup(odd, bits, capacity):
    want, groups = plain_groups([(r[0], r[1]) for r in odd_rows()])
    got = exact.exact_dedup(odd, bits=bits, capacity=capacity).collect()
    assert collections.Counter((r["row"]["doc_id"], r["row"]["text"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["row"]["doc_id"] == r["keep_id"] for r in kept)
    assert set(got[0]["row"].asDict()) == set(odd.columns)


def test_directory_splits_overfull_buckets(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h")).union(spark.range(64).select(F.col("id").alias("h")))  # 64 hashes share 58 bits
    buckets = exact.directory(hashes, capacity=50)
    rows = buckets.collect()
    assert sum(r["held"] for r in rows) == 5064 and max(r["held"] for r in rows) <= 50
    slots, deepest = exact.slots(buckets)
    assert deepest == max(r["depth"] for r in rows) == 59
    # every range of hashes belongs to one bucket
    ranges = sorted((r["bucket"] << (64 - r["depth"]), (r["bucket"] + 1) << (64 - r["depth"])) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_exact_dedup_of_a_hot_text_and_lookup(spark, empty, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the hot\ttext ")).otherwise(F.concat(F.lit("text "), F.col("id") % 700)).alias("text"))
    folder = f"{tmp_path}/index"
    got = exact.exact_dedup(docs, folder=folder)
    assert got.where("kept").count() == 701 and got.count() == 3000
    assert {(r["keep_id"], r["group_size"]) for r in got.where("row.doc_id % 3 = 0").collect()} == {(0, 1000)}
    asked = spark.createDataFrame([(1, "thehottext"), (2, "the hot text!"), (3, None), (4, " text1 "), (4, " text1 ")], "doc_id long, text string")
    assert collections.Counter((r["row"]["doc_id"], r["keep_id"], r["known"]) for r in exact.lookup(asked, folder).collect()) == {(1, 0, True): 1, (2, None, False): 1, (3, None, False): 1, (4, 1, True): 2}
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_copies(empty).columns == empty.columns
    assert exact.drop_copies(docs).count() == 701


# ---- hard negatives

def plain_negatives(rows):
    """rows: (id, vector, label); the contract's rows"""
    e = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            e[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = set()
    for a in [i for i in e if i % 100 == 0]:
        scores = sorted(((-sum(x * y for x, y in zip(e[a][1], e[i][1])), i) for i in e if i != a))
        for p, positive in [(-s, i) for s, i in scores if e[i][0] == e[a][0]][:5]:
            fit = [(-s, i) for s, i in scores if e[i][0] != e[a][0] and 30 * p <= -100 * s <= 90 * p][:10]
            out |= {(a, positive, rank + 1, i, p, s) for rank, (s, i) in enumerate(fit)}
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, id long, score long, rank int"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_hard_negatives_query(spark, tmp_path):
    r = np.random.default_rng(5)
    centers = r.standard_normal((6, 70))
    x = np.float32(0.3 * r.standard_normal((900, 70)) + centers[r.integers(0, 6, 900)])
    x[::3] = x[0]  # a hot vector
    rows = [(i, [float(c) for c in v], int(r.integers(0, 10)), None, 7, 1) for i, v in enumerate(x)]
    rows[5], rows[6], rows[8] = (5, None, 1, None, None, None), (6, [float("nan")] * 70, 2, None, None, None), (8, rows[8][1], None, None, None, None)
    rows += [(None, rows[1][1], 1, None, None, None), (901, [None] + rows[1][1][1:], 1, None, None, None), (902, [float("inf")] * 70, 1, None, None, None), (903, [], 1, None, None, None), (904, [1.0, 2.0], 1, None, None, None), rows[1], rows[700]]
    write(spark, tmp_path, "embeddings", rows, SCHEMA)
    got = workload.op12_hard_negatives(spark, str(tmp_path)).collect()
    want = plain_negatives([r[:3] for r in rows if r[1] is None or len(r[1]) == 70])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    write(spark, tmp_path, "embeddings", [], SCHEMA)
    assert workload.op12_hard_negatives(spark, str(tmp_path)).count() == 0


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 40)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 3)
    r = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in r.standard_normal(9)], int(r.integers(0, 3)), None, None, None) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label).collect()
    assert {tuple(x) for x in got} == plain_negatives([x[:3] for x in rows]) and len(got) > 50


def test_intervals_hold(spark):
    r = np.random.default_rng(8)
    for dim in (1, 3, 64, 100):
        v = np.floor(256 * r.standard_normal((300, dim)) * r.choice([0.01, 1, 50], (300, 1))).astype(np.int64)
        v[0] = 0
        turn = negatives.rotation(dim)
        codes, along = negatives.encode(v, turn)
        low, high = negatives.Query(v[:50], turn).interval(slice(0, 50), codes, np.bitwise_count(codes).sum(axis=2).astype(np.int64), along)
        true = v[:50] @ v.T
        assert (low <= true).all() and (true <= high).all()


# ---- conversations

def plain_audit(signs):
    """Cheapest edits by relaxing whole strings from the last row on."""
    end = (10**9, "")
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    later = [(0, ""), end, end, (0, "")]

    def inserted(c):
        for _ in range(4):
            c = [min(c[s], (c[step[s]][0] + 2, "I" + c[step[s]][1])) for s in range(4)]
        return c

    later = inserted(later)
    for sign in reversed(signs):
        now = []
        for s in range(4):
            offers = [(later[s][0] + 3, "D" + later[s][1])]
            if sign != "d":
                t, role = int(sign.isupper()), sign.lower()
                offers.append((later[step[s]][0] + 2 + t, "R" + later[step[s]][1]))
                if (role == "u" and s != 2) or (role == "a" and s == 2):
                    offers.append((later[step[s]][0] + t, "K" + later[step[s]][1]))
                if role == "s" and s == 0:
                    offers.append((later[1][0] + t, "K" + later[1][1]))
            now.append(min(offers))
        later = inserted(now)
    return later[0]


def signs(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(r.choice(["dsSuUaAxX", "x", "xd", "uaua", "uA"])) for _ in range(n))


def test_audit_of_every_short_conversation():
    for n in range(5):
        for w in itertools.product("dsSuUaAxX", repeat=n):
            assert conversations.audit("".join(w)) == plain_audit(w), w


@pytest.mark.parametrize("modulus", [2**61 - 1, 3])
def test_audit_of_long_conversations(modulus, monkeypatch):
    monkeypatch.setattr(conversations.Edits, "MODULUS", modulus)  # 3: hashes collide all the time
    monkeypatch.setattr(conversations, "SHORT", 0)
    for seed in range(60):
        w = signs(random.Random(seed).randrange(1, 300), seed)
        want = plain_audit(w)
        assert conversations.audit(w) == want
        a, settled = conversations.Audit(), ""
        for i, s in enumerate(w):
            a.push(s)
            if i % 7 == 6:
                settled += a.settled()
        cost, rest = a.finish()
        assert (cost, settled + rest) == want


def test_settling_keeps_few_nodes():
    a = conversations.Audit()
    for i, s in enumerate("ua" * 3000 + "d" * 500 + "aXsu" * 500):
        a.push(s)
        if i % 100 == 99:
            a.settled()
            assert len(a.edits.letter) < 60


def plain_repair(rows):
    """The contract's row for each conversation of (conv_id, turn, role, text) rows."""
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talk = talks[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else text.translate(str.maketrans("", "", ".!?")) if what == 2 else text
        talk += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = set()
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in talk:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "k")
            seen.add((role, text))
        initials = [r[1][:1] for r in talk]
        cost, audit = plain_audit(["d" if f in "bd" else (i if i and i in "sua" else "x").upper() if f == "t" else i if i and i in "sua" else "x" for i, f in zip(initials, faults)])
        at, state, said = 0, 0, []
        for e in audit:
            _, role, text = talk[at] if e != "I" else (None, None, "")
            at += e != "I"
            if e == "D":
                continue
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            else:
                state = 3 if state == 2 else 2
                role = "user" if state == 2 else "assistant"
            said.append(f"{role}:{text}")
        turns = [t for t, *_ in talk if t is not None]
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                 sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


TALKS = "conv_id long, turn long, role string, text string, audit string, place int"


def talk_rows():
    r = random.Random(12)
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 12)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "umpire", "tool"]),
                         r.choice([prose(conv * 100 + turn, 5) + r.choice([".", "!", "", "?\n "]), "again.", "", None, " \n"])))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (77, 5, "user", "y" * 200_000), (77, 6, "assistant", "é 語."), rows[3], rows[3]]
    rows += [(99, i, ("user", "assistant")[i % 2] if i % 17 else "system", f"turn {i}" + "." * (i % 5 > 0)) for i in range(2500)]
    return [(*x, "clash", 3) for x in rows]


def test_repaired_query(spark, tmp_path):
    rows = talk_rows()
    write(spark, tmp_path, "conversations", rows, TALKS)
    got = workload.op13_repaired_talks(spark, str(tmp_path)).collect()
    want = plain_repair([r[:4] for r in rows])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    write(spark, tmp_path, "conversations", [], TALKS)
    assert workload.op13_repaired_talks(spark, str(tmp_path)).count() == 0


def test_repaired_turns(spark):
    rows = spark.createDataFrame(talk_rows(), TALKS)
    out = conversations.repaired(conversations.damaged(rows), present=F.col("there")).collect()
    by = collections.defaultdict(list)
    for r in out:
        if r["summary"] is None:
            by[r["conv_id"]].append((r["place"], f"{r['role']}:{r['text']}"))
    for r in out:
        if r["summary"]:
            said = [x for _, x in sorted(by[r["conv_id"]])]
            assert hashlib.sha256("\n".join(said).encode()).hexdigest() == r["summary"]["repaired_sha256"]
            assert len(said) == sum(r["summary"]["audit"].count(e) for e in "KRI")
