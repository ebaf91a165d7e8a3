"""The pipeline on odd rows, and the registered queries."""

import collections
import os
import re
import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from cleanloom.llm import workload as llm_workload

from .conftest import odd_rows, prose
from .test_documents import fill


def write(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_keep_columns(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, str(tmp_path))
            assert out.columns == odd.columns, stage
            out.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (last.count() == 0) == (name == "empty")


def test_run_takes_effect(spark, tmp_path):
    rows = [(i, prose(i, 80) + f" write to user{i}@mail.example.com now", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(20)] + [(200, "too short", "en", "s1", 1), (201, "na " * 200, "en", "s1", 1)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path / "t")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} <= set(range(60))
    from cleanloom.llm.pieces import Vocabulary
    from cleanloom.llm.workload import tokenizer_file

    v = Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    for r in got:
        text = v.decode(np.array(r["ids"]))
        assert "[EMAIL]" in text and "@" not in text and prose(r["doc_id"], 80) in text


def plainly_kept(rows):
    """Ids of the rows that stay under the quality rules, by plain Python."""
    def failed(text):
        ws, symbols = re.findall(r"[^\x20\x09-\x0D]+", text or ""), len(re.findall(r"[#*$%&|<>]", text or ""))
        windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        seen = collections.Counter(windows)
        repeats = len({j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)})
        chars = sum(map(len, ws))
        return [len(ws) < 50, 100 * repeats > 50 * len(ws), 10 * symbols > len(ws), chars < 3 * len(ws) or chars > 12 * len(ws)]

    flags = {r[0]: failed(r[1]) for r in rows}
    hosts = collections.defaultdict(list)
    for r in rows:
        if r[3] is not None:
            hosts[r[3]].append(flags[r[0]])
    bad = set()
    for k in range(4):
        rates = {h: sum(f[k] for f in v) / len(v) for h, v in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        spread = sum(x * x for x in rates.values()) / len(rates) - mean**2 - mean * (1 - mean) * sum(1 / len(v) for v in hosts.values()) / len(hosts)
        weight = 1000.0 if spread <= 1e-9 else min(1000.0, max(2.0, mean * (1 - mean) / spread - 1))
        bad |= {h for h, v in hosts.items() if (rates[h] * len(v) + weight * mean) / (len(v) + weight) > 0.5}
    return {r[0] for r in rows if not any(flags[r[0]][:2]) and r[3] not in bad}


def plain_classes(texts):
    """Classes of texts whose five-word shingles, with their counts, have a similarity of 0.8 or more; by comparing all pairs."""
    shingles = {i: collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for i, t in texts.items() for w in [t.split()]}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = shingles[a], shingles[b]
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                root[find(b)] = find(a)
    out = collections.defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return list(out.values())


def test_stages_against_plain_python(spark, tmp_path):
    """Every stage's rows, and the rows of the registered query, against brute force."""
    rows = [(i, prose(i, 100 + i % 60) + (f" mail user{i}@mail.example.com now" if i % 2 else ""), "en", ["a", "b", None, "c"][i % 4], 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "c", 1) for i in range(12)]  # exact copies
    rows += [(200 + i, rows[20 + i][1].replace(rows[20 + i][1].split()[50], "changed", 1), "en", "b", 1) for i in range(12)]  # near copies
    rows += [(300 + i, "too short a text", "en", "bad", 1) for i in range(30)] + [(340, prose(340, 90), "en", "bad", 1), (341, "na " * 200, "en", "a", 1), (342, None, "en", "a", 1), (343, "", None, None, 1)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), tmp_path / "t")
    texts, docs, seen = {r[0]: r[1] for r in rows}, spark.read.parquet(f"{folder}/documents.parquet"), {}
    for stage, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, folder).write.parquet(f"{tmp_path}/{stage}")
        docs = spark.read.parquet(f"{tmp_path}/{stage}")
        seen[stage] = docs.collect()

    good = plainly_kept(rows)
    assert sorted((r["doc_id"], r["text"]) for r in seen["quality_rules"]) == sorted((i, texts[i]) for i in good)
    assert 340 not in good and set(range(80)) <= good
    kept = collections.Counter((r["doc_id"], r["text"]) for r in seen["minhash_near_dedup"])
    groups = plain_classes({i: texts[i] for i in good})
    assert sum(len(g) > 1 for g in groups) == 24 and len(kept) == sum(kept.values()) == len(groups)
    assert all(sum((i, texts[i]) in kept for i in g) == 1 for g in groups)
    redacted = {i: re.sub(r"user[0-9]+@mail\.example\.com", "[EMAIL]", t) for i, t in kept}
    assert {r["doc_id"]: r["text"] for r in seen["pii"]} == redacted and len(seen["pii"]) == len(redacted)

    source = {r["doc_id"]: r["source"] for r in seen["pii"]}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t in redacted.items():
        sizes[source[i]] += len(t.split())
    copies = collections.Counter(r["doc_id"] for r in seen["mixing"])
    for r in seen["mixing"]:
        assert r["text"] == redacted[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - v) <= 90 for s, v in fill(sizes).items()) and max(copies.values()) <= 3
    for s in sizes:  # complete epochs first
        times = {copies[i] for i in redacted if source[i] == s}
        assert max(times) - min(times) <= 1

    from cleanloom.llm.pieces import Vocabulary

    v = Vocabulary(llm_workload.tokenizer_file("piece_bpe_32k.model"))
    got = __spark_entry__.queries()["pipeline"](spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter({i: 2 * n for i, n in copies.items()})
    assert all(v.decode(np.array(r["ids"])) == redacted[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in got)


def test_op8_shards_the_texts(spark, tmp_path):
    rows = [(i % 50, prose(i % 50, 20 + i % 7) if i % 9 else None, "en", "s", 1) for i in range(120)] + [(60, prose(60, 30000), "en", "s", 1), (None, "x", "en", "s", 1)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path / "t")
    calls, shard_rows = [], llm_workload.shard_rows

    def seen(docs, **how):
        calls.append(shard_rows(docs, **how))
        return calls[-1]

    llm_workload.shard_rows = seen
    try:
        got = __spark_entry__.queries()["op8_histogram_shards"](spark, folder).collect()
    finally:
        llm_workload.shard_rows = shard_rows
    assert "text" in calls[0].schema["row"].dataType.names
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_registered_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for top in ("cleanloom", "workload"):
        for folder, _, files in os.walk(os.path.join(root, top)):
            if os.path.basename(folder) != "llm":
                for f in files:
                    if f.endswith(".py"):
                        with open(os.path.join(folder, f)) as h:
                            assert "llm" not in h.read(), f
