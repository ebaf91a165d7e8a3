"""Sampled segmentations against all segmentations of short texts."""

import collections
import math

import numpy as np
import pytest

from cleanloom.llm import pieces
from cleanloom.llm.pieces import SPACE, Lattices, Vocabulary, sampled, segment
from cleanloom.llm.workload import tokenizer_file

from .conftest import odd_rows

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return Lattices(Vocabulary(MODEL))


def everything(text, v):
    if not text:
        return [((), 0.0)]
    out = []
    for e in range(1, len(text) + 1):
        if text[:e] in v.weights:
            i, w = v.weights[text[:e]]
            out += [((i, *rest), w + x) for rest, x in everything(text[e:], v)]
    return out


def test_probabilities_and_order(lattices):
    v, n = lattices.vocabulary, 6000
    paths = dict(everything(f"{SPACE}the{SPACE}cat", v))
    total = math.log(sum(map(math.exp, paths.values())))
    p = {i: math.exp(x - total) for i, x in paths.items()}
    first, second = collections.Counter(), collections.Counter()
    for found in segment(["the cat"] * n, [7919 * i + 1 for i in range(n)], lattices, 3):
        ids = [tuple(x.tolist()) for x, _, _ in found]
        assert len(set(ids)) == 3
        assert all(math.exp(lp) == pytest.approx(p[i], rel=1e-3) for i, (_, lp, _) in zip(ids, found))
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
    top = sorted(p, key=p.get, reverse=True)[:3]
    for a in top:
        assert abs(first[a] / n - p[a]) < 4 * math.sqrt(p[a] / n)
        for b in top:
            if a != b:  # without replacement
                q = p[a] * p[b] / (1 - p[a])
                assert abs(second[a, b] / n - q) < 4 * math.sqrt(q / n) + 1e-3


def test_inclusion_scores_are_probabilities(lattices):
    """Horvitz-Thompson: with inclusion scores as weights, any sum over all segmentations is estimated without bias."""
    n, sums = 6000, 0.0
    for found in segment(["the cat"] * n, [104729 * i + 3 for i in range(n)], lattices, 2):
        sums += sum(math.exp(lp - inclusion) for _, lp, inclusion in found)
    assert abs(sums / n - 1) < 0.05


def test_all_segmentations_of_a_small_lattice(lattices):
    want = {i for i, _ in everything(f"{SPACE}at", lattices.vocabulary)}
    (found,) = segment(["at"], [3], lattices, 100)
    assert {tuple(x.tolist()) for x, _, _ in found} == want and all(inclusion == 0 for *_, inclusion in found)


def test_draws_do_not_depend_on_neighbours(lattices):
    texts, keys = [r[1] or "" for r in odd_rows()], list(range(len(odd_rows())))
    together = segment(texts, keys, lattices, 3)
    alone = [segment([t], [k], Lattices(lattices.vocabulary), 3)[0] for t, k in zip(texts[:8], keys)]
    for a, b in zip(together, alone):
        assert [x.tolist() for x, _, _ in a] == [x.tolist() for x, _, _ in b]


@pytest.mark.parametrize("room", [0, 200_000])
def test_frequent_words_are_prepared_once(monkeypatch, lattices, room):
    """When the room for prepared words is full, those met again and again stay, and the samples are those of new lattices."""
    prepared, prepare = collections.Counter(), Lattices._prepare
    kept = Lattices(lattices.vocabulary)
    monkeypatch.setattr(pieces, "REMEMBERED", room)
    monkeypatch.setattr(kept, "_prepare", lambda words: (prepared.update(words), prepare(kept, words))[1])
    common = [f"common{i * 7919 % 1000}é" for i in range(40)]
    for n in range(30):
        texts = [" ".join([*common, *(f"rare{n}word{i}" for i in range(j, j + 50))]) for j in (0, 50)]
        got, want = (segment(texts, [n, n + 1], x, 3) for x in (kept, Lattices(lattices.vocabulary)))
        assert [[(x.tolist(), *scores) for x, *scores in found] for found in got] == [[(x.tolist(), *scores) for x, *scores in found] for found in want]
        assert not room or pieces.EDGE * kept.edges + pieces.WORD * len(kept.known) < 2 * room
    again = {prepared[SPACE + w] for w in common}
    assert again == ({1} if room else {30}) and len(prepared) == 40 + 30 * 100


def test_decoding_many_at_once(lattices):
    v, texts = lattices.vocabulary, ["", "a b", "", " É語 😀\n", "x"]
    ids = [found[0][0] for found in segment(texts, [1, 2, 3, 4, 5], lattices, 2)]
    assert v.decode_all(ids) == texts and v.decode_all([]) == [] and v.decode_all(ids[:1]) == [""]
    assert v.decode_all([np.array([v.bytes[0xC3]]), np.array([v.bytes[0xA9]])]) == ["\ufffd"] * 2  # halves of a letter stay apart


def test_decoding_agrees_with_the_library(lattices):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in ["", "a", " lead  and trail ", "É́ 語 😀\n\n\tx", "a▁b", "\x00\x1f<0x41>", "\ud83d".encode("utf-8", "replace").decode()]:
        for ids, _, _ in segment([t], [5], lattices, 3)[0]:
            assert lattices.vocabulary.decode(ids) == sp.decode(ids.tolist()) == t.replace(SPACE, " ")


def test_sampled_rows(spark, odd, empty):
    got = sampled(odd, MODEL, digest=True).select("row.doc_id", "row.text", "sample", "n_pieces", "ids_crc32", "round_trip").collect()
    assert all(r["round_trip"] for r in got)
    per = collections.Counter((r["doc_id"], r["text"]) for r in got)
    rows = collections.Counter((r[0], r[1]) for r in odd_rows())
    assert set(per) == set(rows) and all(per[k] == rows[k] * (2 if k[1] else 1) for k in rows)
    again = sampled(odd.repartition(2), MODEL, digest=True).select("row.doc_id", "row.text", "sample", "n_pieces", "ids_crc32", "round_trip").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert sampled(empty, MODEL).count() == 0
    one = sampled(odd.where("doc_id = 4"), MODEL).first()
    assert one["n_pieces"] == len(one["ids"])
