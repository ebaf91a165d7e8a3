"""Sampled SentencePiece segmentations, without replacement.

All segmentations of a text are paths through a lattice of pieces. A perturbed A-star search emits the k paths with the largest
Gumbel-perturbed log probabilities, which is a sample of k distinct segmentations without replacement (Gumbel top-k): each region
of the search is a set of paths with a known total probability, and the largest perturbed value in it is drawn before any of its
paths, under the bound its parent region sets. No piece reaches over the start of a word, so the lattice of a text is a chain of
small lattices, each prepared once for each distinct word.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress, count, islice
from math import exp, expm1, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import beside, kept_in_worker
from .hashing import GOLD, mix, uniform

SPACE = "▁"
#: Bytes of prepared lattices a worker remembers before it forgets rare words, and characters it works on at once (or one longer text).
REMEMBERED, AT_ONCE = 64_000_000, 400_000
#: Bytes of an edge, and of a word with its place in the table of words, about.
EDGE, WORD = 16, 170


class Vocabulary:
    """Pieces of a SentencePiece model with log probabilities.

    Scores of a unigram model are log probabilities. Scores of a BPE model are merge ranks; the piece of rank r then gets the
    probability of Zipf's law, 1 / (r + 3), and the pieces for single bytes that of the last rank.
    """

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = [sp.get_score(i) for i in range(n)]
        ranked = min(scores) < -1000
        weigh = (lambda s: -log(3 - s)) if ranked else (lambda s: s)
        floor = min(weigh(s) for s in scores)
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.large_binary())
        self.unknown, self.byte_weight = sp.unk_id(), floor / temperature
        self.weights = {self.pieces[i]: (i, weigh(scores[i]) / temperature) for i in range(n)
                        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.weights))
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.weights)
        # A stop begins a word if no piece holds it behind a character that is no stop.
        stops = set(".,;:!?|")
        while bad := {c for c in stops if any(b not in stops and b != SPACE and a == c for p in self.weights for b, a in zip(p, p[1:]))}:
            stops -= bad
        s, other = "".join(map(re.escape, sorted(stops))), "".join(map(re.escape, sorted(stops))) + SPACE + "\n"
        stopped = f"{SPACE}*[{s}]+[^{other}]*|" if s else ""
        self.words = re.compile(r"(?s).+" if crossing else rf"{stopped}{SPACE}*[^{other}]+|{SPACE}+|\n")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_all([ids])[0]

    def decode_all(self, found: Sequence[np.ndarray]) -> list[str]:
        """The text of each array of ids; the bytes of all of them are joined at once."""
        _, offsets, data = self.raw.take(pa.array(np.concatenate([*found, np.zeros(0, np.int32)]))).buffers()
        stops = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, found)])].tolist()
        data = memoryview(data or b"")
        texts = [str(data[a:z], "utf-8", "replace") for a, z in zip(stops, stops[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]


class Lattices:
    """Lattices of words side by side in arrays. The edges of a word lie together, place by place, those of a place longest piece
    first; a place is known by its first edge.

    New words are prepared together: one walk down a trie of the pieces for all their places at once, then backward sums over all
    paths to the word's end, for all words by the distance from the end.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        longer = [p for p in v.weights if len(p) > 1]
        alphabet = sorted({ord(c) for p in longer for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[alphabet] = np.arange(1, len(alphabet) + 1)
        children: list[dict[int, int]] = [{}]
        inner = {p[:n] for p in longer for n in range(1, len(p))}
        state_of = {"": 0}
        for p in sorted(inner, key=len):
            state_of[p] = len(children)
            children.append({})
        # a target is an inner state or, below zero, a piece that nothing longer begins with
        self.width = len(alphabet) + 1
        self.table = np.zeros((len(children), self.width), np.int32)
        self.ends = np.full(len(children), -1, np.int32)  # piece that ends at an inner state
        for p in inner:
            self.table[state_of[p[:-1]], self.letter[ord(p[-1])]] = state_of[p]
            if p in v.weights:
                self.ends[state_of[p]] = v.weights[p][0]
        for p in longer:
            if p not in inner:
                self.table[state_of[p[:-1]], self.letter[ord(p[-1])]] = -v.weights[p][0] - 1
        self.single = np.full(0x110000, -1, np.int32)
        for p, (i, _) in v.weights.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.ascii = np.array([v.bytes.get(c, v.unknown) for c in range(128)])
        self.weight = np.zeros(len(v.pieces))
        for i, w in v.weights.values():
            self.weight[i] = w
        self.reset()

    def reset(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)  # a word's number
        self.edges = 0
        self.begin = np.zeros(1 << 12, np.int32)  # first edge of a word
        self.met = np.zeros(1 << 12, np.int32)  # calls that met a word, halved whenever others are forgotten
        self.upto = np.zeros(1 << 16, np.float32)  # probability of an edge and those before it in its place, 2 for the last
        self.to = np.zeros(1 << 16, np.int32)  # first edge of the place it leads to, -1 at the end of a word
        self.piece = np.zeros(1 << 16, np.int32)  # piece, or below zero a character that is spelled in bytes
        self.logp = np.zeros(1 << 16, np.float32)

    def _room(self, names: tuple[str, ...], n: int) -> None:
        for name in names:
            a = getattr(self, name)
            if len(a) < n:
                setattr(self, name, np.concatenate([a, np.zeros(max(n, len(a) * 5 // 4) - len(a), a.dtype)]))

    def starts(self, words: list[str]) -> np.ndarray:
        """First edge of each word. Words that are new are prepared; when too many are remembered, rare ones are forgotten before."""
        if EDGE * self.edges + WORD * len(self.known) > REMEMBERED:
            self._forget()
        before = len(self.known)
        try:
            numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            if len(self.known) > before:
                self._prepare(list(islice(self.known, before, None)))
        except BaseException:
            self.reset()  # no word may be known without its edges
            raise
        self.met[numbers] += 1  # once, however often a word is among these
        return self.begin[numbers]

    def _forget(self) -> None:
        """Forgets the words met by the fewest calls, so that those left take half the room at most."""
        n = len(self.known)
        held = np.diff(np.append(self.begin[:n], self.edges))
        room = np.bincount(self.met[:n], EDGE * held + WORD)
        stays = self.met[:n] >= np.flatnonzero(np.append(np.cumsum(room[::-1])[::-1], 0) <= REMEMBERED / 2)[0]
        edge, gone = np.repeat(stays, held), np.cumsum(np.where(stays, 0, held))
        self.to[:self.edges] -= np.where(self.to[:self.edges] < 0, 0, np.repeat(gone, held)).astype(np.int32)
        for name in ("upto", "to", "piece", "logp"):
            a = getattr(self, name)
            left = a[:self.edges][edge]
            if EDGE * len(a) > 2 * REMEMBERED:  # grown by one very long text
                setattr(self, name, left)
            else:
                a[:len(left)] = left
        self.edges, m = int(edge.sum()), int(stays.sum())
        self.begin, self.met = (self.begin[:n] - gone)[stays], self.met[:n][stays] >> 1
        self.known = defaultdict(count(m).__next__, zip(compress(self.known, stays.tolist()), range(m)))

    def _prepare(self, words: list[str]) -> None:
        v = self.vocabulary
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        place = np.arange(len(codes))
        end = np.repeat(ends, size)  # of the word, as a place
        left = end - place
        letters = self.letter[codes]
        single = self.single[codes]
        spelled = np.fromiter((len(v.bytes) == 256 and len(chr(c).encode("utf-8", "surrogatepass")) or 1 for c in codes[single < 0].tolist()), np.float64)
        own = np.where(single >= 0, single, np.where((codes < 128) & (len(v.bytes) == 256), self.ascii[np.minimum(codes, 127)], -codes - 1))
        source, target, piece, rank = [place], [place + 1], [own], [np.zeros(len(codes), np.int64)]
        weight = [self.weight[np.maximum(single, 0)]]
        weight[0][single < 0] = spelled * v.byte_weight
        held = np.ones(len(codes), np.int64)  # edges of a place
        table = self.table.ravel()
        at, state = place, table[letters]
        at, state = at[state > 0], state[state > 0]
        length = 1
        while len(at):
            inside = np.flatnonzero(left[at] > length)
            at, state = at[inside], state[inside]
            state = table[state.astype(np.int64) * self.width + letters[at + length]]
            length += 1
            going = np.flatnonzero(state)
            at, state = at[going], state[going]
            found = np.where(state < 0, -state - 1, self.ends[np.maximum(state, 0)])
            hit = np.flatnonzero(found >= 0)
            here, found = at[hit], found[hit]
            source.append(here), target.append(here + length), piece.append(found), weight.append(self.weight[found]), rank.append(held[here])
            held[here] += 1
            going = np.flatnonzero(state > 0)
            at, state = at[going], state[going]
        source, target, piece, weight, rank = map(np.concatenate, (source, target, piece, weight, rank))
        # sums need the edges by distance from the word's end, then by place; longest piece first
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        many = held[order]
        begins = np.cumsum(many) - many
        slot = np.empty(len(codes), np.int64)
        slot[order] = begins
        slot = slot[source] + held[source] - 1 - rank
        word = np.repeat(np.arange(len(words)), size)
        sorted_target, sorted_piece, sorted_weight = np.empty(len(slot), np.int64), np.empty(len(slot), np.int32), np.empty(len(slot))
        sorted_target[slot], sorted_piece[slot], sorted_weight[slot] = target + word[source], piece, weight
        distance = left[order]
        node_cuts = np.searchsorted(distance, np.arange(1, int(distance[-1]) + 2))
        cuts = np.append(begins, len(slot))[node_cuts]
        beta = np.zeros(len(codes) + len(words))  # of the places, each word with one more for its end
        node = order + word[order]
        logp = np.zeros(len(slot))
        for a, z, b, y in zip(cuts.tolist(), cuts[1:].tolist(), node_cuts.tolist(), node_cuts[1:].tolist()):
            if a == z:
                continue
            x = sorted_weight[a:z] + beta[sorted_target[a:z]]
            group, m = begins[b:y] - a, many[b:y]
            top = np.maximum.reduceat(x, group)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, m)), group))
            beta[node[b:y]] = total
            logp[a:z] = x - np.repeat(total, m)
        p = np.exp(logp)
        p, alone = np.cumsum(p), p[begins]
        p -= np.repeat(p[begins] - alone, many)
        p[begins + many - 1] = 2.0
        # in the arrays the edges lie by place
        n, e = len(self.known), self.edges + len(slot)
        first = self.edges + np.cumsum(held) - held
        after = np.full(len(beta), -1, np.int32)
        after[node] = first[order]
        lies = np.repeat(first[order] - begins, many) + np.arange(len(slot))
        self._room(("begin", "met"), n)
        self._room(("upto", "to", "piece", "logp"), e)
        self.upto[lies], self.to[lies], self.piece[lies], self.logp[lies] = p, after[sorted_target], sorted_piece, logp
        self.begin[n - len(words): n] = first[ends - size]
        self.edges = e

    def sample(self, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path to the end of the word from each place, drawn by the bits: the edges, word after word, and how many each has."""
        n = len(at)
        counts, word, steps = np.zeros(n, np.int64), np.arange(n), []
        e = np.array(at)
        while len(e):
            going = e >= 0
            if not going.all():
                counts[word[~going]] = len(steps)
                going = np.flatnonzero(going)
                word, e, bits = word[going], e[going], bits[going]
            bits = mix(bits + GOLD)
            u = uniform(bits).astype(np.float32)
            over = np.flatnonzero(u >= self.upto[e])
            while len(over):
                e[over] += 1
                over = over[u[over] >= self.upto[e[over]]]
            steps.append((word, e))
            e = self.to[e]
        offset = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for s, (word, e) in enumerate(steps):
            out[offset[word] + s] = e
        return out, counts

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The piece ids of a path."""
        found = self.piece[edges]
        if len(found) and found.min() < 0:
            v, out = self.vocabulary, []
            for i in found.tolist():
                out += [i] if i >= 0 else [v.bytes[b] for b in chr(-i - 1).encode("utf-8", "surrogatepass")] if len(v.bytes) == 256 else [v.unknown]
            found = np.array(out, np.int32)
        return found


def _rest(logp: float) -> float:
    """log(1 - exp(logp)), minus infinity where nothing is left."""
    left = -expm1(min(logp, 0.0))
    return log(left) if left > 0 else -inf


def _under(location, bound, u):
    """Gumbel values at the locations, given that none exceeds the bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class _Search:
    """The search in one text: its regions in a heap, its paths, and what it has found."""

    def __init__(self, key: int, start: np.ndarray, lattices: Lattices):
        self.random, self.start, self.lattices = random.Random(key), start, lattices
        self.heap: list[tuple] = []  # (-value, number, kind, path, place...)
        self.paths: list[tuple] = []  # edges, ends of words in them, log probability before each word, first open word, values of the open words
        self.found: list[tuple[np.ndarray, float, float]] = []
        self.number = 0

    def push(self, value: float, *region) -> None:
        if value > -inf:
            heapq.heappush(self.heap, (-value, self.number, *region))
            self.number += 1

    def value_under(self, location: float, bound: float) -> float:
        if location == -inf:
            return -inf
        x, y = -bound, log(-log(self.random.random() or 0.5)) - location  # as _under has it
        return -max(x, y) - log1p(exp(-abs(x - y)))

    def head(self, path: int) -> None:
        """The best of a path's regions 'another segmentation of word i, the words before it as they are'."""
        first, values = self.paths[path][3:]
        if len(values):
            i = int(values.argmax())
            self.push(float(values[i]), "word", path, first + i)

    def take(self, edges, ends, before, first, values, total: float, value: float) -> None:
        self.paths.append((edges, ends, before, first, values))
        self.found.append((edges, total, value))
        self.head(len(self.paths) - 1)

    def leave(self, path: int, i: int, j: int, upto: float, banned: tuple[int, ...], bound: float | None) -> float:
        """Pushes the region 'word i leaves its path at its j-th edge' and gives its log mass within the word."""
        mass = upto + _rest(log(sum(exp(float(self.lattices.logp[e])) for e in banned)))
        if bound is not None:
            self.push(self.value_under(float(self.paths[path][2][i]) + mass, bound), "edge", path, i, j, upto, banned)
        return mass

    def next(self) -> tuple | None:
        """The next path as far as the edge by which it leaves an older one, and the bits that draw the rest of that word, or None if
        there is none left."""
        lattices, logp = self.lattices, self.lattices.logp
        while self.heap:
            value, _, kind, path, i, *more = heapq.heappop(self.heap)
            value = -value
            edges, ends, before, first, values = self.paths[path]
            begin = int(ends[i - 1]) if i else 0
            own = edges[begin: int(ends[i])].tolist()
            if kind == "word":
                values[i - first] = -inf
                self.head(path)
                upto = [0.0]
                for e in own:
                    upto.append(upto[-1] + float(logp[e]))
                masses = [self.leave(path, i, j, upto[j], (e,), None) for j, e in enumerate(own)]
                top = max(masses)
                if top == -inf:
                    continue
                j = self.random.choices(range(len(own)), [exp(m - top) for m in masses])[0]
                for other, e in enumerate(own):
                    if other != j:
                        self.leave(path, i, other, upto[other], (e,), value)
                banned, done = (own[j],), upto[j]
            else:
                j, done, banned = more
            a = z = int(lattices.to[own[j - 1]]) if j else int(self.start[i])
            while lattices.upto[z] < 1.5:
                z += 1
            free = [e for e in range(a, z + 1) if e not in banned]
            if not free:
                continue
            taken = self.random.choices(free, [exp(float(logp[e])) for e in free])[0] if len(free) > 1 else free[0]
            if len(free) > 1:
                self.leave(path, i, j, done, (*banned, taken), value)
            return value, path, i, begin, own[:j], done, taken, self.random.getrandbits(64)
        return None


def segment(texts: list[str], keys: list[int], lattices: Lattices, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct segmentations in the order of their perturbed values: ids, log probability, log of the
    inclusion score. The texts are searched side by side; each draw hangs on the text's own key alone.

    The inclusion score is the probability that the segmentation's perturbed value exceeds the (k + 1)-th value, the threshold of
    the sample; it is 1 if there are no more than k segmentations. An empty text has the empty segmentation alone.
    """
    v = lattices.vocabulary
    words = [v.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = lattices.starts([w for x in words for w in x])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    seeds = mix(np.array([x & (2**64 - 1) for x in keys], np.uint64))
    searches = [_Search(x, start[a:z], lattices) for x, a, z in zip(keys, bounds, bounds[1:])]
    # what is still to be drawn: text, the word before the first one drawn, log probability so far, bound, and how the path begins
    todo = [(d, -1, 0.0, -log(-log(searches[d].random.random() or 0.5)), None) for d in range(len(texts)) if sizes[d]]
    for turn in range(k):
        if turn:
            leaving = [(d, x) for d, s in enumerate(searches) if len(s.found) == turn and (x := s.next())]
            tails, stops = lattices.sample(lattices.to[[x[-2] for _, x in leaving]], np.array([x[-1] for _, x in leaving], np.uint64))
            stops, todo = np.cumsum(stops).tolist(), []
            for (d, (value, path, i, begin, own, done, taken, _)), a, z in zip(leaving, [0, *stops], stops):
                tail = tails[a:z]
                sofar = float(searches[d].paths[path][2][i]) + done + float(lattices.logp[taken]) + float(lattices.logp[tail].sum(dtype=np.float64))
                todo.append((d, i, sofar, value, (path, begin, own, done, taken, tail)))
        if not todo:
            break
        many = np.array([sizes[t[0]] - t[1] - 1 for t in todo])
        owner = np.repeat(np.arange(len(todo)), many)
        ahead = np.cumsum(many) - many
        word = np.arange(len(owner)) - np.repeat(ahead, many) + np.repeat([t[1] + 1 for t in todo], many)
        doc = np.array([t[0] for t in todo])[owner]
        bits = mix(mix(seeds[doc] + np.uint64(turn + 1)) + word.astype(np.uint64))
        drawn, counts = lattices.sample(start[bounds[doc] + word], bits)
        stops = np.cumsum(counts)
        per_word = np.add.reduceat(lattices.logp[drawn].astype(np.float64), stops - counts) if len(counts) else np.zeros(0)
        upto = np.concatenate([[0.0], np.cumsum(per_word)])
        sofar, bound = np.array([t[2] for t in todo]), np.array([t[3] for t in todo])
        before = upto[:-1] - upto[ahead[owner]] + sofar[owner]
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(np.minimum(per_word, 0.0)), 0.0))
        values = _under(before + rest, bound[owner], uniform(mix(bits ^ GOLD)))
        for (d, i, begun, value, following), a, n in zip(todo, ahead.tolist(), many.tolist()):
            s = searches[d]
            lo, hi = int(stops[a - 1]) if a else 0, int(stops[a + n - 1]) if n else 0
            edges, ends, earlier = drawn[lo:hi] if n else drawn[:0], stops[a: a + n] - lo, before[a: a + n]
            total = float(earlier[-1] + per_word[a + n - 1]) if n else begun
            if following:
                path, begin, own, done, taken, tail = following
                old_edges, old_ends, old_before = s.paths[path][:3]
                here = begin + len(own) + 1 + len(tail)
                edges = np.concatenate([old_edges[:begin], np.array([*own, taken], np.int32), tail, edges])
                ends = np.concatenate([old_ends[:i], [here], here + ends])
                earlier = np.concatenate([old_before[: i + 1], earlier])
            s.take(edges, ends, earlier, i + 1, values[a: a + n], total, value)
            if following:
                at = done + float(lattices.logp[taken])
                for m, e in enumerate(tail.tolist(), len(own) + 1):
                    s.leave(len(s.paths) - 1, i, m, at, (e,), value)
                    at += float(lattices.logp[e])
    out = []
    for s in searches:
        threshold = -s.heap[0][0] if s.heap else -inf
        out.append([(lattices.ids(e), lp, _log_inclusion(lp - threshold)) for e, lp, _ in s.found] or [(np.zeros(0, np.int32), 0.0, 0.0)])
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    return x if x < -35 else 0.0 if x > 4 else log(-expm1(-exp(x)))


def sampled(docs: DataFrame, model: str, k: int = 2, row_id: str = "doc_id", text: str = "text", keep: list | None = None, digest: bool = False,
            seed: int = 17, temperature: float = 1.0) -> DataFrame:
    """A row for each document and segmentation: ``row``, sample (from 1), n_pieces, log_prob, log_inclusion, ``ids`` (with ``digest``
    their crc32) and round_trip, whether decoding the ids gives the text back (U+2581 as a space, as the library has it).

    The row's id seeds the draw, so a document has the same samples wherever it is computed, and repeated rows have the same. Null
    texts are empty texts and have the empty segmentation; a text with fewer than k segmentations has all of them.
    """
    df = beside(docs, keep, key=F.xxhash64(F.lit(seed), docs[f"`{row_id}`"]), _text=docs[f"`{text}`"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark reuses its Python workers, so prepared words outlive the task
        kept = kept_in_worker("lattices")
        if (model, temperature) not in kept:
            kept[model, temperature] = Lattices(Vocabulary(model, temperature))
        lattices = kept[model, temperature]
        for batch in batches:
            keys, held, first, n = batch.column("key").to_pylist(), [], 0, 0
            for i, t in enumerate(batch.column("_text")):
                held.append(t.as_py() or "")
                n += len(held[-1])
                if n >= AT_ONCE or i == len(keys) - 1:
                    yield rows(batch.slice(first, i + 1 - first), held, keys[first: i + 1], lattices)
                    held, first, n = [], i + 1, 0

    def rows(batch: pa.RecordBatch, texts: list[str], keys: list[int], lattices: Lattices) -> pa.RecordBatch:
        at, out, all_found = [], [], segment(texts, keys, lattices, k)
        decoded = iter(lattices.vocabulary.decode_all([ids for found in all_found for ids, _, _ in found]))
        for i, (t, found) in enumerate(zip(texts, all_found)):
            plain = t.replace(SPACE, " ")
            for s, (ids, lp, inclusion) in enumerate(found, 1):
                at.append(i)
                out.append((s, len(ids), lp, inclusion, zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids, next(decoded) == plain))
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64() if digest else pa.list_(pa.int32()), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *[pa.array(c, x) for c, x in zip(columns, kinds)]],
                                          names=["row", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_crc32" if digest else "ids", "round_trip"])

    ids = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, T.StructType([df.schema["row"], T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()), T.StructField("log_prob", T.DoubleType()),
                                            T.StructField("log_inclusion", T.DoubleType()), ids, T.StructField("round_trip", T.BooleanType())]))
