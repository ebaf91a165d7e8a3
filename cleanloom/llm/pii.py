"""Personal data by weak supervision.

Strict patterns find the base spans. They and looser candidates (local phone numbers, national ids, bank accounts, names) are
voted on by labelers: patterns, gazetteers and context. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates how reliable each labeler is, and the posteriors train a logistic regression on the span itself, which decides
on the candidates. The texts are read twice: to learn and to mark; nothing but votes and features is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import beside, cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local", "national", "account", "name")
#: Candidates, taken by the smallest hashes, that the final classifier is trained on. Votes are counted over all candidates.
TRAINED_ON = 20_000
CONTEXT = 48

# The contract's patterns, with starts that cannot match left out: a match inside a run of digits fails if the run's start fails.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = {
    "local": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9A-Za-z.-]?[0-9A-Za-z])"),
    "national": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
}
# Gazetteers.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme"
FIRST_NAMES = ("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen "
               "Daniel Nancy Matthew Lisa Anthony Hans Peter Klaus Petra Sabine Stefan Andreas Jean Pierre Michel Claire Sophie Camille Luc José Juan Carlos María Carmen Ana Luis")
MAIL_TOPS = "com org net edu gov io de fr es uk eu info"
_NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES.split())})\.?\x20|(?:{'|'.join(FIRST_NAMES.split())})\x20)(?:[A-ZÀ-Þ][a-zà-ÿ]+)(?:\x20[A-ZÀ-Þ][a-zà-ÿ]+)?\b")
_NAME_HINT = re.compile(rf"\b(?:{'|'.join(sorted(set(TITLES.split()) | set(FIRST_NAMES.split())))})\b")
_FOR = re.compile(r"(?i)\b(?:phone|tel|telefon|téléphone|call|fax|mobile|cell|e-?mail|mail|contact|write to|reach|ssn|social security|card|visa|iban|account|konto|ip|address|name|by|von|signed)\b")
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|issn|page|pages|chapter|section|article|invoice|order|figure|table|volume|build|release|row|line|year)\b")
LABELERS = ("strict", "shape", "gazetteer", "context", "other_context", "boundary", "density")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans: leftmost, not overlapping within a kind, failing matches dropped without another try."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_PART:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that overlap no base span, in text order; of two that overlap the earlier stays."""
    loose = []
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE.items():
            loose += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if _NAME_HINT.search(text):
        loose += [(m.start(), m.end(), "name") for m in _NAME.finditer(text)]
    if not loose:
        return []
    taken, out = sorted((s, e) for _, s, e in base), []
    i = end = 0
    for s, e, kind in sorted(loose):
        while i < len(taken) and taken[i][0] < e:
            end = max(end, taken[i][1])
            i += 1
        if s >= end:
            out.append((kind, s, e))
            end = e
    return out


def votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """1 (personal), -1 (not) or 0 (no opinion) of each labeler."""
    span, before = text[start:end], text[max(0, start - CONTEXT):start]
    digits = "".join(_DIGIT.findall(span))
    strict = 1 if kind in BASE else 0
    shape = 0
    if kind == "account":
        shape = 1 if int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1 else -1
    elif kind == "national":
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" else 1
    elif kind == "local":
        shape = 1 if re.fullmatch(r"\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}", span) else -1
    elif digits and len(set(digits)) == 1:
        shape = -1
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in MAIL_TOPS.split() else -1
    elif kind == "name":
        gazetteer = 1 if _NAME_HINT.match(span) and " " in span.strip() else 0
    elif kind == "ip":
        gazetteer = -1 if span.startswith(("0.", "127.")) else 0
    near = text[max(0, start - 30):end + 30]
    left, right = text[start - 1:start], text[end:end + 1]
    return [strict, shape, gazetteer, 1 if _FOR.search(before) else 0, -1 if _AGAINST.search(before) else 0,
            -1 if left and (left.isalnum() or left in "_=/#") or right and (right.isalnum() or right in "_=/") else 1,
            -1 if len(re.findall(r"[0-9]+", near)) - len(re.findall(r"[0-9]+", span)) > 4 else 0]


def features(text: str, kind: str, start: int, end: int, v: list[int]) -> list[float]:
    """What the final classifier sees of a span."""
    span = text[start:end]
    n = max(1, len(span))
    digits = sum(c.isdigit() for c in span)
    return [1.0, *[float(kind == k) for k in KINDS], digits / n, min(n, 64) / 32, sum(c in " .-/()" for c in span) / n, float(span[:1] in "(+"),
            *[float(x) for x in v[1:]]]


@dataclass
class Model:
    """Reliabilities P(vote | class) of the labelers, the share of personal spans and the classifier's weights."""

    prior: float = 0.0
    reliabilities: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(np.array(rows) @ np.array(self.weights), -30, 30)))


def estimate(patterns: list[tuple[str, int]], rounds: int = 300) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM on counted vote patterns: prior, P(vote | class) by labeler (class, labeler, vote), posterior of each pattern."""
    patterns = sorted(patterns)
    v = np.array([[int(x) + 1 for x in p.split(",")] for p, _ in patterns])
    n = np.array([float(c) for _, c in patterns])
    prior = 0.5
    rel = np.zeros((2, v.shape[1], 3))
    rel[1] += [0.15, 0.35, 0.5]  # a labeler is thought to be better than chance at first
    rel[0] += [0.5, 0.35, 0.15]
    for _ in range(rounds):
        at = np.log(rel[:, np.arange(v.shape[1]), v]).sum(axis=2)  # class, pattern
        odds = at[1] - at[0] + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip((post * n).sum() / n.sum(), 0.01, 0.99))
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            for vote in range(3):
                rel[c, :, vote] = ((v == vote) * w[:, None]).sum(axis=0) + 1  # one vote of each kind beforehand
            rel[c] /= rel[c].sum(axis=1, keepdims=True)
    return prior, rel, {p: float(x) for (p, _), x in zip(patterns, post)}


def regression(x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; each row counts n times."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows, hashes = [], [], []
        for text, h in zip(batch.column("text"), batch.column("h").to_pylist()):
            text = text.as_py() or ""
            base = base_spans(text)
            for kind, s, e in base + candidates(text, base):
                v = votes(text, kind, s, e)
                keys.append(",".join(map(str, v)))
                rows.append(features(text, kind, s, e, v))
                hashes.append(hash((h, kind == "email", s, e)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.list_(pa.float64())), pa.array(hashes, pa.int64())], names=["votes", "features", "h"])


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of a corpus. Without candidates it marks base spans only."""
    t = docs[f"`{text}`"].cast("string")
    seen = cut(docs.select(t.alias("text"), F.xxhash64(t).alias("h")).mapInArrow(_voted, "votes string, features array<double>, h long"))
    patterns = [(r["votes"], r["n"]) for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 3 ** labelers rows
    if not patterns:
        return Model()
    prior, rel, posterior = estimate(patterns)
    sample = seen.groupBy("h", "votes", "features").agg(F.count(F.lit(1)).alias("n")).orderBy("h", "votes", "features").limit(TRAINED_ON).collect()  # copies of a span are one row
    w = regression(np.array([r["features"] for r in sample]), np.array([posterior[r["votes"]] for r in sample]), np.array([r["n"] for r in sample]))
    return Model(prior, rel.tolist(), w.tolist())


def spans(text: str, model: Model, least: float = 0.5) -> list[tuple[str, int, int]]:
    """Base spans and the candidates the model takes, by kind and start."""
    base = base_spans(text)
    loose = candidates(text, base)
    if loose:
        p = model.scores([features(text, k, s, e, votes(text, k, s, e)) for k, s, e in loose])
        base = base + [c for c, x in zip(loose, p) if x >= least]
    return sorted(base, key=lambda x: (KINDS.index(x[0]), x[1]))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with the name of its kind in the place of each span; spans that overlap become one, named after the first."""
    out, at, open_ = [], 0, None
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if open_ and s < open_[2]:
            open_ = (open_[0], open_[1], max(e, open_[2]))
            continue
        if open_:
            out += [text[at:open_[1]], f"[{open_[0].upper()}]"]
            at = open_[2]
        open_ = (kind, s, e)
    if open_:
        out += [text[at:open_[1]], f"[{open_[0].upper()}]"]
        at = open_[2]
    return "".join(out) + text[at:]


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def mark(docs: DataFrame, model: Model, text: str = "text", keep: list | None = None, rewrite: bool = False) -> DataFrame:
    """``row`` with all columns (or those in ``keep``) and ``spans``; with ``rewrite`` also ``redacted``, null where the text is null.

    Null and empty texts have no spans; repeated rows are marked alike; an empty table stays empty.
    """
    df = beside(docs, keep, _text=docs[f"`{text}`"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found, texts = [], []
            for t in batch.column("_text"):
                t = t.as_py()
                here = spans(t, model) if t else []
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in here])
                if rewrite:
                    texts.append(redacted(t, here) if here else t)
            columns, names = [batch.column("row"), pa.array(found, kind)], ["row", "spans"]
            if rewrite:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, T.StructType([df.schema["row"], T.StructField("spans", FOUND), *([T.StructField("redacted", T.StringType())] if rewrite else [])]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by the names of its kinds; their other columns stay as they were."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != text]
    out = mark(docs, fit(docs, text), text, others or [F.lit(0).alias("none")], rewrite=True)
    return out.select(*[F.col("redacted").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
