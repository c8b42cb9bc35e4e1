"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features and those of the lines before and after it speak for a state, and neighbouring
states for each other.  Forward-backward gives each line's probability of being good; their mean, weighted by line length,
is put on the scale of the labels by a logistic curve.  Labels exist for whole documents only, so lines of bad documents
that look like lines of good ones are taken as good in training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelattice.llm.batches import slices, texts
from gradelattice.session import ship_package

SAMPLE_DOCS = 3_000  # labelled documents to learn from, expected number at most
SAMPLE_LEAST = 600  # of these, at least so many of the rarer label where there are as many
RIDGE = 1e-3
STEPS = 80
CLEAN_LINE = 0.6  # probability from which a line of a bad document passes for good in training

_KINDS = 7
_KIND = np.zeros(256, np.uint8)  # letters (all of UTF-8 beyond ASCII), capitals, digits, white space, stops, bars, other signs
_KIND[:] = 6
_KIND[128:] = 0
for _k, _signs in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,;:?'\"-()", "|")):
    _KIND[[ord(c) for c in _signs]] = _k
BASE = 16  # features of a line on its own
FEATURES = 3 * BASE + 4


def lines_of(text: str | None) -> list[str]:
    """Lines that are not blank."""
    return [x for x in text.split("\n") if x.strip()] if text else []


def _base(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Own features of lines, and their lengths in bytes."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    sizes = np.array([len(r) for r in raw])
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), sizes)
    share = np.bincount(owner * _KINDS + kinds, minlength=len(raw) * _KINDS).reshape(-1, _KINDS) / sizes[:, None]
    out = np.zeros((len(lines), BASE))
    out[:, :_KINDS] = share
    out[:, 7] = share[:, 1] / np.maximum(share[:, 0] + share[:, 1], 1e-9)
    out[:, 8] = np.log1p(sizes)
    out[:, 9] = np.minimum(share[:, 6] * 20, 3)
    out[:, 10] = np.minimum(share[:, 5] * 40, 3)
    for k, (line, r) in enumerate(zip(lines, raw)):
        words = line.split()
        out[k, 11] = len(set(words)) / len(words)
        out[k, 12] = sum(map(eq, words, words[1:])) / len(words)
        out[k, 13] = min(3.0, len(r) / len(words) / 6)
        out[k, 14] = words[-1][-1] in ".!?"
        out[k, 15] = words[0][0].isupper()
    return out, sizes


def features(documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the number of lines of each document."""
    counts = np.array([len(d) for d in documents], np.int64)
    lines = [x for d in documents for x in d]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0), counts
    own, sizes = _base(lines)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts)[:-1][counts[1:] > 0] if len(counts) > 1 else []] = True
    first[0] = True
    last = np.append(first[1:], True)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    again = np.array([False] + [a == b for a, b in zip(lines, lines[1:])]) & ~first
    edge = np.stack([first, last, again, np.ones(len(lines))], axis=1)
    return np.concatenate([own, before, after, edge], axis=1), sizes.astype(float), counts


def _starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines and lengths of the chains that have lines, longest first."""
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    return begin[order], counts[order]


def forward_backward(unary: np.ndarray, transition: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, expected transitions (2 x 2), and the sum of log-partition functions.

    ``unary`` is the score of state 1 of each line (state 0 scores 0), ``transition`` scores pairs of neighbours.
    """
    begin, lengths = _starts(counts)
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    top = np.maximum(unary, 0)
    local = np.exp(np.stack([-top, unary - top], axis=1))
    move = np.exp(transition - transition.max())
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # chains longer than t
    for t in range(lengths[0]):
        at = begin[:active[t]] + t
        a = local[at] if t == 0 else alpha[at - 1] @ move * local[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    for t in range(lengths[0] - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        beta[at] = (beta[at + 1] * local[at + 1]) @ move.T / scale[at + 1][:, None]
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[begin + lengths - 1] = False
    at = np.flatnonzero(inner)
    pairs = alpha[at][:, :, None] * move[None] * (beta[at + 1] * local[at + 1] / scale[at + 1][:, None])[:, None, :]
    log_z = float(np.log(scale).sum() + top.sum() + transition.max() * inner.sum())
    return marginal[:, 1], pairs.sum(axis=0), log_z


def _minimise(value, x: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``value`` returns a function value and its gradient."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, weights = -g, []
        for s, y in reversed(past):
            weights.append(s @ d / (s @ y))
            d = d - weights[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), w in zip(past, reversed(weights)):
            d = d + (w - y @ d / (s @ y)) * s
        if d @ g >= 0:
            d, past = -g, []
        step = 1.0 if past else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        for _ in range(30):
            f2, g2 = value(x + step * d)
            if f2 <= f + 1e-4 * step * (d @ g):
                break
            step /= 2
        else:
            break
        s, y = step * d, g2 - g
        x, done, f, g = x + s, abs(f - f2) < 1e-7 * max(1, abs(f)), f2, g2
        if s @ y > 1e-12:
            past = [*past, (s, y)][-8:]
        if done:
            break
    return x


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    def value(w):
        z = x @ w
        return (weight @ (np.logaddexp(0, z) - y * z)) / weight.sum() + ridge / 2 * w @ w, x.T @ (weight * (1 / (1 + np.exp(-z)) - y)) / weight.sum() + ridge * w
    return _minimise(value, np.zeros(x.shape[1]), STEPS)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class LineModel:
    """Standardised features' weights, transitions, and the curve from good share to label."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    curve: np.ndarray
    prior: float

    def good_lines(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each line to be good, its length, and lines per document."""
        x, sizes, counts = features(documents)
        return forward_backward((x - self.centre) / self.spread @ self.weights, self.transition, counts)[0], sizes, counts

    def scores(self, documents: list[str | None]) -> np.ndarray:
        p, sizes, counts = self.good_lines([lines_of(t) for t in documents])
        share = _share(p, sizes, counts)
        z = np.stack([_logit(np.where(counts > 0, share, 0.5)), np.ones(len(counts))], axis=1) @ self.curve
        return np.where(counts > 0, 1 / (1 + np.exp(-z)), self.prior)


def _share(p: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner, p * sizes, len(counts)) / np.maximum(np.bincount(owner, sizes, len(counts)), 1)


def train(documents: list[str | None], labels: np.ndarray) -> LineModel:
    """Fit to documents and their labels 0 or 1; either label may be absent."""
    split = [lines_of(t) for t in documents]
    x, sizes, counts = features(split)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    centre, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    centre[-1], spread = 0, np.where(spread < 1e-6, 1, spread)
    x = (x - centre) / spread
    y = np.repeat(labels, counts).astype(float)
    if not len(x) or not 0 < y.sum() < len(y):
        return LineModel(centre, spread, np.zeros(FEATURES), np.zeros((2, 2)), np.array([0.0, float(_logit(np.array(prior)))]), prior)
    # Lines of bad documents that look good on their own count as good, but for the worst line of each.
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    alone = 1 / (1 + np.exp(-x @ _logistic(x, y, balance)))
    begin, lengths = _starts(counts)
    worst = np.zeros(len(x), bool)
    worst[[b + int(alone[b:b + n].argmin()) for b, n in zip(begin.tolist(), lengths.tolist())]] = True
    y = np.where((y == 0) & (alone >= CLEAN_LINE) & ~worst, 1.0, y)

    inner = np.ones(len(x), bool)
    inner[begin + lengths - 1] = False
    at = np.flatnonzero(inner)
    seen = np.bincount((2 * y[at] + y[at + 1]).astype(int), minlength=4).reshape(2, 2)

    def value(w):
        unary = x @ w[:-4]
        p, pairs, log_z = forward_backward(unary, w[-4:].reshape(2, 2), counts)
        f = (log_z - y @ unary - (seen * w[-4:].reshape(2, 2)).sum()) / len(x) + RIDGE / 2 * w @ w
        return f, np.concatenate([x.T @ (p - y), (pairs - seen).reshape(-1)]) / len(x) + RIDGE * w

    w = _minimise(value, np.zeros(FEATURES + 4), STEPS)
    p = forward_backward(x @ w[:-4], w[-4:].reshape(2, 2), counts)[0]
    some = counts > 0
    z = np.stack([_logit(_share(p, sizes, counts)[some]), np.ones(some.sum())], axis=1)
    return LineModel(centre, spread, w[:-4], w[-4:].reshape(2, 2), _logistic(z, labels[some].astype(float), np.ones(some.sum()), 1e-5), prior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, id: str = "doc_id", text: str = "text",
        label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> LineModel:
    """Train on a sample of at most about ``sample_docs`` labelled documents, drawn by a hash of the id.

    The rarer label is drawn more often, up to ``SAMPLE_LEAST`` documents.  A document with several labels counts as its
    smallest; rows without id, text or label teach nothing.  Raises ValueError if nothing is left.
    """
    known = (labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
             .where(learn if learn is not None else F.lit(True)).groupBy("doc_id").agg(F.min("label").alias("label")))
    found = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(found.values())
    if not total:
        raise ValueError("no labelled documents to learn quality from")
    wanted = {k: max(sample_docs * n / total, min(SAMPLE_LEAST, sample_docs / 2)) for k, n in found.items()}
    chance = F.create_map(*[F.lit(v) for k, n in found.items() for v in (k, min(1.0, wanted[k] / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < chance[F.col("label")])  # bounded, hence broadcast
    rows = (docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
            .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"]))
    model = train(rows["text"].tolist(), rows["label"].to_numpy())
    # Undo the heavier drawing of the rarer label.
    if len(found) == 2:
        drawn = {k: min(1.0, wanted[k] / n) for k, n in found.items()}
        model.curve[1] -= np.log(drawn[1] / drawn[0])
        model.prior = found[1] / total
    return model


def score(docs: DataFrame, model: LineModel, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``into`` (replacing a column of that name).

    Whole texts are scored, in slices by bytes: a long text of very short lines takes memory by its lines.  Null, empty and
    blank texts get the share of label 1 among all labels.  Repeated rows are scored alike.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    docs = docs.drop(*{into} - {text})
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.append_column(into, pa.array(shared.value.scores(texts(batch, text)).round(6), pa.float64()))

    return docs.mapInArrow(run, schema)
