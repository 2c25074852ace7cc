"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. The field's potentials are a line's own features, those of the lines before and
after it, and the step between labels. Training starts from the document's label on all its lines; then
lines of bad documents that the field itself holds good are relabelled and it is fitted again. A
document's quality is the mean of its lines' forward-backward marginals, weighted by length, brought to
a probability of label 1 by a logistic curve.

The sample is bounded (`labelled.SAMPLE_PER_LABEL` rows of either label); every line of every text is
read in scoring, LINES at a time, so neither a long text nor many short lines fill a task's memory. Null and
empty texts are one empty line. Only the text is an input of a score. An empty sample, or one of a single label,
gives every text the share of label 1 (1 if empty).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Logistic, held_out, sample, scores

ROUNDS, STEPS, RATE = 2, 120, 0.08
#: Lines whose features are in memory at a time.
LINES = 20_000
#: Byte classes whose shares of a line are features.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"%$#&*@^~=<>{}[]\\+_/", b"|", b"!?", b".,;:", b" \t"]
TABLE = np.zeros((len(CLASSES), 256), np.float32)
for _i, _c in enumerate(CLASSES):
    TABLE[_i, list(_c)] = 1


WIDTH = len(CLASSES) + 7


def _own(lines: list[bytes], again: list[bool]) -> np.ndarray:
    """Features of lines by themselves; again: whether a line stood before in its text."""
    size = np.array([len(x) for x in lines], np.int64)
    raw = np.frombuffer(b"".join(lines), np.uint8)
    begin, full = np.cumsum(size) - size, size > 0
    share = np.zeros((len(lines), len(CLASSES)))
    if full.any():
        for c in range(len(CLASSES)):
            share[full, c] = np.add.reduceat(TABLE[c][raw], begin[full]) / size[full]
    counts = []
    for x in lines:
        w = x.split()
        counts.append((len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:])) if len(w) > 1 else 0))
    w = np.array(counts, np.float64).reshape(len(lines), 3)
    n = np.maximum(w[:, 0], 1)
    return np.column_stack([share, np.log1p(size), w[:, 1] / n, w[:, 2] / n, again, size / n / 10, w[:, 0] == 0, w[:, 1] / n < 0.5])


def own_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, document number) of every line, without its neighbours."""
    made, sizes, own, lines, again = [np.zeros((0, WIDTH), np.float32)], [], [], [], []
    for d, t in enumerate(texts):
        mine = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
        seen: set[bytes] = set()
        for a in range(0, len(mine), LINES):
            for x in mine[a : a + LINES]:
                again.append(x in seen and not x.isspace() and x != b"")
                seen.add(x)
            lines += mine[a : a + LINES]
            if len(lines) >= LINES:
                made.append(_own(lines, again).astype(np.float32))
                lines, again = [], []
        sizes.append(np.fromiter(map(len, mine), np.float64, len(mine)))
        own.append(np.full(len(mine), d, np.int64))
    if lines:
        made.append(_own(lines, again).astype(np.float32))
    return np.concatenate(made), np.concatenate([np.zeros(0), *sizes]), np.concatenate([np.zeros(0, np.int64), *own])


def with_neighbours(own: np.ndarray, doc: np.ndarray, a: int, b: int) -> np.ndarray:
    """Features of the lines a to b: their own, those of the lines before and after in the text, and whether there are none."""
    n = len(own)
    before, after = np.maximum(np.arange(a, b) - 1, 0), np.minimum(np.arange(a, b) + 1, n - 1)
    here = np.arange(a, b)
    first, last = (doc[before] != doc[a:b]) | (before == here), (doc[after] != doc[a:b]) | (after == here)
    return np.column_stack([own[a:b], np.where(first[:, None], 0, own[before]), np.where(last[:, None], 0, own[after]), first, last]).astype(np.float64)


def forward_backward(score: np.ndarray, step: np.ndarray, own: np.ndarray, count: int, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of label 1 of each line, and expected counts of label pairs at each line but the first, if asked for.

    score: log odds of label 1 of the lines, ordered by document; step: 2 x 2 log potentials. Documents go
    side by side, longest first, line by line.
    """
    n = np.bincount(own, minlength=count)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    n, first = n[order], first[order]
    node = np.column_stack([np.ones(len(score)), np.exp(np.clip(score, -25, 25))])
    node /= node.sum(1, keepdims=True)
    move = np.exp(step)
    ahead, back = np.zeros((len(score), 2)), np.ones((len(score), 2))
    length = int(n.max(initial=0))
    live = np.searchsorted(-n, -np.arange(length), "left")
    for t in range(length):
        at = first[: live[t]] + t
        a = node[at] if t == 0 else node[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        at = first[: live[t + 1]] + t
        b = (node[at + 1] * back[at + 1]) @ move.T
        back[at] = b / b.sum(1, keepdims=True)
    both = ahead * back
    marginal = both[:, 1] / both.sum(1)
    if not pairs:
        return marginal, None
    inner = np.flatnonzero(np.append(False, own[1:] == own[:-1]))
    pair = ahead[inner - 1][:, :, None] * move[None] * (node[inner] * back[inner])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return marginal, pair


class QualityModel:
    def __init__(self, texts: list[str], good: np.ndarray):
        self.curve, self.constant = None, float(good.mean()) if len(good) else 1.0
        if len(set(good)) < 2:
            return
        lines, size, own = own_features(texts)
        x = with_neighbours(lines, own, 0, len(lines))
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._z(x)
        label = good[own]
        self.w, self.step = np.zeros(z.shape[1]), np.zeros((2, 2))
        for _ in range(ROUNDS):
            self._fit(z, label, own, len(texts))
            marginal, _ = forward_backward(z @ self.w, self.step, own, len(texts))
            label = np.where((good[own] == 0) & (marginal > 0.5), 1.0, good[own])
        held = self._held(z @ self.w, size, own, len(texts))
        self.curve = Logistic(np.concatenate([held, held[good == 0]]), np.concatenate([good, good[good == 0]]))

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])

    def _fit(self, z: np.ndarray, label: np.ndarray, own: np.ndarray, count: int) -> None:
        """Adaptive gradient steps on the conditional log likelihood."""
        inner = np.flatnonzero(np.append(False, own[1:] == own[:-1]))
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
        m, v = np.zeros(z.shape[1] + 4), np.zeros(z.shape[1] + 4)
        for t in range(1, STEPS + 1):
            p, pair = forward_backward(z @ self.w, self.step, own, count)
            grad = np.concatenate([z.T @ (label - p) / len(z) - 1e-4 * self.w, ((seen - pair.sum(0)) / len(z) - 1e-4 * self.step).ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w += move[:-4]
            self.step += move[-4:].reshape(2, 2)

    def _held(self, score: np.ndarray, size: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
        p, _ = forward_backward(score, self.step, own, count, pairs=False)
        weight = size + 1
        mean = np.bincount(own, p * weight, count) / np.bincount(own, weight, count)
        return np.log((mean + 1e-3) / (1 - mean + 1e-3))[:, None]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.constant)
        lines, size, own = own_features(texts)
        parts = [self._z(with_neighbours(lines, own, a, min(a + LINES, len(lines)))) @ self.w for a in range(0, len(lines), LINES)]
        return self.curve(self._held(np.concatenate([np.zeros(0), *parts]), size, own, len(texts)))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return QualityModel(*sample(docs, labels, "quality"))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = docs.select("doc_id", scores(model, LINES)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
