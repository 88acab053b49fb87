"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  A passage is encoded by a small learned
layer over numbers that describe its words and characters; gated attention
(Ilse et al., 2018) weighs the encoded passages; a logistic output scores
their weighted mean.  Only documents have labels; which passages matter is
learned with the rest, by gradient descent on a bounded sample of labelled
documents.  Scoring runs in one pass over all texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from textflow.llm.labelled import judged, sample
from textflow.llm.passages import FEATURES, passages
from textflow.llm.stored import pick
from textflow.llm.words import texts

#: Labelled documents learned from, of each class, and their bytes at most.
PER_CLASS, BYTES_EACH = 1000, 1 << 15
CODE, GATE, STEPS = 16, 8, 250


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _sum_by(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class GatedAttention:
    """Score of bags: sigmoid(c . sum_k a_k h_k + d), h = tanh(W x + b),
    a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / _sum_by(e, first)[bag]
        z = _sum_by(a[:, None] * h, first)
        return x, h, v, u, a, bag, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[4]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x, h, v, u, a, bag, z, s = self.forward(x, first)
        ds = weight * (s - y)
        dz = ds[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - _sum_by(a * da, first)[bag])
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        return {"c": z.T @ ds, "d": ds.sum(), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dx, "b": dx.sum(axis=0)}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> GatedAttention:
    """Adam over all bags at once; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    x, first = np.concatenate(bags).astype(float), np.append(0, np.cumsum([len(b) for b in bags]))
    weights = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, CODE)), "b": np.zeros(CODE), "V": rng.normal(0, 0.3, (CODE, GATE)),
               "U": rng.normal(0, 0.3, (CODE, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, CODE), "d": np.zeros(())}
    model = GatedAttention(weights, x.mean(axis=0), x.std(axis=0) + 1e-3)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        for k, g in model.gradient(x, first, y, share).items():
            g = g + 1e-5 * weights[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            weights[k] = weights[k] - 0.03 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> GatedAttention | None:
    """A model of ``label`` in ``labels`` for the texts of ``docs``, learned
    from at most PER_CLASS documents a class; None unless both classes occur."""
    rows = sample(docs, labels, label, PER_CLASS, BYTES_EACH)
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return None
    bags = []
    for at in range(0, len(rows), 200):
        x, first = passages(texts([r[0].encode() for r in rows[at:at + 200]]))
        bags += np.split(x, first[1:-1])
    return fit(bags, y)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
                   threshold: float = 0.7, whole: bool = False) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row: the whole text's quality, 0 to 1.

    Null and empty texts, and texts without words, are one passage of zeros
    and get its score.  With no labels of one of the classes every score is
    0.5.  A null id is scored, and not held out.  Repeated rows have equal
    scores.  An empty table gives an empty result.  ``whole``: see :func:`judged`."""
    model = train(pick(docs, {"doc_id": id_col, "text": text_col}), labels, label)

    def score(values):
        x, first = passages(texts(values))
        return model.score(x, first) if model else np.full(len(values), 0.5)

    return judged(docs, id_col, text_col, score, threshold, whole)
